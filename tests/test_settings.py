"""Settings, versions and handles."""

import pytest

from meshframe.errors import InvalidArgument
from meshframe.operators.lifecycle import Context, Device, Stream, create_communicators, dry_run, init, library_version
from meshframe.plans.selection import choose
from meshframe.plans.settings import Settings


def test_settings():
    s = Settings.read({"MESHFRAME_FUSION": "1", "MESHFRAME_FUSION_BYTES_THRESHOLD": "512", "MESHFRAME_PRIORITY": "lifo", "MESHFRAME_ALLREDUCE": "packed:100-max", "PATH": "x"})
    assert s.fusion and s.fusion_bytes_threshold == 512 and s.priority == "lifo" and s.bf16 == "truncate"
    assert choose(s.hints("allreduce"), 99) == "long" and choose(s.hints("allreduce"), 100) == "packed"
    for wrong in ({"MESHFRAME_NOPE": "1"}, {"MESHFRAME_FUSION": "maybe"}, {"MESHFRAME_BF16": "up"}, {"MESHFRAME_REDUCE": "ring"}, {"MESHFRAME_CHUNK_ELEMENTS": "x"}):
        with pytest.raises(InvalidArgument):
            Settings.read(wrong)


def test_lifecycle(spark):
    assert init() is spark or init().sparkContext is spark.sparkContext
    assert str(library_version()) == "0.1.0"
    comms = create_communicators(4, [0, 3], devices={0: Device()})
    assert set(comms) == {0, 3} and comms[0] is comms[3]
    with pytest.raises(InvalidArgument):
        create_communicators(4, [4])
    assert Stream("queue").native == "queue" and Context().native is None
    assert "Range" in dry_run(spark.range(3))
