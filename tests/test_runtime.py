"""Events, attributes, fusion, messages and hints."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.pairwise import Pairwise
from meshframe.operators import p2p
from meshframe.operators.comm import Communicator
from meshframe.plans import planned, selection
from meshframe.plans.settings import Settings
from meshframe.sources.buffers import pack, positions, unpack
from meshframe.streaming.runtime import Call, FusionLimits, OpAttr, fuse, start, stream_allreduce


def test_events(spark):
    first = start(spark, lambda: spark.range(5).count())
    after = start(spark, lambda: first.wait() + 1, deps=(first,))
    assert after.wait() == 6 and first.test() and bool(after)
    failed = start(spark, lambda: 1 / 0)
    for e in (failed, start(spark, lambda: None, deps=(first, failed))):
        with pytest.raises(ZeroDivisionError):
            e.wait()
    go = threading.Event()
    held = start(spark, lambda: go.wait(20))
    assert not held.test()
    go.set()
    assert held.wait()
    assert start(spark, lambda: 7, OpAttr(synchronous=True)).test() and start(spark, lambda: 7, settings=Settings(op_sync=True)).test()


def test_events_are_cancelled(spark):
    def forever(batches):
        time.sleep(60)
        yield from batches

    began = time.perf_counter()
    event = start(spark, lambda: spark.range(4).mapInArrow(forever, "id long").count())
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.perf_counter() - began < 30:
        time.sleep(0.1)
    event.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        event.wait()
    assert time.perf_counter() - began < 50


def test_calls_run_in_the_pool_of_their_priority(spark):
    seen = lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    assert start(spark, seen, OpAttr(priority=3), settings=Settings(priority="direct")).wait() == "priority-3"
    assert start(spark, seen, OpAttr(priority=3)).wait() is None and seen() is None


def test_calls_by_name_and_attributes(spark):
    b = spark.createDataFrame([(0, 0, 0, 3), (1, 0, 0, -7)], "rank int, buf_id int, idx long, value long")
    comm = Communicator(2)
    value = lambda attr, **a: planned.call("allreduce", b, comm, attr, dtype="int64", **a).values.first()["value"]
    assert value(OpAttr()) == -4 and value(OpAttr(reduction_fn=Pairwise(np.minimum))) == -7 and value(OpAttr(reduction_fn=lambda v: F.max(F.abs(v)))) == 7
    assert planned.call("allgather", b, comm, OpAttr(), count=1).values.columns == ["buf_id", "idx", "value"]
    assert "src_rank" in planned.call("allgather", b, comm, OpAttr(vector_buf=True), count=1).values.columns
    assert planned.call("send", b, comm, OpAttr(group_id=5), peer=1).first()["group_id"] == 5
    kept = planned.call("reduce", b, comm, OpAttr(to_cache=True), root=1, dtype="int64")
    assert kept.storageLevel.useMemory and kept.first()["value"] == -4
    kept.unpersist()
    for wrong in (lambda: planned.call("scan", b, comm), lambda: planned.call("bcast", b, comm, OpAttr(vector_buf=True), root=0), lambda: planned.call("allgather", b, comm, OpAttr(reduction_fn=F.max), count=1)):
        with pytest.raises(InvalidArgument):
            wrong()


def test_fusion(spark):
    b = spark.range(8).select((F.col("id") % 2).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.floor(F.col("id") / 2).alias("idx"), F.col("id").alias("value"))
    calls = [Call(b, 4, "int64"), Call(b, 4, "int64"), Call(b, 4, "int64", "max"), Call(b, 1 << 20, "int64")]
    groups = fuse(calls, Communicator(2))
    assert [n for n, _ in groups] == [[0, 1], [2], [3]]
    rows = groups[0][1].values.collect()
    assert {(r["buf_id"], r["idx"]): r["value"] for r in rows} == {(c, i): 4 * i + 1 for c in (0, 1) for i in range(4)}
    assert [n for n, _ in fuse([calls[0]] * 3, Communicator(2), FusionLimits(count_threshold=2))] == [[0, 1], [2]]


def test_messages_in_order(spark):
    calls = spark.createDataFrame([(0, 1, 0, 30), (0, 1, 0, 10), (0, 2, 0, 20)], "src int, dst int, group_id int, at int")
    assert sorted((r["dst"], r["at"], r["seq"]) for r in p2p.in_order(calls, "at").collect()) == [(1, 10, 0), (1, 30, 1), (2, 20, 0)]
    with pytest.raises(InvalidArgument):
        p2p.Group().send(calls)


def test_hints():
    hints = selection.parse("long:0-8191; packed:8192-max; tree:100-200")
    assert [selection.choose(hints, n) for n in (0, 150, 8191, 8192, 1 << 40)] == ["long", "tree", "long", "packed", "packed"]
    assert selection.choose([], 5) == "long"
    for wrong in ("ring", "long:5", "long:9-3", "long:a-b"):
        with pytest.raises(InvalidArgument):
            selection.parse(wrong)


def test_packed_form_and_positions(spark):
    b = spark.range(3000).select(F.lit(0).alias("rank"), F.lit(0).alias("buf_id"), F.col("id").alias("idx"), (F.col("id") * 3).alias("value"))
    p = pack(b, 256)
    assert p.count() == 12
    assert sorted(map(tuple, unpack(p, 256).collect())) == sorted(map(tuple, b.collect()))
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("k"))
    out = positions(rows, ["g"], "k", block=10).collect()
    for g in range(3):
        keys = sorted(r["k"] for r in out if r["g"] == g)
        assert sorted((r["idx"], r["k"]) for r in out if r["g"] == g) == list(enumerate(keys))


def test_stream(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.floor(F.col("id") / 4).alias("idx"), F.col("id").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = []
    q = stream_allreduce(stream, Communicator(4), lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["rank"], r["idx"]): r["value"] for r in found} == {(k, i): 16 * i + 6 for k in range(4) for i in range(10)}


def test_fusion_by_settings(spark):
    b = spark.range(8).select((F.col("id") % 2).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.floor(F.col("id") / 2).alias("idx"), F.col("id").alias("value"))
    many = [Call(b, 4, "int64"), Call(b, 4, "int64"), Call(b, 4, "int64", "max")]
    for fusion, groups in ((True, [[0, 1], [2]]), (False, [[0], [1], [2]])):
        out = planned.calls(many, Communicator(2), Settings(fusion=fusion))
        assert [n for n, _ in out] == groups
        rows = {(r["buf_id"], r["idx"]): r["value"] for _, o in out for r in o.values.collect()}
        assert rows == {(c, i): 4 * i + 1 if c < 2 else 2 * i + 1 for c in range(3) for i in range(4)}


def test_attributes():
    attr = OpAttr().set("priority", 3).set("vector_buf", True)
    assert attr.get("priority") == 3 and attr.get("vector_buf") and attr.get("reduction_fn") is None
    assert attr.set("reduction_fn", F.max).get("reduction_fn") is F.max
    for name, value in (("priority", "3"), ("priority", True), ("none", 1), ("to_cache", 1)):
        with pytest.raises(InvalidArgument):
            attr.set(name, value)


def test_an_urgent_call_closes_groups(spark):
    b = spark.range(4).select(F.lit(0).alias("rank"), F.lit(0).alias("buf_id"), "id", F.col("id").alias("value")).withColumnRenamed("id", "idx")
    calls = [Call(b, 4, "int64"), Call(b, 4, "int64", attr=OpAttr(priority=9)), Call(b, 4, "int64"), Call(b, 4, "int64")]
    assert [n for n, _ in fuse(calls, Communicator(1))] == [[0, 1], [2, 3]]
    assert [n for n, _ in fuse(calls, Communicator(1), FusionLimits(check_urgent=False))] == [[0, 1, 2, 3]]
    assert FusionLimits.of(Settings(fusion_count_threshold=7)).count_threshold == 7


@pytest.mark.parametrize("hints", ["", "packed", "tree", "long:0-10;packed:11-max"])
@pytest.mark.parametrize("op", ["sum", "max", "prod"])
def test_strategies_change_the_plan_only(spark, hints, op):
    b = spark.range(90).select((F.col("id") % 3).cast("int").alias("rank"), F.lit(2).alias("buf_id"), F.floor(F.col("id") / 3).alias("idx"), (F.col("id") % 7 + 1).alias("value"))
    out = planned.allreduce(b, Communicator(3), 30, op, "int64", Settings(allreduce=hints, chunk_elements=8))
    want = {}
    for i in range(90):
        v, k = i % 7 + 1, i // 3
        want[k] = v if k not in want else want[k] + v if op == "sum" else max(want[k], v) if op == "max" else want[k] * v
    assert {r["idx"]: r["value"] for r in out.values.collect()} == want
    plan = out.values._jdf.queryExecution().toString()
    assert ("posexplode" in plan) == ("packed" in hints)
