"""Collectives against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import BUILT_IN, REGISTRY, Registry, round_bf16, times, truncate_bf16, wrap
from meshframe.operators import collectives as C
from meshframe.operators.comm import Communicator, topology_from
from meshframe.sources.buffers import write


def buffers(spark, size, n, value, bufs=1):
    """value: a column of rank r, buffer b and index i."""
    rows = spark.range(size * bufs * n)
    rows = rows.select(F.floor(F.col("id") / (bufs * n)).cast("int").alias("rank"), (F.floor(F.col("id") / max(n, 1)) % bufs).cast("int").alias("buf_id"), (F.col("id") % max(n, 1)).alias("idx"))
    return rows.withColumn("value", value)


def got(df):
    return sorted(map(tuple, df.select("rank", "buf_id", "idx", "value").collect()))


def send():
    return F.col("rank") + F.col("buf_id")


@pytest.mark.parametrize("size", [1, 2, 3, 8])
@pytest.mark.parametrize("n", [0, 1, 17])
def test_allreduce(spark, size, n):
    for op, want in (("sum", lambda b: size * (size - 1) // 2 + size * b), ("min", lambda b: b), ("max", lambda b: size - 1 + b)):
        out = got(C.allreduce(buffers(spark, size, n, send(), 2), Communicator(size), op, "int32").expand())
        assert out == [(r, b, i, want(b)) for r in range(size) for b in (0, 1) for i in range(n)]


@pytest.mark.parametrize("dtype", sorted(BUILT_IN))
def test_product_of_every_type(spark, dtype):
    size = 4
    value = (send() + 1).cast(REGISTRY[dtype].spark)
    out = C.allreduce(buffers(spark, size, 3, value, 2), Communicator(size), "prod", dtype).expand().collect()
    assert len(out) == size * 6
    for r in out:
        assert int(r["value"]) == math.prod(q + r["buf_id"] + 1 for q in range(size))


@pytest.mark.parametrize("dtype,bits,signed", [("int8", 8, True), ("uint8", 8, False), ("int16", 16, True), ("uint16", 16, False), ("int32", 32, True), ("uint32", 32, False), ("int64", 64, True), ("uint64", 64, False)])
def test_integers_wrap(spark, dtype, bits, signed):
    top = (1 << (bits - 1)) - 1 if signed else (1 << bits) - 1
    value = F.lit(str(top)).cast(REGISTRY[dtype].spark)
    for op, exact in (("sum", 3 * top), ("prod", top**3)):
        want = exact % (1 << bits)
        want -= (1 << bits) if signed and want >> (bits - 1) else 0
        (row,) = C.reduce(buffers(spark, 3, 1, value), Communicator(3), 0, op, dtype).collect()
        assert int(row["value"]) == want


def test_wide_product_and_wrap(spark):
    a, b = (1 << 64) - 3, (1 << 63) + 12345
    col = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    row = spark.range(1).select(times(col(a), col(b), 64).alias("p"), wrap(F.lit(-129), REGISTRY["int8"]).alias("w")).first()
    assert int(row["p"]) == a * b % (1 << 64) and row["w"] == 127


def test_bf16(spark):
    import numpy as np

    values = [0.1, -1.7, 3.14159, 1e30, 0.0, 1.00390625, 1.01171875]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", truncate_bf16(F.col("v")).alias("t"), round_bf16(F.col("v").cast("float")).alias("r")).collect()
    for row in rows:
        bits = np.array([row["v"]], np.float32).view(np.uint32)
        assert row["t"] == float((bits & 0xFFFF0000).view(np.float32)[0])
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000
        assert row["r"] == float(rounded.astype(np.uint32).view(np.float32)[0])


def test_strict_bf16_folds_in_rank_order(spark):
    import numpy as np

    cut = lambda x: (np.array([x], np.float32).view(np.uint32) & 0xFFFF0000).view(np.float32)[0]
    value = truncate_bf16(F.lit(0.1) * (F.col("rank") + 1))
    (row,) = C.reduce(buffers(spark, 8, 1, value), Communicator(8), 3, "sum", "bfloat16", strict=True).collect()
    total = cut(0.1)
    for r in range(1, 8):
        total = cut(np.float32(total) + cut(0.1 * (r + 1)))
    assert row["rank"] == 3 and row["value"] == float(total)


@pytest.mark.parametrize("dtype,eps", [("float16", 2 * 9.77e-4), ("bfloat16", 2 * 7.81e-3), ("float32", 1.19e-7), ("float64", 2.22e-16)])
def test_float_sums_within_the_bound(spark, dtype, eps):
    size, (c1, c2) = 4, {"bfloat16": (0.5, 1), "float16": (0.01, 0.01)}.get(dtype, (1, 1))
    value = (c1 * F.col("rank") + c2 * (F.col("buf_id") + 1)).cast(REGISTRY[dtype].spark)
    g = math.log2(size) * eps / (1 - math.log2(size) * eps)
    for r in C.allreduce(buffers(spark, size, 2, value, 2), Communicator(size), "sum", dtype).expand().collect():
        want = size * (c1 * (size - 1) / 2 + c2 * (r["buf_id"] + 1))
        assert abs(r["value"] - want) <= g * want


def unique():
    return 1_000_000 * F.col("rank") + F.col("idx")


@pytest.mark.parametrize("size,n", [(1, 5), (3, 4), (4, 17)])
def test_moves(spark, size, n):
    comm = Communicator(size)
    b = buffers(spark, size, n, unique())
    assert got(C.allgather(b, comm, n).expand()) == [(r, 0, s * n + i, 1_000_000 * s + i) for r in range(size) for s in range(size) for i in range(n)]
    assert got(C.broadcast(b, comm, size - 1).expand()) == [(r, 0, i, 1_000_000 * (size - 1) + i) for r in range(size) for i in range(n)]
    wide = buffers(spark, size, size * n, unique())
    assert got(C.alltoall(wide, comm, n)) == [(r, 0, s * n + i, 1_000_000 * s + r * n + i) for r in range(size) for s in range(size) for i in range(n)]
    total = 1_000_000 * size * (size - 1) // 2
    assert got(C.reduce_scatter(wide, comm, n, "sum", "int64")) == [(r, 0, i, total + size * (r * n + i)) for r in range(size) for i in range(n)]


def test_allgatherv_with_uneven_and_empty_ranks(spark):
    counts = [3, 0, 5, 1]
    rows = [(r, 0, i, 100 * r + i) for r, n in enumerate(counts) for i in range(n)]
    b = spark.createDataFrame(rows, "rank int, buf_id int, idx bigint, value int")
    flat = [v for *_, v in rows]
    assert got(C.allgatherv(b, Communicator(4)).expand()) == [(r, 0, i, v) for r in range(4) for i, v in enumerate(flat)]
    wrong = spark.createDataFrame([(0, 0, 2), (2, 0, 5), (3, 0, 1)], "rank int, buf_id int, n bigint")
    with pytest.raises(Exception, match="rank 0: 3 elements sent, 2 expected"):
        C.allgatherv(b, Communicator(4), wrong, check=True).values.count()


def test_alltoallv_and_split_blocks(spark):
    size = 3
    n = {(s, d): (s + 2 * d) % 4 for s in range(size) for d in range(size)}
    send, messages = [], []
    for s in range(size):
        at = 0
        for d in range(size):
            for i in range(n[s, d]):
                send.append((s, 0, at, 10_000 * s + 100 * d + i))
                messages.append((s, d, 0, i, 10_000 * s + 100 * d + i))
                at += 1
    counts = spark.createDataFrame([(s, d, 0, k) for (s, d), k in n.items()], "src int, dst int, buf_id int, n bigint")
    blocks = C.split_blocks(spark.createDataFrame(send, "rank int, buf_id int, idx bigint, value int"), counts)
    assert sorted(map(tuple, blocks.collect())) == sorted(messages)
    want = []
    for d in range(size):
        flat = [10_000 * s + 100 * d + i for s in range(size) for i in range(n[s, d])]
        want += [(d, 0, i, v) for i, v in enumerate(flat)]
    assert got(C.alltoallv(blocks, Communicator(size))) == want


def test_arguments():
    comm = Communicator(4)
    for call in (lambda: Communicator(0), lambda: comm.check_root(4), lambda: REGISTRY["int128"], lambda: comm.split({0: 1})):
        with pytest.raises(InvalidArgument):
            call()


def test_split_and_translation():
    parts = Communicator(6).split({r: r % 2 for r in range(6)}, {0: 9})
    assert parts[0].members == (2, 4, 0) and parts[1].members == (1, 3, 5)
    assert parts[0].local_rank(0) == 2 and parts[0].global_rank(0) == 2


def test_custom_reductions(spark):
    import pandas as pd
    from pyspark.sql.types import LongType

    @F.pandas_udf(LongType())
    def largest(values: pd.Series) -> int:
        return int(values.abs().max())

    b = buffers(spark, 3, 2, (F.col("idx") - 5 * F.col("rank")).cast("bigint"))
    for op in (largest, lambda v: F.max(F.abs(v))):
        out = C.allreduce(b, Communicator(3), op, "int64").values.collect()
        assert {r["idx"]: r["value"] for r in out} == {0: 10, 1: 9}


def test_custom_types():
    registry = Registry()
    t = registry.register(16)
    assert registry.size(t.name) == 16 and t.spark == "binary"
    registry.deregister(t)
    with pytest.raises(InvalidArgument):
        registry[t.name]


def test_allreduce_plan_is_partial_then_final(spark):
    b = buffers(spark, 4, 100, send())
    plan = C.allreduce(b, Communicator(4), "sum", "int64").expand()._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("op", ["sum", "prod", "min", "max"])
@pytest.mark.parametrize("dtype", ["int32", "float32", "float16", "bfloat16"])
def test_grid_of_the_large_count_and_four_buffers(spark, op, dtype):
    """Counts of 32,771 and four buffers, by the closed forms: rank and buffer make the value, place does not."""
    n, size = 32_771, 4
    step = {"bfloat16": (0.5, 1.0), "float16": (0.01, 0.01)}.get(dtype, (1, 1))
    one = 1 if op == "prod" else 0
    value = F.col("rank") * step[0] + F.col("buf_id") * step[1] + one
    rows = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("rank"), F.col("id").alias("idx"))
    rows = rows.select("rank", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("buf_id"), "idx")
    out = C.allreduce(rows.withColumn("value", value.cast("int" if dtype == "int32" else "float")), Communicator(size), op, dtype).expand()
    got = out.groupBy("rank", "buf_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    assert len(got) == 4 * size
    eps = {"bfloat16": 2 * 7.81e-3, "float16": 2 * 9.77e-4}.get(dtype, 1.2e-7)
    for r in got:
        own = [k * step[0] + r["buf_id"] * step[1] + one for k in range(size)]
        want = {"sum": sum(own), "prod": np.prod(own), "min": min(own), "max": max(own)}[op]
        bound = 2 * eps / (1 - 2 * eps) * abs(want) + 1e-9
        assert r["n"] == n and r["lo"] == r["hi"] and abs(r["lo"] - want) <= bound


def test_strict_float16_folds_in_rank_order(spark):
    values = [1000.3, 0.27, -999.9, 0.013, 65000.0]
    rows = [(r, 0, 0, float(np.float16(v))) for r, v in enumerate(values)]
    b = spark.createDataFrame(rows, "rank int, buf_id int, idx long, value float")
    want = np.float16(values[0])
    for v in values[1:]:
        want = np.float16(np.float32(want) + np.float32(np.float16(v)))
    assert C.allreduce(b, Communicator(5), "sum", "float16", strict=True).values.first()["value"] == float(want)


def test_products_of_a_hot_element(spark):
    """Half of all rows have one index; products wrap at 64 bits."""
    b = spark.range(40_000).select((F.col("id") % 4).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("idx"), (F.col("id") % 5 * 2 + 1).alias("value"))
    got = {r["idx"]: r["value"] for r in C.allreduce(b, Communicator(4), "prod", "int64").values.collect()}
    want = 1
    for i in range(40_000):
        if i % 2 == 0 or i == 7:
            want = want * (i % 5 * 2 + 1) % 2**64
    assert got[7] == (want + 2**63) % 2**64 - 2**63 and len(got) == 20_000


def test_counts_are_checked(spark):
    sends = spark.createDataFrame([(0, 1, 0, 3), (1, 0, 0, 2)], "src int, dst int, buf_id int, n long")
    check = lambda counts: C.checked_counts(counts, sends, ["src", "dst", "buf_id"], C._differ)
    assert sorted(map(tuple, check(sends).collect())) == sorted(map(tuple, sends.collect()))
    for wrong in ([(0, 1, 0, 3)], [(0, 1, 0, 3), (1, 0, 0, 1)], [(0, 1, 0, 3), (1, 0, 0, 2), (1, 1, 0, 1)]):
        with pytest.raises(Exception, match="which expects"):
            check(spark.createDataFrame(wrong, sends.schema)).count()
    m = spark.createDataFrame([(0, 1, 0, i, 10 + i) for i in range(3)], "src int, dst int, buf_id int, idx long, value int")
    assert C.alltoallv(m, Communicator(2), recv_counts=sends.limit(1)).count() == 3
    with pytest.raises(Exception, match="rank 1 sends 0 elements to rank 0, which expects 2"):
        C.alltoallv(m, Communicator(2), recv_counts=sends).collect()


def test_barrier_and_handles(spark):
    C.barrier(spark, Communicator(2))
    with pytest.raises(InvalidArgument):
        C.barrier(spark, Communicator(10_000))
    h = Communicator(3).handle(2, device="d")
    assert (h.rank, h.size, h.device, h.context) == (2, 3, "d", None)
    with pytest.raises(InvalidArgument):
        Communicator(3).handle(3)


def test_colours_from_an_environment(spark):
    ranks = Communicator(4).table(spark)
    out = topology_from(ranks, {"card": "0,0,1,1", "plane": "0, 1,0,1"})
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    for bad in ("0,1", "a,b,c,d", ""):
        with pytest.raises(InvalidArgument):
            topology_from(ranks, {"card": bad})


def test_sink(spark, tmp_path):
    b = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 2)], "rank int, buf_id int, idx long, value int")
    write(b, str(tmp_path / "out"))
    write(b, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
