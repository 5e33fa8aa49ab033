"""Fixed orders, pairwise reductions and custom types against plain folds; strategies on any buffers; plans."""

import functools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import REGISTRY, Registry
from meshframe.functions.pairwise import Pairwise, _combine, folded
from meshframe.operators import collectives as C
from meshframe.operators import p2p
from meshframe.operators.comm import Communicator
from meshframe.operators.unordered import agreed, fused, schedule, start_order
from meshframe.plans import catalog, planned
from meshframe.plans.settings import Settings
from meshframe.sources.buffers import pack, positions, positions_and_counts, unpack, write_bucketed
from meshframe.streaming.runtime import running_allreduce

BUFFERS = "rank int, buf_id int, idx long, value "


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cut(x):
    return float((np.array([x], np.float32).view(np.uint32) & 0xFFFF0000).view(np.float32)[0])


STEPS = {"bfloat16": lambda a, b: cut(np.float32(a) + np.float32(b)), "float16": lambda a, b: float(np.float16(np.float32(a) + np.float32(b))), "float32": lambda a, b: float(np.float32(a) + np.float32(b)), "float64": lambda a, b: a + b}


def plain_order(values, order, step, block=0, root=0):
    """values: a list by rank, None where there is none."""
    size = len(values)

    def both(a, b):
        return b if a is None else a if b is None else step(a, b)

    def tree(v):
        while len(v) > 1:
            v = [both(*v[i : i + 2]) if i + 1 < len(v) else v[i] for i in range(0, len(v), 2)]
        return v[0]

    if order == "binomial":
        return tree([values[(root + i) % size] for i in range(size)])
    if order == "doubling":
        whole = 1 << (size.bit_length() - 1)
        extra = size - whole
        return tree([both(values[2 * i], values[2 * i + 1]) for i in range(extra)] + values[2 * extra :])
    ranks = {"rank": range(size), "ring": [(block + 1 + k) % size for k in range(size)], "naive": [(block - k) % size for k in range(size)]}[order]
    return functools.reduce(both, [values[r] for r in ranks], None)


def sparse(size, n, dtype, seed=3):
    """Elements that not every rank has, of magnitudes for which the order counts."""
    rng = np.random.default_rng(seed)
    held = {}
    for r in range(size):
        for i in range(n):
            if rng.random() < 0.8:
                v = float(np.float32(rng.normal() * 10.0 ** rng.integers(-2, 4)))
                held[r, i] = cut(v) if dtype == "bfloat16" else float(np.float16(v)) if dtype == "float16" else v
    return held


@pytest.mark.parametrize("order", ["rank", "ring", "naive", "binomial", "doubling"])
@pytest.mark.parametrize("size,dtype", [(1, "float32"), (3, "bfloat16"), (4, "float16"), (6, "float32"), (8, "bfloat16"), (70, "float32")])
def test_orders(spark, order, size, dtype):
    n = 2 * size if size < 10 else size
    held = sparse(size, n, dtype)
    rows = [(r, 0, i, v) for (r, i), v in held.items()]
    found = []
    for parts in (1, 5):
        b = spark.createDataFrame(rows, BUFFERS + ("double" if dtype == "float64" else "float")).repartition(parts, F.rand(parts))
        out = C.allreduce(b, Communicator(size), "sum", dtype, order=order, count=n).values if order != "binomial" else C.reduce(b, Communicator(size), size // 2, "sum", dtype, order=order)
        found.append({r["idx"]: r["value"] for r in out.collect()})
    assert found[0] == found[1]
    for i in {i for _, i in held}:
        block = min(i // (n // size), size - 1)
        want = plain_order([held.get((r, i)) for r in range(size)], order, STEPS[dtype], block, size // 2)
        assert found[0][i] == want, (i, block)


def test_orders_differ_and_are_checked(spark):
    held = sparse(6, 30, "bfloat16")
    b = spark.createDataFrame([(r, 0, i, v) for (r, i), v in held.items()], BUFFERS + "float")
    seen = {o: {r["idx"]: r["value"] for r in C.reduce(b, Communicator(6), 2, "sum", "bfloat16", order=o, count=30).collect()} for o in ("rank", "ring", "naive", "binomial", "doubling")}
    assert len({tuple(sorted(v.items())) for v in seen.values()}) == 5
    with pytest.raises(InvalidArgument):
        C.allreduce(b, Communicator(6), "sum", "bfloat16", order="ring")
    with pytest.raises(InvalidArgument):
        C.allreduce(b, Communicator(6), "sum", "bfloat16", order="best")
    with pytest.raises(Exception, match="a rank is not below 3"):
        C.allreduce(b, Communicator(3), "sum", "bfloat16", strict=True).values.collect()


def test_reduce_scatter_rings_end_on_their_rank(spark):
    held = sparse(4, 12, "float32")
    b = spark.createDataFrame([(r, 0, i, v) for (r, i), v in held.items()], BUFFERS + "float")
    for r in C.reduce_scatter(b, Communicator(4), 3, "sum", "float32", order="ring").collect():
        i = 3 * r["rank"] + r["idx"]
        assert r["value"] == plain_order([held.get((k, i)) for k in range(4)], "ring", STEPS["float32"], r["rank"])


def test_a_rank_that_repeats_an_element_is_reduced_first(spark):
    rows = [(0, 0, 5, 1.0)] * 1000 + [(1, 0, 5, 0.5)] * 3 + [(70, 0, 5, 2.0)]
    b = spark.createDataFrame(rows, BUFFERS + "float")
    for size in (64, 71):
        assert C.allreduce(b.where(F.col("rank") < size), Communicator(size), "sum", "float32", strict=True).values.first()["value"] == 1001.5 + 2.0 * (size > 70)


# ---------------------------------------------------------------- pairwise


def test_pairwise_as_the_built_in_ones(spark):
    def largest(a, b):
        return np.where((np.abs(a) > np.abs(b)) | ((np.abs(a) == np.abs(b)) & (a > b)), a, b)

    b = spark.range(60_000).select((F.col("id") % 7).cast("int").alias("rank"), (F.col("id") % 2).cast("int").alias("buf_id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 900).alias("idx"), (F.hash("id") % 1000).cast("long").alias("value")).repartition(5)
    for fn, op in ((np.add, "sum"), (np.minimum, "min"), (np.maximum, "max")):
        got, want = (sorted(map(tuple, C.allreduce(b, Communicator(7), o, "int64").values.collect())) for o in (Pairwise(fn), op))
        assert got == want
    got = sorted(map(tuple, C.allreduce(b, Communicator(7), Pairwise(largest), "int64").values.collect()))
    want = b.groupBy("buf_id", "idx").agg(F.expr("max_by(value, struct(abs(value), value))").alias("value"))
    assert got == sorted(map(tuple, want.collect()))
    plan = plan_of(C.allreduce(b, Communicator(7), Pairwise(np.add), "int64").values)
    assert plan.count("MapInArrow") == 2 and "collect_list" not in plan


@pytest.mark.parametrize("dtype", ["int8", "uint8", "int32", "uint64", "float16", "float64", "bfloat16"])
def test_pairwise_of_types(spark, dtype):
    kind = REGISTRY[dtype].spark
    b = spark.range(120).select((F.col("id") % 4).cast("int").alias("rank"), F.lit(0).alias("buf_id"), (F.col("id") % 5).alias("idx"), (F.col("id") % 9).cast(kind).alias("value"))
    got, want = (sorted((r["idx"], float(r["value"])) for r in C.allreduce(b, Communicator(4), o, dtype).values.collect()) for o in (Pairwise(np.maximum), "max"))
    assert got == want
    assert C.allreduce(b, Communicator(4), Pairwise(np.maximum), dtype).values.schema["value"].dataType.simpleString() == kind


def test_pairwise_holds_few(spark):
    """A hot element of a task is one row behind it; what the function is given is never longer than a batch and what is held."""
    sizes = []

    def add(a, b, context):
        sizes.append(len(a))
        assert len(a) == len(b) == len(context.idx) and context.match_id == "m"
        return a + b

    keys = [np.zeros(10_000, np.int32), np.zeros(10_000, np.int64)]
    (buf, idx), total = folded(keys, np.arange(10_000), Pairwise(add, True, "m"))
    assert total.tolist() == [sum(range(10_000))] and len(idx) == 1 and max(sizes) == 5000
    b = spark.range(200_000).select(F.lit(0).alias("rank"), F.lit(0).alias("buf_id"), F.lit(0).cast("long").alias("idx"), F.col("id").alias("value")).repartition(6)
    assert C.reduce(b, Communicator(1), 0, Pairwise(np.add), "int64").first()["value"] == sum(range(200_000))
    with pytest.raises(Exception, match="the reduction gave"):
        C.reduce(b.limit(10), Communicator(1), 0, Pairwise(lambda a, b: a[:0]), "int64").collect()
    odd = spark.createDataFrame([(0, 0, 1, None), (0, None, 1, 5), (0, 0, 2, 7)], BUFFERS + "long")
    assert [tuple(r) for r in C.allreduce(odd, Communicator(1), Pairwise(np.add), "int64").values.collect()] == [(0, 2, 7)]
    assert C.allreduce(odd.limit(0), Communicator(1), Pairwise(np.add), "int64").values.count() == 0


def test_custom_types_are_reduced(spark):
    registry = Registry()
    kind = registry.register(12, [("value", ">i8"), ("at", ">i4")])

    def best(a, b):
        return np.where((a["value"] > b["value"]) | ((a["value"] == b["value"]) & (a["at"] < b["at"])), a, b)

    rows, want = [], {}
    for i in range(500):
        v, at = i * 37 % 101, i % 90
        rows.append((i % 3, 0, i % 11, np.array([(v, at)], kind.record).tobytes()))
        want[i % 11] = max(want.get(i % 11, (-1, 0)), (v, -at))
    b = spark.createDataFrame(rows, BUFFERS + "binary").repartition(4)
    got = {r["idx"]: np.frombuffer(r["value"], kind.record)[0].tolist() for r in C.allreduce(b, Communicator(3), Pairwise(best), kind).values.collect()}
    assert got == {k: (v, -at) for k, (v, at) in want.items()}
    # In several batches of a task, and with a function that gives records in another byte order.
    record = np.dtype(kind.record)
    made = [pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([0, 1]), pa.array([np.array([(v + i, v)], record).tobytes() for i in range(2)], pa.binary())], names=["buf_id", "idx", "value"]) for v in (3, 9, 5)]
    for in_order in (False, True):
        out = list(_combine(Pairwise(best), ["buf_id", "idx"], record, in_order)(iter(made[:1] * 2 if in_order else made)))
        assert [np.frombuffer(v, record)[0].tolist() for b in out for v in b.column("value").to_pylist()][-1] == ((4, 3) if in_order else (10, 9))
    for wrong in (lambda: registry.register(8, [("value", ">i4")]), lambda: C.allreduce(b, Communicator(3), "sum", kind), lambda: C.allreduce(b, Communicator(3), Pairwise(best), registry.register(12))):
        with pytest.raises(InvalidArgument):
            wrong()
    with pytest.raises(Exception, match="[Ff]ixed|width|length|Failed"):
        C.allreduce(spark.createDataFrame([(0, 0, 0, b"short")], BUFFERS + "binary"), Communicator(1), Pairwise(best), kind).values.collect()


# ---------------------------------------------------------------- strategies


def odd_buffers(spark, dtype):
    """Gaps, repeated elements, elements of one rank, null values, places at the ends of chunks."""
    kind = REGISTRY[dtype].spark
    rows = [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 2, 3), (0, 1, 0, 10), (1, 1, 2, 30), *[(r, 2, 5, r + 1) for r in range(3) for _ in range(4)], (2, 3, 7, 4), (1, 3, 8, 5), (0, 4, 100, 3), (1, 4, 100, None), (1, 4, 103, None)]
    rows += [(i % 3, 5, i * i % 40, i % 5 + 1) for i in range(60)]
    b = spark.createDataFrame(rows, BUFFERS + "long")
    return b.withColumn("value", (F.col("value") * F.lit(0.3 if REGISTRY[dtype].kind == "float" else 1)).cast(kind))


@pytest.mark.parametrize("dtype", ["int64", "int8", "uint64", "float16", "bfloat16", "float64"])
@pytest.mark.parametrize("op", ["sum", "max", "min", "prod"])
def test_strategies_agree_on_any_buffers(spark, dtype, op):
    b = odd_buffers(spark, dtype)
    seen = {}
    for hints in ("long", "packed", "tree"):
        out = planned.allreduce(b, Communicator(3), 200, op, dtype, Settings(allreduce=hints, chunk_elements=8, bf16="rne")).values
        seen[hints] = {(r["buf_id"], r["idx"]): None if r["value"] is None else float(r["value"]) for r in out.collect()}
    if op == "prod" and REGISTRY[dtype].kind != "float":  # nulls are no elements there
        seen["packed"] = {k: v for k, v in seen["packed"].items() if v is not None}
    for other in ("packed", "tree"):
        assert seen[other].keys() == seen["long"].keys()
        for k, v in seen["long"].items():
            assert seen[other][k] == v if dtype != "float64" or v is None else seen[other][k] == pytest.approx(v, rel=1e-14)


def test_a_callers_reduction_has_one_plan(spark):
    b = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 1.0), (1, 0, 0, 4.0)], BUFFERS + "double")
    for hints in ("long", "packed", "tree"):
        assert planned.allreduce(b, Communicator(2), 1, F.mean, "float64", Settings(allreduce=hints)).values.first()["value"] == 2.0
    with pytest.raises(InvalidArgument):
        C.allreduce_2d(b, Communicator(2), 2, F.mean, "float64")


def test_reduce_and_reduce_scatter_by_hints(spark):
    b = odd_buffers(spark, "int64").where("buf_id = 5")
    for hints in ("long", "packed", "tree"):
        s = Settings(reduce=hints, reduce_scatter=hints, chunk_elements=8)
        assert sorted(planned.reduce(b, Communicator(3), 2, 40, "sum", "int64", s).collect()) == sorted(C.reduce(b, Communicator(3), 2, "sum", "int64").collect())
        assert sorted(planned.reduce_scatter(b, Communicator(3), 13, "sum", "int64", s).collect()) == sorted(C.reduce_scatter(b, Communicator(3), 13, "sum", "int64").collect())
    with pytest.raises(InvalidArgument):
        Settings.read({"MESHFRAME_ALLGATHER": "packed"})


def test_packed_form_keeps_gaps(spark):
    b = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 3, None), (0, 0, 8, 1), (1, 0, 0, 2)], BUFFERS + "int")
    p = pack(b, 4)
    assert sorted((r["rank"], r["chunk_id"], r["values"], r["held"]) for r in p.collect()) == [(0, 0, [None, 5, None, None], [False, True, False, True]), (0, 2, [1], [True]), (1, 0, [2], [True])]
    assert sorted(map(str, unpack(p, 4).collect())) == sorted(map(str, b.collect()))
    with pytest.raises(Exception, match="an element twice"):
        pack(b.union(b), 4).collect()


# ---------------------------------------------------------------- lookup, levels, buckets, checks


def test_blocks_are_found_without_more_rows(spark):
    b = spark.range(1000).select((F.col("id") % 2).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.floor(F.col("id") / 2).alias("idx"), F.col("id").alias("value"))
    sizes = {(s, d): (d + s) % 3 * 7 for s in range(2) for d in range(40)}
    counts = spark.createDataFrame([(s, d, 0, n) for (s, d), n in sizes.items()], "src int, dst int, buf_id int, n long")
    out = C.split_blocks(b, counts, 40)
    want, at = [], [0, 0]
    for (s, d), n in sizes.items():
        want += [(s, d, 0, i, 2 * (at[s] + i) + s) for i in range(n)]
        at[s] += n
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = plan_of(out)
    assert "explode" not in plan.lower() and "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin [src" in plan
    raw = C.alltoallv_raw(b, Communicator(40), counts)
    assert raw.count() == len(want)


def test_levels_take_one_exchange(spark):
    b = spark.range(200).select((F.col("id") % 6).cast("int").alias("rank"), F.lit(0).alias("buf_id"), (F.col("id") % 7).alias("idx"), F.col("id").alias("value"))
    out = C.allreduce_levels(b, 2)
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r["level"], r["node"], r["rank"], r["idx"]): r["value"] for r in out.collect()}
    for i in range(7):
        ids = [k for k in range(200) if k % 7 == i]
        assert got["world", None, None, i] == sum(ids)
        for node in range(3):
            assert got["node", node, None, i] == sum(k for k in ids if k % 6 // 2 == node)
        for r in range(6):
            assert got["rank", r // 2, r, i] == sum(k for k in ids if k % 6 == r)
    assert len(got) == 7 * 10


@pytest.mark.parametrize("op,dtype", [("sum", "int64"), ("sum", "int8"), ("min", "float64"), ("max", "int32"), ("prod", "float64"), ("prod", "int64")])
@pytest.mark.parametrize("per_node", [1, 2, 3, 9])
def test_levels_of_few_ranks_are_those_of_grouping_sets(spark, op, dtype, per_node):
    value = F.when(F.col("id") % 11 > 0, F.col("id") % 13 - 6).cast(REGISTRY[dtype].spark)  # nulls, and elements that ranks lack
    value = F.when(F.col("id") % 17 == 0, F.lit("NaN").cast("double")).otherwise(value) if dtype == "float64" else value
    b = spark.range(60).select((F.col("id") % 5).cast("int").alias("rank"), F.lit(0).alias("buf_id"), (F.col("id") * F.col("id") % 31).alias("idx"), value.alias("value"))
    few, sets = (C.allreduce_levels(b, per_node, op, dtype, comm=comm) for comm in (Communicator(5), None))
    assert few.dtypes == sets.dtypes
    assert sorted(map(str, few.collect())) == sorted(map(str, sets.collect()))


def test_levels_wrap_as_longs_do(spark):
    ends = [-(1 << 63), (1 << 63) - 1, -1, 1 << 32, -(1 << 32) - 1, None]
    b = spark.createDataFrame([(r, 0, i, ends[(r * i + k) % 6]) for r in range(4) for i in range(9) for k in range(5) if r + i != 7], BUFFERS + "long")
    few, sets = (C.allreduce_levels(b, 2, comm=comm) for comm in (Communicator(4), None))
    assert sorted(map(str, few.collect())) == sorted(map(str, sets.collect()))
    assert "shiftright" in plan_of(few)  # halves of longs, no decimals before the exchange


def test_levels_of_few_ranks_copy_no_rows(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["allreduce_levels"](spark, sf_dir))
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
    b = spark.range(9).select(F.col("id").cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.lit(0).cast("long").alias("idx"), F.col("id").alias("value"))
    with pytest.raises(Exception, match="not one of 8 ranks: 8"):
        C.allreduce_levels(b, 2, comm=Communicator(8)).collect()


def test_bucketed_buffers_need_no_exchange(spark):
    b = spark.range(500).select((F.col("id") % 4).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.floor(F.col("id") / 4).alias("idx"), F.col("id").alias("value"))
    stored = write_bucketed(b, "buffers_of_a_test", 4)
    out = C.allreduce(stored, Communicator(4), "sum", "int64").values
    plan = plan_of(out)
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert {r["idx"]: r["value"] for r in out.collect()} == {i: 16 * i + 6 for i in range(125)}
    spark.sql("DROP TABLE buffers_of_a_test")


def test_checks_cost_no_action(spark):
    b = spark.range(9).select(F.lit(0).alias("rank"), F.lit(0).alias("buf_id"), F.col("id").alias("idx"), F.col("id").alias("value"))
    counts = spark.createDataFrame([(0, 0, 9)], "rank int, buf_id int, n long")
    spark.sparkContext.setJobGroup("planning", "")
    out = C.allgatherv(b, Communicator(2), counts, check=True)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext._jsc.clearJobGroup()
    assert out.values.count() == 9


def test_messages_of_another_length(spark):
    b = spark.createDataFrame([(0, 0, i, i) for i in range(3)], BUFFERS + "int")
    receive = lambda n: spark.createDataFrame([(1, 0, 0, 0, n)], "rank int, from_rank int, group_id int, seq int, n long")
    assert p2p.recv(p2p.send(b, 1), receive(3)).count() == 3
    for n in (2, 4):
        with pytest.raises(Exception, match=f"rank 0 sends 3 elements to rank 1, which has room for {n}"):
            p2p.recv(p2p.send(b, 1), receive(n)).count()


# ---------------------------------------------------------------- order and positions


def test_positions_of_any_order(spark):
    """Sparse and repeated values, one value in a third of all rows, nulls, floats."""
    rows = [(i % 3, (i * 2_654_435_761) % 2**40, i) for i in range(400)] + [(0, 5, i) for i in range(400, 600)] + [(1, None, 700), (1, None, 701)]
    df = spark.createDataFrame(rows, "g int, k long, v int")
    for block in (None, 50, 10_000):
        out, counts = positions_and_counts(df, ["g"], "k", block)
        found = out.collect()
        for g in range(3):
            own = sorted((r["idx"], r["k"] if r["k"] is not None else -1) for r in found if r["g"] == g)
            assert [i for i, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r["g"]: r["n"] for r in counts.collect()} == {g: sum(r[0] == g for r in rows) for g in range(3)}
    again = {(r["g"], r["v"]): r["idx"] for r in positions(df.repartition(7), ["g"], "k", 50).collect()}
    assert again == {(r["g"], r["v"]): r["idx"] for r in positions(df, ["g"], "k", 50).collect()}
    assert positions(df.limit(0), ["g"], "k").count() == 0


def test_unordered_calls_as_tables(spark):
    issued = {0: ["a", "b", "a", "c"], 1: ["b", "a", "c", "a"], 2: ["a", "a", "b", "d"]}
    calls = spark.createDataFrame([(r, m, 10 * i) for r, ids in issued.items() for i, m in enumerate(ids)], "rank int, match_id string, at int")
    got = {(r["match_id"], r["occurrence"]): (r["position"], r["missing"]) for r in agreed(calls, Communicator(3)).collect()}
    assert got == {("a", 0): (0, []), ("b", 0): (1, []), ("a", 1): (2, []), ("c", 0): (None, [2]), ("d", 0): (None, [0, 1])}
    order = [(r["rank"], r["match_id"], r["at"]) for r in schedule(calls, Communicator(3)).orderBy("rank", "position").collect()]
    assert order == [(0, "a", 0), (0, "b", 10), (0, "a", 20), (1, "a", 10), (1, "b", 0), (1, "a", 30), (2, "a", 0), (2, "b", 20), (2, "a", 10)]
    assert agreed(calls.limit(0), Communicator(3)).count() == 0


def test_start_order_and_fusion_as_tables(spark):
    calls = spark.createDataFrame([(i, p) for i, p in enumerate((1, 5, 0, 5))], "call long, priority int")
    for mode, want in (("direct", [1, 3, 0, 2]), ("none", [0, 1, 2, 3]), ("lifo", [3, 2, 1, 0])):
        assert [r["call"] for r in start_order(calls, mode).orderBy("place").collect()] == want
    calls = spark.createDataFrame([(0, "s", 16), (1, "t", 16), (2, "s", 1 << 20), (3, "s", 8), (4, "s", 8), (5, "t", 9)], "call long, kind string, bytes long")
    assert {r["call"]: r["fused_into"] for r in fused(calls, count_threshold=2).collect()} == {0: 0, 3: 0, 4: 4, 1: 1, 5: 1, 2: 2}


# ---------------------------------------------------------------- streams


def test_running_reductions(spark, tmp_path):
    """Batches that come late or twice: what the windows come to is what a batch over the rows in time gives."""
    schema = "at timestamp, ident long, rank int, buf_id int, idx long, value long"

    def rows(minute, first, n=20):
        return spark.range(first, first + n).select(F.to_timestamp(F.lit(f"2024-01-01 00:{minute:02d}:30")).alias("at"), F.col("id").alias("ident"), (F.col("id") % 3).cast("int").alias("rank"), F.lit(0).alias("buf_id"), (F.col("id") % 4).alias("idx"), F.col("id").alias("value"))

    batches = [rows(1, 0), rows(1, 0).union(rows(2, 100)), rows(6, 200), rows(1, 900, 5), rows(5, 300), rows(20, 400)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = running_allreduce(stream, "at", "1 minute", "2 minutes", ident="ident")
    q = None
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            q = out.writeStream.format("memory").queryName("running").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    found = {(r["start"].minute, r["idx"]): r["value"] for r in spark.table("running").collect()}
    in_time = batches[0].union(rows(2, 100)).union(batches[2]).union(batches[4])  # the fourth comes after its window was closed
    want = {(r["m"], r["idx"]): r["v"] for r in in_time.groupBy(F.minute("at").alias("m"), "idx").agg(F.sum("value").alias("v")).collect()}
    assert found == want
    with pytest.raises(Exception):
        running_allreduce(stream, "at", "1 minute", "2 minutes", "prod")
