"""The registered queries of the collective engine, and their SQL.

Four ranks; rank and idx come from keys by arithmetic, so buffers are built without a shuffle. Money and floats are
taken in fixed point, so that sums do not depend on their order.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.datatypes import REGISTRY, Registry, round_fp16, truncate_bf16, wrap
from meshframe.functions.pairwise import Pairwise
from meshframe.operators import collectives as C
from meshframe.operators import p2p
from meshframe.operators.comm import Communicator, split_table, topology
from meshframe.operators.unordered import agreed, fused, start_order
from meshframe.plans import planned
from meshframe.plans.settings import Settings
from meshframe.sources.buffers import arrays_to_buffers, positions, positions_and_counts, read, to_buffers, write_bucketed
from meshframe.streaming.runtime import Call, fuse

P = 4
WORLD = Communicator(P)
QUERIES: dict = {}
SQL: dict[str, str] = {}
_RANKS = f"(SELECT range::INT AS rank FROM range({P}))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a part's price in cents, at the order's rank."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return to_buffers(rows, F.col("l_orderkey") % P, F.col("l_partkey"), F.round(F.col("l_extendedprice") * 100).cast("bigint"))


CENTS = f"(SELECT (l_orderkey % {P})::INT AS rank, 0 AS buf_id, l_partkey AS idx, round(l_extendedprice * 100)::BIGINT AS value FROM lineitem)"


def micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in millionths; vector v is the (v div 4)-th of rank v mod 4."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    long = arrays_to_buffers(rows, F.col("vec_id") % P, F.floor(F.col("vec_id") / P), F.col("embedding"), 64)
    return long.withColumn("value", F.round(F.col("value").cast("double") * 1_000_000).cast("bigint"))


_VECTORS = "(SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"
MICRO = f"(SELECT (vec_id % {P})::INT AS rank, 0 AS buf_id, (vec_id // {P}) * 64 + pos AS idx, round(x::DOUBLE * 1000000)::BIGINT AS value FROM {_VECTORS})"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return to_buffers(rows, F.col("o_orderkey") % P, F.floor(F.col("o_orderkey") / P), F.round(F.col("o_totalprice") * 100).cast("bigint"))


ORDERS = f"(SELECT (o_orderkey % {P})::INT AS rank, 0 AS buf_id, o_orderkey // {P} AS idx, round(o_totalprice * 100)::BIGINT AS value FROM orders)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events from the user's rank to the event's rank, positions in each pair following event_id; and (src, dst, buf_id, n)."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    rows = rows.select("event_id", (F.col("user_id") % P).cast("int").alias("src"), (F.col("event_id") % P).cast("int").alias("dst"), F.lit(0).alias("buf_id"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    placed, counts = positions_and_counts(rows, ["src", "dst"], "event_id")
    return placed.select("src", "dst", "buf_id", "idx", "value"), counts.select("src", "dst", F.lit(0).alias("buf_id"), "n")


MESSAGES = f"""(SELECT src, dst, 0 AS buf_id, row_number() OVER (PARTITION BY src, dst ORDER BY event_id) - 1 AS idx, value
FROM (SELECT event_id, (user_id % {P})::INT AS src, (event_id % {P})::INT AS dst, round(value * 100)::BIGINT AS value FROM events))"""


# ---------------------------------------------------------------- allreduce, reduce, reduce_scatter

for _op in ("sum", "min", "max"):
    query(f"allreduce_{_op}", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, {_op}(value)::BIGINT AS value FROM {CENTS} GROUP BY ALL), {_RANKS}")(
        lambda spark, d, op=_op: C.allreduce(cents(spark, d), WORLD, op, "int64").expand()
    )
    query(f"reduce_scatter_{_op}", f"SELECT (idx // 16)::INT AS rank, buf_id, idx % 16 AS idx, {_op}(value)::BIGINT AS value FROM (SELECT buf_id, idx % 64 AS idx, value FROM {MICRO}) GROUP BY ALL")(
        lambda spark, d, op=_op: C.reduce_scatter(micro(spark, d).withColumn("idx", F.col("idx") % 64), WORLD, 16, op, "int64")
    )
    for _root in (0, 3):
        query(f"reduce_root{_root}_{_op}", f"SELECT {_root} AS rank, buf_id, idx, {_op}(value)::BIGINT AS value FROM {CENTS} GROUP BY ALL")(
            lambda spark, d, op=_op, root=_root: C.reduce(cents(spark, d), WORLD, root, op, "int64")
        )


@query("allreduce_embeddings", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM {MICRO} GROUP BY ALL), {_RANKS}")
def allreduce_embeddings(spark, d):
    return C.allreduce(micro(spark, d), WORLD, "sum", "int64").expand()


def _small(spark, d):
    rows = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return to_buffers(rows, F.col("n_nationkey") % P, F.col("n_regionkey"), (F.col("n_nationkey") % 5 + 1).cast("int"))


_SMALL = f"(SELECT (n_nationkey % {P})::INT AS rank, 0 AS buf_id, n_regionkey::BIGINT AS idx, n_nationkey % 5 + 1 AS value FROM nation)"


@query("allreduce_prod", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, product(value)::INT AS value FROM {_SMALL} GROUP BY ALL), {_RANKS}")
def allreduce_prod(spark, d):
    return C.allreduce(_small(spark, d), WORLD, "prod", "int32").expand()


@query("allreduce_custom", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, max(abs(value))::BIGINT AS value FROM {MICRO} GROUP BY ALL), {_RANKS}")
def allreduce_custom(spark, d):
    """A user's reduction, here the largest magnitude. A grouped pandas UDF would do too, at a call for each group."""
    return C.allreduce(micro(spark, d), WORLD, lambda v: F.max(F.abs(v)), "int64").expand()


@query("allreduce_2d", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM {MICRO} GROUP BY ALL), {_RANKS}")
def allreduce_2d(spark, d):
    return C.allreduce_2d(micro(spark, d), WORLD, 2, "sum", "int64").expand()


@query("allreduce_packed", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM {MICRO} GROUP BY ALL), {_RANKS}")
def allreduce_packed(spark, d):
    """Arrays as they are read, reduced place by place: a vector is a chunk, and nothing is exploded before the exchange."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    values = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint"))
    packed = rows.select((F.col("vec_id") % P).cast("int").alias("rank"), F.lit(0).alias("buf_id"), F.floor(F.col("vec_id") / P).alias("chunk_id"), values.alias("values"))
    return planned.allreduce(packed, WORLD, 64, "sum", "int64", Settings(chunk_elements=64), packed=True).expand()


def _width(spark, d) -> int:
    """Elements of a rank's vector: parts, from the table's counts."""
    return read(spark, d, "part").count()


@query("allreduce_hinted", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM {CENTS} GROUP BY ALL), {_RANKS}")
def allreduce_hinted(spark, d):
    """In two levels, as a hint asks for sums of more than a kilobyte."""
    return planned.allreduce(cents(spark, d), WORLD, _width(spark, d), "sum", "int64", Settings(allreduce="long:0-1023;tree:1024-max")).expand()


@query("allreduce_packed_sparse", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM {CENTS} GROUP BY ALL), {_RANKS}")
def allreduce_packed_sparse(spark, d):
    """Long buffers, in which ranks lack elements and repeat others, by way of chunks."""
    return planned.allreduce(cents(spark, d), WORLD, _width(spark, d), "sum", "int64", Settings(allreduce="packed", chunk_elements=64)).expand()


_WRAP8 = "((sum(value) + 128) % 256 + 256) % 256 - 128"


@query("allreduce_int8_wrap", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, ({_WRAP8})::TINYINT AS value FROM (SELECT buf_id, idx, ((value + 128) % 256 + 256) % 256 - 128 AS value FROM {CENTS}) GROUP BY ALL), {_RANKS}")
def allreduce_int8_wrap(spark, d):
    buffers = cents(spark, d).withColumn("value", wrap(F.col("value"), REGISTRY["int8"]))
    return C.allreduce(buffers, WORLD, "sum", "int8").expand()


@query(
    "allreduce_uint64_wrap",
    f"""SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, (sum(value::HUGEINT * 1000000007 + 18446744073709000000::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS value
    FROM {CENTS} GROUP BY ALL), {_RANKS}""",
)
def allreduce_uint64_wrap(spark, d):
    value = (F.col("value").cast("decimal(20,0)") * F.lit(1_000_000_007) + F.lit("18446744073709000000").cast("decimal(20,0)")).cast("decimal(38,0)")
    out = C.allreduce(cents(spark, d).withColumn("value", value), WORLD, "sum", "uint64").expand()
    return out.withColumn("value", F.col("value").cast("string"))


def _sql_place(x: str, digits: int, least: int) -> str:
    """The last binary place that is kept, in SQL: a power of two found by its logarithm and put right by comparison."""
    near = f"pow(2.0::DOUBLE, floor(log2(abs({x}))))"
    power = f"CASE WHEN {near} > abs({x}) THEN {near} / 2 WHEN {near} * 2 <= abs({x}) THEN {near} * 2 ELSE {near} END"
    return f"greatest(({power}) * pow(2.0::DOUBLE, {1 - digits}), pow(2.0::DOUBLE, {least}))"


def _sql_truncated(x: str) -> str:
    """A DOUBLE without what is below 8 binary digits, as FLOAT."""
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} - ({x} % ({_sql_place(x, 8, -133)})) END)::FLOAT"


def _sql_half(x: str) -> str:
    """A DOUBLE to the nearest of 11 binary digits, ties to even, as FLOAT."""
    place = _sql_place(x, 11, -24)
    rest, low = f"({x} % ({place}))", f"({x} - ({x} % ({place})))"
    up = f"abs({rest}) * 2 > {place} OR (abs({rest}) * 2 = {place} AND abs({low} / {place}) % 2 = 1)"
    return f"(CASE WHEN {x} = 0 THEN 0.0 WHEN {up} THEN {low} + sign({x}) * {place} ELSE {low} END)::FLOAT"


_FLOATS = f"(SELECT (vec_id % {P})::INT AS rank, 0 AS buf_id, (vec_id // {P}) * 64 + pos AS idx, x::DOUBLE AS x FROM {_VECTORS})"
_BF16 = f"SELECT rank, buf_id, idx, {_sql_truncated('x')} AS value FROM {_FLOATS}"
_FOLD = f"SELECT buf_id, idx, max(value) FILTER (rank = 0) AS s, {', '.join(f'max(value) FILTER (rank = {k}) AS v{k}' for k in range(1, P))} FROM ({_BF16}) GROUP BY buf_id, idx"
for _k in range(1, P):
    _sum = f"(s + v{_k})::FLOAT::DOUBLE"
    _FOLD = f"SELECT buf_id, idx, CASE WHEN v{_k} IS NULL THEN s WHEN s IS NULL THEN v{_k} ELSE {_sql_truncated(_sum)} END AS s, * EXCLUDE (buf_id, idx, s) FROM ({_FOLD})"


def _vectors(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    return arrays_to_buffers(rows, F.col("vec_id") % P, F.floor(F.col("vec_id") / P), F.col("embedding"), 64)


@query("allreduce_bf16", f"SELECT rank, buf_id, idx, s AS value FROM ({_FOLD}), {_RANKS}")
def allreduce_bf16(spark, d):
    """Embeddings as bfloat16, folded in the order of ranks with truncation at each step."""
    return C.allreduce(_vectors(spark, d).withColumn("value", truncate_bf16(F.col("value"))), WORLD, "sum", "bfloat16", strict=True).expand()


def _sql_both(a: str, b: str, end) -> str:
    """Two FLOAT columns combined, one of which may be null."""
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {end(f'({a} + {b})::FLOAT::DOUBLE')} END"


def _sql_by_rank(rows: str, size: int) -> str:
    return f"SELECT buf_id, idx, {', '.join(f'max(value) FILTER (rank = {r}) AS v{r}' for r in range(size))} FROM ({rows}) GROUP BY buf_id, idx"


def _sql_fold(rows: str, order: list[str], end) -> str:
    """From left to right over expressions of v0, v1, ...; the result is v0."""
    rows = f"SELECT buf_id, idx, {', '.join(f'{x} AS w{k}' for k, x in enumerate(order))} FROM ({rows})"
    for k in range(1, len(order)):
        rows = f"SELECT buf_id, idx, {_sql_both('w0', f'w{k}', end)} AS w0, * EXCLUDE (buf_id, idx, w0) FROM ({rows})"
    return f"SELECT buf_id, idx, w0 AS v0 FROM ({rows})"


def _sql_tree(rows: str, order: list[int], end) -> str:
    """Neighbours of v0, v1, ... in an order of ranks, level by level."""
    rows, n = f"SELECT buf_id, idx, {', '.join(f'v{r} AS w{k}' for k, r in enumerate(order))} FROM ({rows})", len(order)
    while n > 1:
        pairs = [_sql_both(f"w{2 * i}", f"w{2 * i + 1}", end) if 2 * i + 1 < n else f"w{2 * i}" for i in range(-(-n // 2))]
        rows, n = f"SELECT buf_id, idx, {', '.join(f'{x} AS w{i}' for i, x in enumerate(pairs))} FROM ({rows})", len(pairs)
    return f"SELECT buf_id, idx, w0 AS v0 FROM ({rows})"


_single = lambda x: f"({x})::FLOAT"
#: Communicator of the trees: six ranks are no power of two.
TREE = 6


def _embedded(spark, d, size: int):
    """embeddings: the vectors of a rank are its buffers, of 64 elements each."""
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "value"))
    return to_buffers(rows, F.col("vec_id") % size, F.col("idx"), F.col("value").cast("float"), F.floor(F.col("vec_id") / size))


def _sql_embedded(size: int, value: str = "x") -> str:
    return f"SELECT (vec_id % {size})::INT AS rank, (vec_id // {size})::INT AS buf_id, pos::BIGINT AS idx, ({value})::FLOAT AS value FROM (SELECT vec_id, pos, x::DOUBLE AS x FROM {_VECTORS})"


def _sql_around(first: str, step: int) -> list[str]:
    """v0, v1, ... from a rank on, as far as an element's block says: block b is positions 16 b to 16 b + 15."""
    return [f"CASE (((idx // 16) + {first}) % {P} + {P} + {step * k}) % {P} {' '.join(f'WHEN {r} THEN v{r}' for r in range(P))} END" for k in range(P)]


@query("reduce_scatter_ring_bf16", f"SELECT (idx // 16)::INT AS rank, buf_id, idx % 16 AS idx, v0 AS value FROM ({_sql_fold(_sql_by_rank(_sql_embedded(P, _sql_truncated('x')), P), _sql_around('1', 1), _sql_truncated)})")
def reduce_scatter_ring_bf16(spark, d):
    """bfloat16 sums that go round the ring: each block in the order that ends on its rank."""
    return C.reduce_scatter(_embedded(spark, d, P).withColumn("value", truncate_bf16(F.col("value"))), WORLD, 16, "sum", "bfloat16", order="ring")


@query("reduce_scatter_naive", f"SELECT (idx // 16)::INT AS rank, buf_id, idx % 16 AS idx, v0 AS value FROM ({_sql_fold(_sql_by_rank(_sql_embedded(P), P), _sql_around('0', -1), _single)})")
def reduce_scatter_naive(spark, d):
    """Each rank adds to its own block what comes from the ranks before it."""
    return C.reduce_scatter(_embedded(spark, d, P), WORLD, 16, "sum", "float32", order="naive")


@query("allreduce_ring", f"SELECT rank, buf_id, idx, v0 AS value FROM ({_sql_fold(_sql_by_rank(_sql_embedded(P), P), _sql_around('1', 1), _single)}), {_RANKS}")
def allreduce_ring(spark, d):
    return C.allreduce(_embedded(spark, d, P), WORLD, "sum", "float32", order="ring", count=64).expand()


@query("reduce_binomial", f"SELECT 3 AS rank, buf_id, idx, v0 AS value FROM ({_sql_tree(_sql_by_rank(_sql_embedded(TREE), TREE), [(3 + k) % TREE for k in range(TREE)], _single)})")
def reduce_binomial(spark, d):
    """A tree over six ranks, of which the last buffers have fewer, with rank 3 as its root."""
    return C.reduce(_embedded(spark, d, TREE), Communicator(TREE), 3, "sum", "float32", order="binomial")


_FOLDED = f"SELECT buf_id, idx, {_sql_both('v0', 'v1', _sql_half)} AS v0, {_sql_both('v2', 'v3', _sql_half)} AS v1, v4 AS v2, v5 AS v3 FROM ({_sql_by_rank(_sql_embedded(TREE, _sql_half('x')), TREE)})"


@query("allreduce_doubling_fp16", f"SELECT range::INT AS rank, buf_id, idx, v0 AS value FROM ({_sql_tree(_FOLDED, [0, 1, 2, 3], _sql_half)}), range({TREE})")
def allreduce_doubling_fp16(spark, d):
    """Ranks 0 to 3 are folded in pairs, then doubling goes over four partners."""
    return C.allreduce(_embedded(spark, d, TREE).withColumn("value", round_fp16(F.col("value"))), Communicator(TREE), "sum", "float16", order="doubling").expand()


@query("allreduce_pairwise", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, max_by(value, 2 * abs(value) + (value > 0)::BIGINT)::BIGINT AS value FROM {MICRO} GROUP BY ALL), {_RANKS}")
def allreduce_pairwise(spark, d):
    """A function of two blocks: the value of the largest magnitude, of opposite ones the positive."""

    def largest(a, b):
        return np.where((abs(a) > abs(b)) | ((abs(a) == abs(b)) & (a > b)), a, b)

    return C.allreduce(micro(spark, d), WORLD, Pairwise(largest), "int64").expand()


@query("allreduce_maxloc", f"SELECT rank, buf_id, idx, value FROM (SELECT 0 AS buf_id, l_partkey AS idx, max(printf('%016X', round(l_extendedprice * 100)::BIGINT) || printf('%016X', 9223372036854775807 - l_orderkey)) AS value FROM lineitem GROUP BY l_partkey), {_RANKS}")
def allreduce_maxloc(spark, d):
    """Elements of a custom type, a price and where it is found: the highest price of a part, of equal ones the first order's.
    Shown in hexadecimal, with the order counted down from the largest long."""
    kind = Registry().register(16, [("price", ">i8"), ("left", ">i8")])

    def better(a, b):
        return np.where((a["price"] > b["price"]) | ((a["price"] == b["price"]) & (a["left"] > b["left"])), a, b)

    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    long = lambda c: F.lpad(F.hex(c), 16, "0")
    element = F.unhex(F.concat(long(F.round(F.col("l_extendedprice") * 100).cast("bigint")), long(F.lit((1 << 63) - 1) - F.col("l_orderkey"))))
    b = to_buffers(rows, F.col("l_orderkey") % P, F.col("l_partkey"), element)
    return C.allreduce(b, WORLD, Pairwise(better), kind).expand().withColumn("value", F.hex("value"))


@query(
    "allreduce_levels",
    f"""SELECT CASE WHEN grouping(node) = 1 THEN 'world' WHEN grouping(rank) = 1 THEN 'node' ELSE 'rank' END AS level, node, rank, buf_id, idx, sum(value)::BIGINT AS value
    FROM (SELECT *, (rank // 2)::INT AS node FROM {CENTS}) GROUP BY GROUPING SETS ((buf_id, idx, node, rank), (buf_id, idx, node), (buf_id, idx))""",
)
def allreduce_levels(spark, d):
    """Sums of ranks, of nodes of two ranks, and of all, in one pass."""
    return C.allreduce_levels(cents(spark, d), 2, "sum", "int64", comm=WORLD)


@query("allreduce_bucketed", f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM {CENTS} GROUP BY ALL), {_RANKS}")
def allreduce_bucketed(spark, d):
    """Buffers written in buckets of their elements once; the reduction reads them without an exchange."""
    stored = write_bucketed(cents(spark, d), f"meshframe_cents_{zlib.crc32(d.encode()):08x}", 8)
    return C.allreduce(stored, WORLD, "sum", "int64").expand()


_CALLS = f"(SELECT (user_id % {P})::INT AS rank, event_type || '/' || (event_id // 50) AS match_id, event_id AS issued FROM events)"
_ISSUED = f"(SELECT *, (row_number() OVER (PARTITION BY rank, match_id ORDER BY issued) - 1)::INT AS occurrence FROM {_CALLS})"


@query(
    "unordered_calls",
    f"""SELECT match_id, occurrence, CASE WHEN n = {P} THEN row_number() OVER (PARTITION BY n = {P} ORDER BY lead) - 1 END AS position,
    array_to_string(list_filter([0, 1, 2, 3], lambda r: NOT list_contains(ranks, r)), ',') AS missing
    FROM (SELECT match_id, occurrence, count(*) AS n, list(rank) AS ranks, min(issued) FILTER (rank = 0) AS lead FROM {_ISSUED} GROUP BY ALL)""",
)
def unordered_calls(spark, d):
    """events as calls of the users' ranks, by type and time: their common order, and which ranks lack a call."""
    rows = read(spark, d, "events").select((F.col("user_id") % P).cast("int").alias("rank"), F.concat_ws("/", "event_type", F.floor(F.col("event_id") / 50).cast("string")).alias("match_id"), F.col("event_id").alias("at"))
    return agreed(rows, WORLD).withColumn("missing", F.concat_ws(",", F.col("missing").cast("array<string>")))


_FP16 = f"SELECT buf_id, idx, sum(value::DOUBLE) AS x FROM (SELECT buf_id, idx, {_sql_half('x')} AS value FROM {_FLOATS}) GROUP BY ALL"


@query("allreduce_fp16", f"SELECT rank, buf_id, idx, {_sql_half('x')} AS value FROM ({_FP16}), {_RANKS}")
def allreduce_fp16(spark, d):
    return C.allreduce(_vectors(spark, d).withColumn("value", round_fp16(F.col("value"))), WORLD, "sum", "float16").expand()


@query(
    "allreduce_fused",
    f"SELECT rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM (SELECT rank, 0 AS buf_id, idx, value FROM {MICRO} UNION ALL SELECT rank, 1, idx, 2 * value FROM {MICRO} UNION ALL SELECT rank, 2, idx, -value FROM {MICRO}) GROUP BY ALL), {_RANKS}",
)
def allreduce_fused(spark, d):
    """Three calls, one exchange."""
    b = micro(spark, d)
    calls = [Call(b.withColumn("value", f * F.col("value")), 64, "int64") for f in (1, 2, -1)]
    ((_, result),) = fuse(calls, WORLD)
    return result.expand()


@query(
    "fusion_plan",
    """SELECT call, kind, bytes, CASE WHEN bytes < 16384 THEN min(call) OVER (PARTITION BY bytes < 16384, kind, place // 256) ELSE call END AS fused_into
    FROM (SELECT *, row_number() OVER (PARTITION BY bytes < 16384, kind ORDER BY call) - 1 AS place FROM (SELECT o_orderkey AS call, o_orderstatus AS kind, floor(o_totalprice / 8)::BIGINT AS bytes FROM orders))""",
)
def fusion_plan(spark, d):
    """orders as calls, of as many bytes as an eighth of their price: small ones of one status join by 256."""
    calls = read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_orderstatus").alias("kind"), F.floor(F.col("o_totalprice") / 8).alias("bytes"))
    return fused(calls)


@query("priority_order", "SELECT call, priority, row_number() OVER (ORDER BY priority DESC, call) - 1 AS place FROM (SELECT o_orderkey AS call, o_orderpriority[1]::INT AS priority FROM orders)")
def priority_order(spark, d):
    """orders as calls: the places at which they start, by priority, equals in the order of issue."""
    return start_order(read(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")))


# ---------------------------------------------------------------- broadcast, gather, all-to-all

_BCAST = f"SELECT r.rank, b.buf_id, b.idx, b.value FROM (SELECT * FROM {ORDERS} WHERE rank = 2) b, {_RANKS} r"
query("bcast_inplace", _BCAST)(lambda spark, d: C.bcast(orders(spark, d), WORLD, 2).expand())
query("broadcast_outofplace", _BCAST)(lambda spark, d: C.broadcast(orders(spark, d), WORLD, 2).expand())



@query("allgather", f"SELECT r.rank, b.buf_id, b.rank * (SELECT max(idx) + 1 FROM {ORDERS}) + b.idx AS idx, b.value FROM {ORDERS} b, {_RANKS} r")
def allgather(spark, d):
    """Blocks of as many elements as a rank has."""
    b = orders(spark, d)
    count = (b.agg(F.max("idx")).first()[0] or 0) + 1
    return C.allgather(b, WORLD, count).expand()


query("allgather_vector", f"SELECT r.rank, b.rank AS src_rank, b.buf_id, b.idx, b.value FROM {ORDERS} b, {_RANKS} r")(lambda spark, d: C.allgather_vector(orders(spark, d), WORLD).expand())


def uneven(spark, d):
    """events at the user's rank, dense in the order of event_id; and (rank, buf_id, n)."""
    rows = read(spark, d, "events").select("event_id", (F.col("user_id") % P).cast("int").alias("rank"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    placed, counts = positions_and_counts(rows, ["rank"], "event_id")
    return placed.select("rank", F.lit(0).alias("buf_id"), "idx", "value"), counts.select("rank", F.lit(0).alias("buf_id"), "n")


UNEVEN = f"(SELECT rank, 0 AS buf_id, row_number() OVER (PARTITION BY rank ORDER BY event_id) - 1 AS idx, value FROM (SELECT event_id, (user_id % {P})::INT AS rank, round(value * 100)::BIGINT AS value FROM events))"
_COUNTS = f"(SELECT rank, buf_id, n, coalesce(sum(n) OVER (PARTITION BY buf_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT rank, buf_id, count(*) AS n FROM {UNEVEN} GROUP BY ALL))"
query("count_offsets", f"SELECT rank, buf_id, n, \"offset\" FROM {_COUNTS}")(lambda spark, d: C.offsets(uneven(spark, d)[1], ["buf_id"]))
_ALLGATHERV = f"SELECT r.rank, b.buf_id, c.\"offset\" + b.idx AS idx, b.value FROM {UNEVEN} b JOIN {_COUNTS} c USING (rank, buf_id), {_RANKS} r"


@query("allgatherv", _ALLGATHERV)
def allgatherv(spark, d):
    buffers, counts = uneven(spark, d)
    return C.allgatherv(buffers, WORLD, counts).expand()


@query("allgatherv_checked", _ALLGATHERV)
def allgatherv_checked(spark, d):
    """What ranks send is held against the counts inside the plan."""
    buffers, counts = uneven(spark, d)
    return C.allgatherv(buffers, WORLD, counts, check=True).expand()


query("allgatherv_vector", f"SELECT r.rank, b.rank AS src_rank, b.buf_id, b.idx, b.value FROM {UNEVEN} b, {_RANKS} r")(lambda spark, d: C.allgatherv_vector(uneven(spark, d)[0], WORLD).expand())

query("alltoall", f"SELECT ((idx % 64) // 16)::INT AS rank, (idx // 64)::INT AS buf_id, rank * 16::BIGINT + idx % 16 AS idx, value FROM {MICRO}")(
    lambda spark, d: C.alltoall(micro(spark, d).withColumn("buf_id", F.floor(F.col("idx") / 64).cast("int")).withColumn("idx", F.col("idx") % 64), WORLD, 16)
)
query("alltoall_vector", f"SELECT ((idx % 64) // 16)::INT AS rank, rank AS src_rank, (idx // 64)::INT AS buf_id, idx % 16 AS idx, value FROM {MICRO}")(
    lambda spark, d: C.alltoall_vector(micro(spark, d).withColumn("buf_id", F.floor(F.col("idx") / 64).cast("int")).withColumn("idx", F.col("idx") % 64), WORLD, 16)
)
_STARTS = f"(SELECT dst, src, coalesce(sum(n) OVER (PARTITION BY dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT dst, src, count(*) AS n FROM {MESSAGES} GROUP BY ALL))"
_ALLTOALLV = f"SELECT m.dst AS rank, m.buf_id, s.start + m.idx AS idx, m.value FROM {MESSAGES} m JOIN {_STARTS} s USING (dst, src)"


@query("alltoallv", _ALLTOALLV)
def alltoallv(spark, d):
    sent, counts = messages(spark, d)
    return C.alltoallv(sent, WORLD, counts)


@query("alltoallv_raw", _ALLTOALLV)
def alltoallv_raw(spark, d):
    """From send buffers as they lie in memory: a rank's events by receiver, one block behind the other. Elements find their
    block by its offset; what receivers expect is checked in the plan."""
    rows = read(spark, d, "events").select("event_id", (F.col("user_id") % P).cast("int").alias("rank"), (F.col("event_id") % P).alias("dst"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    rows = rows.withColumn("at", F.col("dst") * F.lit(1 << 40) + F.col("event_id"))
    counts = rows.groupBy(F.col("rank").alias("src"), F.col("dst").cast("int").alias("dst"), F.lit(0).alias("buf_id")).agg(F.count(F.lit(1)).alias("n"))
    raw = positions(rows, ["rank"], "at").select("rank", F.lit(0).alias("buf_id"), "idx", "value")
    return C.alltoallv_raw(raw, WORLD, counts, counts)


query("alltoallv_vector", f"SELECT dst AS rank, src AS src_rank, buf_id, idx, value FROM {MESSAGES}")(lambda spark, d: C.alltoallv_vector(messages(spark, d)[0], WORLD))


@query("barrier", f"SELECT rank, count(*) AS n FROM {ORDERS} GROUP BY rank")
def barrier(spark, d):
    """Ranks count their elements on the far side of a barrier."""
    C.barrier(spark, Communicator(min(P, spark.sparkContext.defaultParallelism)))
    return orders(spark, d).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- point to point


def _ring(spark, d, group_id=0, seq=0):
    b = orders(spark, d)
    receives = WORLD.table(spark).select("rank", ((F.col("rank") + P - 1) % P).cast("int").alias("from_rank"), F.lit(group_id).alias("group_id"), F.lit(seq).alias("seq"))
    return p2p.send(b, (F.col("rank") + 1) % P, seq, group_id), receives


query("sendrecv_ring", f"SELECT ((rank + 1) % {P})::INT AS rank, rank AS from_rank, 0 AS seq, idx, value FROM {ORDERS}")(lambda spark, d: p2p.recv(*_ring(spark, d)))


@query("sendrecv_group", f"SELECT ((rank + 1) % {P})::INT AS rank, rank AS from_rank, 0 AS seq, idx, value FROM {ORDERS} UNION ALL SELECT ((rank + 1) % {P})::INT, rank, 1, idx, value FROM {ORDERS}")
def sendrecv_group(spark, d):
    with p2p.Group() as group:
        for seq in (0, 1):
            messages_, receives = _ring(spark, d, seq=seq)
            group.send(messages_)
            group.recv(receives)
    return group.result


@query("sendrecv_unmatched", "SELECT * FROM (VALUES (2, 3, 0, 0, 'send'), (1, 3, 0, 0, 'recv')) t(src, dst, group_id, seq, side)")
def sendrecv_unmatched(spark, d):
    """Rank 3 waits for rank 1, while rank 2 sends to it."""
    messages_, receives = _ring(spark, d)
    receives = receives.withColumn("from_rank", F.when(F.col("rank") == 3, F.lit(1)).otherwise(F.col("from_rank")))
    return p2p.unmatched(messages_, receives)


# ---------------------------------------------------------------- communicators


def _nations(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("rank"), F.col("n_regionkey").cast("int").alias("color"), (-F.col("n_nationkey")).cast("int").alias("key"))


_SPLIT = "SELECT rank, color, key, (row_number() OVER (PARTITION BY color ORDER BY {order}) - 1)::INT AS new_rank, (count(*) OVER (PARTITION BY color))::INT AS new_size FROM (SELECT n_nationkey::INT AS rank, n_regionkey::INT AS color, (-n_nationkey)::INT AS key FROM nation)"
query("comm_split_color", _SPLIT.format(order="rank"))(lambda spark, d: split_table(_nations(spark, d)))
query("comm_split_key", _SPLIT.format(order="key, rank"))(lambda spark, d: split_table(_nations(spark, d), key="key"))
query("topo_fixed_colors", "SELECT rank, (rank // 2)::INT AS pair, (rank % 2)::INT AS plane, (rank // 4)::INT AS node, (rank % 4)::INT AS node_rank FROM (SELECT c_custkey::INT AS rank FROM customer)")(
    lambda spark, d: topology(read(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("rank")), 4)
)


@query("rank_translation", "SELECT n_regionkey::INT AS color, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS local_rank, n_nationkey::INT AS global_rank FROM nation")
def rank_translation(spark, d):
    return split_table(_nations(spark, d)).select("color", F.col("new_rank").alias("local_rank"), F.col("rank").alias("global_rank"))


@query("custom_datatype_gather", f"SELECT r.rank, b.rank AS src_rank, b.buf_id, b.idx, b.value FROM (SELECT (c_custkey % {P})::INT AS rank, 0 AS buf_id, c_custkey // {P} AS idx, lower(md5(c_name)) AS value FROM customer) b, {_RANKS} r")
def custom_datatype_gather(spark, d):
    """Opaque elements of 16 bytes, shown in hexadecimal."""
    dtype = Registry().register(16)
    rows = read(spark, d, "customer").select("c_custkey", "c_name")
    b = to_buffers(rows, F.col("c_custkey") % P, F.floor(F.col("c_custkey") / P), F.unhex(F.md5("c_name")).cast(dtype.spark))
    return C.allgather_vector(b, WORLD).expand().withColumn("value", F.lower(F.hex("value")))


@query("single_rank", f"SELECT 0 AS rank, buf_id, idx, value FROM (SELECT buf_id, idx, sum(value)::BIGINT AS value FROM (SELECT 0 AS buf_id, o_orderkey AS idx, round(o_totalprice * 100)::BIGINT AS value FROM orders) GROUP BY ALL)")
def single_rank(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = to_buffers(rows, F.lit(0), F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return C.allreduce(b, Communicator(1), "sum", "int64").expand()


@query("zero_count", f"SELECT rank, buf_id, idx, value FROM {ORDERS} WHERE false")
def zero_count(spark, d):
    return C.reduce_scatter(orders(spark, d), WORLD, 0, "sum", "int64")
