"""Collectives as functions from buffers to buffers.

Each takes buffers in long form (rank, buf_id, idx, value) and gives the same form, with the receiving rank as rank.
Results that are the same on every rank are Replicated: the values once, and rows a rank only when asked for.
In-place calls need nothing here: DataFrames do not change. A call over no elements gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import REGISTRY, DataType
from meshframe.functions.orders import block_of, by_rank, combined
from meshframe.functions.pairwise import Pairwise, multiplied, reduced
from meshframe.functions.reductions import PROD, SUM, both, reduction, stages
from meshframe.operators.comm import Communicator
from meshframe.sources.buffers import last_up_to


@dataclass(frozen=True)
class Replicated:
    """The same values for every rank of a communicator."""

    values: DataFrame
    comm: Communicator

    def expand(self) -> DataFrame:
        """A copy for each rank, generated in place: no join and no exchange."""
        if self.comm.size == 1:
            return self.values.select(F.lit(0).alias("rank"), "*")
        return self.values.select(F.explode(self.comm.ranks()).alias("rank"), "*")

    def on(self, rank: int) -> DataFrame:
        return self.values.select(F.lit(self.comm.check_root(rank)).alias("rank"), "*")


def _reduced(buffers: DataFrame, comm: Communicator, op, dtype, rounding: str, order: str | None = None, block: Column | None = None, root: int = 0) -> DataFrame:
    dtype = REGISTRY[dtype]
    if isinstance(op, Pairwise):
        return reduced(buffers, op, dtype, rounding)
    if order is not None and dtype.kind == "float" and not callable(op):
        values = by_rank(buffers, comm.size, op, dtype, rounding)
        return values.select("buf_id", "idx", combined(F.col("v"), comm.size, op, dtype, order, rounding, block, root).alias("value"))
    if op == PROD and dtype.kind in ("int", "uint"):
        return multiplied(buffers, dtype)
    return buffers.groupBy("buf_id", "idx").agg(reduction(op, F.col("value"), dtype, rounding).alias("value"))


def allreduce(buffers: DataFrame, comm: Communicator, op="sum", dtype: str | DataType = "float32", strict: bool = False, rounding: str = "truncate", order: str | None = None, count: int | None = None) -> Replicated:
    """op: a built-in reduction, a function from a column to an aggregate, or Pairwise. order: how floats are combined
    (see orders.py); strict is the order of ranks. count: elements of a rank's vector, for orders by block."""
    order = order or ("rank" if strict else None)
    block = None if count is None else block_of(F.col("idx"), count, comm.size)
    return Replicated(_reduced(buffers, comm, op, dtype, rounding, order, block), comm)


def allreduce_2d(buffers: DataFrame, comm: Communicator, per_node: int, op="sum", dtype: str = "int64", rounding: str = "truncate") -> Replicated:
    """Reduces inside nodes first, then across them: the first level stays in the wide type, the second converts."""
    if op == PROD and REGISTRY[dtype].kind in ("int", "uint"):
        return Replicated(multiplied(buffers, REGISTRY[dtype]), comm)  # in levels already: by task, then across tasks
    partial, merge, finish = stages(op, REGISTRY[dtype], rounding)
    node = F.floor(F.col("rank") / per_node).cast("int")
    inner = buffers.groupBy(node.alias("node"), "buf_id", "idx").agg(partial(F.col("value")).alias("value"))
    return Replicated(inner.groupBy("buf_id", "idx").agg(finish(merge(F.col("value"))).alias("value")), comm)


#: Ranks up to which levels are made from a column for each.
FEW_RANKS = 16


def allreduce_levels(buffers: DataFrame, per_node: int, op="sum", dtype: str = "int64", rounding: str = "truncate", comm: Communicator | None = None) -> DataFrame:
    """The results of a hierarchy's levels in one pass: (level, node, rank, buf_id, idx, value), where level is rank (node
    and rank set), node (rank null) or world (both null). One exchange for all levels.

    Few ranks of a comm: a group of the aggregate is an element with a column for each rank, of which nodes and world are
    made behind the exchange. Else grouping sets: rows are copied for each level, and a task holds a row for each rank, node
    and element. Integer products and the caller's own op take these too. A rank that the comm lacks is an error when read.
    """
    kind = REGISTRY[dtype]
    if comm is not None and comm.size <= FEW_RANKS and not callable(op) and not (op == PROD and kind.kind in ("int", "uint")):
        return _levels_by_columns(buffers, per_node, op, kind, rounding, comm.size)
    node = F.floor(F.col("rank") / per_node).cast("int")
    keys = [F.col("buf_id"), F.col("idx")]
    sets = [[*keys, F.col("node"), F.col("rank")], [*keys, F.col("node")], keys]
    rows = buffers.withColumn("node", node).groupingSets(sets, "buf_id", "idx", "node", "rank")
    out = rows.agg(F.grouping("node").alias("no_node"), F.grouping("rank").alias("no_rank"), reduction(op, F.col("value"), kind, rounding).alias("value"))
    level = F.when(F.col("no_node") == 1, F.lit("world")).when(F.col("no_rank") == 1, F.lit("node")).otherwise(F.lit("rank"))
    return out.select(level.alias("level"), "node", "rank", "buf_id", "idx", "value")


def _levels_by_columns(buffers: DataFrame, per_node: int, op: str, dtype: DataType, rounding: str, size: int) -> DataFrame:
    partial, _, finish = stages(op, dtype, rounding)
    rank, null = F.col("rank"), F.lit(None).cast("int")
    # Which ranks hold the element, a bit each: a null value is one all the same, a rank without the element has no row.
    unknown = F.raise_error(F.concat(F.lit(f"not one of {size} ranks: "), F.coalesce(rank.cast("string"), F.lit("null")))).cast("int")
    bit = F.when(rank.between(0, size - 1), F.call_function("shiftleft", F.lit(1), rank.cast("int"))).otherwise(unknown)
    if op == SUM and dtype.kind == "int" and dtype.bytes == 8 and isinstance(buffers.schema["value"].dataType, IntegralType):
        # Sums of the upper and of the lower 32 bits, exact for 2^31 rows of a rank's element: a decimal takes twice the memory.
        value = F.col("value").cast("bigint")
        halves = {"h": F.shiftright(value, 32), "l": value.bitwiseAND((1 << 32) - 1)}
        own = [F.sum(F.when(rank == r, half)).alias(f"{name}{r}") for r in range(size) for name, half in halves.items()]
        whole = [(F.col(f"h{r}").cast("decimal(38,0)") * F.lit(1 << 32) + F.col(f"l{r}")).alias(f"v{r}") for r in range(size)]
    else:
        own = [partial(F.when(rank == r, F.col("value"))).alias(f"v{r}") for r in range(size)]
        whole = [f"v{r}" for r in range(size)]
    found = buffers.groupBy("buf_id", "idx").agg(F.bit_or(bit).alias("held"), *own).select("buf_id", "idx", "held", *whole)
    groups = [("world", null, null, range(size))]
    groups += [("node", F.lit(k // per_node), null, range(k, min(k + per_node, size))) for k in range(0, size, per_node)]
    groups += [("rank", F.lit(r // per_node), F.lit(r), range(r, r + 1)) for r in range(size)]
    rows = []
    for level, node, one, ranks in groups:
        value = finish(both(op, [F.col(f"v{r}") for r in ranks]))
        row = F.struct(F.lit(level).alias("level"), node.alias("node"), one.alias("rank"), value.alias("value"))
        rows.append(F.when(F.col("held").bitwiseAND(sum(1 << r for r in ranks)) != 0, row))
    out = found.select("buf_id", "idx", F.explode(F.array(*rows)).alias("row")).where("row IS NOT NULL")
    return out.select("row.level", "row.node", "row.rank", "buf_id", "idx", "row.value")


def allreduce_packed(packed: DataFrame, comm: Communicator, width: int, op="sum", dtype: str = "float32", rounding: str = "truncate", wide: bool = False) -> Replicated:
    """Buffers in packed form (rank, buf_id, chunk_id, values of width elements): arrays are reduced place by place, so a
    row of the exchange is a chunk. The values come out in long form.

    With a column held (see pack), only places that some rank holds have a value. wide: values are partial results.
    """
    if wide:
        _, merge, finish = stages(op, REGISTRY[dtype], rounding)
    else:
        merge, finish = (lambda v: reduction(op, v, REGISTRY[dtype], rounding)), (lambda v: v)
    gaps = "held" in packed.columns
    places = [F.struct(finish(merge(F.get("values", F.lit(i)))).alias("value"), (F.max(F.get("held", F.lit(i))) if gaps else F.lit(True)).alias("held")) for i in range(width)]
    chunks = packed.groupBy("buf_id", "chunk_id").agg(F.array(*places).alias("places"), F.max(F.size("values")).alias("n"))
    rows = chunks.select("buf_id", "chunk_id", F.posexplode(F.slice("places", 1, F.col("n"))).alias("pos", "place")).where("place.held")
    return Replicated(rows.select("buf_id", (F.col("chunk_id") * width + F.col("pos")).alias("idx"), "place.value"), comm)


def reduce(buffers: DataFrame, comm: Communicator, root: int, op="sum", dtype: str | DataType = "float32", strict: bool = False, rounding: str = "truncate", order: str | None = None, count: int | None = None) -> DataFrame:
    """Rows of the root alone; other ranks receive nothing."""
    order = order or ("rank" if strict else None)
    block = None if count is None else block_of(F.col("idx"), count, comm.size)
    return Replicated(_reduced(buffers, comm, op, dtype, rounding, order, block, comm.check_root(root)), comm).on(root)


def reduce_scatter(buffers: DataFrame, comm: Communicator, recv_count: int, op="sum", dtype: str | DataType = "float32", strict: bool = False, rounding: str = "truncate", order: str | None = None) -> DataFrame:
    """Rank r receives elements r * recv_count on, recv_count of them: block r."""
    if recv_count < 0:
        raise InvalidArgument("a count is not negative")
    kept = buffers.where(F.col("idx") < comm.size * recv_count)
    block = F.floor(F.col("idx") / max(recv_count, 1)).cast("int")
    out = _reduced(kept, comm, op, dtype, rounding, order or ("rank" if strict else None), block)
    return out.select(block.alias("rank"), "buf_id", (F.col("idx") % max(recv_count, 1)).alias("idx"), "value")


def broadcast(buffers: DataFrame, comm: Communicator, root: int) -> Replicated:
    """The root's buffer for every rank; bcast is the same with the root's buffer as the place to write to."""
    comm.check_root(root)
    return Replicated(buffers.where(F.col("rank") == root).select("buf_id", "idx", "value"), comm)


bcast = broadcast


def allgather(buffers: DataFrame, comm: Communicator, count: int) -> Replicated:
    """The blocks of all ranks, count elements each, one behind the other."""
    return Replicated(buffers.select("buf_id", (F.col("rank") * F.lit(count).cast("bigint") + F.col("idx")).alias("idx"), "value"), comm)


def allgather_vector(buffers: DataFrame, comm: Communicator) -> Replicated:
    """As allgather, into a buffer for each sender."""
    return Replicated(buffers.select(F.col("rank").alias("src_rank"), "buf_id", "idx", "value"), comm)


def counts_of(buffers: DataFrame) -> DataFrame:
    """(rank, buf_id, n) of dense buffers."""
    return buffers.groupBy("rank", "buf_id").agg(F.count(F.lit(1)).alias("n"))


def offsets(counts: DataFrame, by: list[str], order: str = "rank") -> DataFrame:
    """Exclusive prefix sums of n. Count tables have a row for each pair of ranks at most."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))


def checked_counts(counts: DataFrame, found: DataFrame, keys: list[str], said: Callable[[Column, Column], Column]) -> DataFrame:
    """counts (keys, n), whose rows are an error when read unless found, counts from elsewhere, has the same; what is
    missing on either side is 0. said: from found's count and the expected one to the error's text.

    The check is part of the plan: no action of its own, and no result of a call whose counts differ.
    """
    met = counts.select(*keys, "n").join(found.select(*keys, F.col("n").alias("__found")), keys, "full")
    n, sent = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("__found", F.lit(0)).cast("bigint")
    # A filter, as no reader of the result may do without it.
    return met.where(F.when(n == sent, F.lit(True)).otherwise(F.raise_error(said(sent, n)).cast("boolean"))).select(*keys, n.alias("n"))


def _sent_unexpected(sent: Column, expected: Column) -> Column:
    return F.concat(F.lit("rank "), F.col("rank"), F.lit(": "), sent, F.lit(" elements sent, "), expected, F.lit(" expected"))


def _differ(sent: Column, expected: Column) -> Column:
    return F.concat(F.lit("rank "), F.col("src"), F.lit(" sends "), sent, F.lit(" elements to rank "), F.col("dst"), F.lit(", which expects "), expected)


#: Rows of a table of counts up to which every task may hold it.
MOST_COUNTS = 1 << 20


def _beside(counts: DataFrame, rows: int) -> DataFrame:
    """A table of counts to be joined to elements; rows: as many as ranks or pairs of ranks allow. Larger ones are joined
    as any table."""
    return F.broadcast(counts) if rows <= MOST_COUNTS else counts


def allgatherv(buffers: DataFrame, comm: Communicator, counts: DataFrame | None = None, check: bool = False) -> Replicated:
    """Blocks of any length one behind the other; counts (rank, buf_id, n) are taken from the buffers if not given. check:
    each rank's elements are held against counts, and reading the result is an error if they differ."""
    if counts is None:
        counts = counts_of(buffers)
    elif check:
        counts = checked_counts(counts, counts_of(buffers), ["rank", "buf_id"], _sent_unexpected)
    starts = offsets(counts, ["buf_id"]).select("rank", "buf_id", "offset")
    placed = buffers.join(_beside(starts, comm.size), ["rank", "buf_id"])  # a row for each rank and buffer
    return Replicated(placed.select("buf_id", (F.col("offset") + F.col("idx")).alias("idx"), "value"), comm)


allgatherv_vector = allgather_vector


def alltoall(buffers: DataFrame, comm: Communicator, count: int) -> DataFrame:
    """Block d of rank s becomes block s of rank d."""
    if count <= 0:
        return buffers.limit(0)
    idx = F.col("idx")
    return buffers.where(idx < comm.size * count).select(F.floor(idx / count).cast("int").alias("rank"), "buf_id", (F.col("rank") * F.lit(count).cast("bigint") + idx % count).alias("idx"), "value")


def alltoall_vector(buffers: DataFrame, comm: Communicator, count: int) -> DataFrame:
    if count <= 0:
        return buffers.limit(0).select("rank", F.lit(0).alias("src_rank"), "buf_id", "idx", "value")
    idx = F.col("idx")
    return buffers.where(idx < comm.size * count).select(F.floor(idx / count).cast("int").alias("rank"), F.col("rank").alias("src_rank"), "buf_id", (idx % count).alias("idx"), "value")


def alltoallv(messages: DataFrame, comm: Communicator, counts: DataFrame | None = None, recv_counts: DataFrame | None = None) -> DataFrame:
    """messages: (src, dst, buf_id, idx, value), idx dense from 0 for each pair. Receivers lay blocks out by sender.

    counts: (src, dst, buf_id, n), taken from the messages if not given; recv_counts: what receivers expect. If they differ,
    reading the result is an error.
    """
    if counts is None:
        counts = messages.groupBy("dst", "src", "buf_id").agg(F.count(F.lit(1)).alias("n"))
    if recv_counts is not None:
        counts = checked_counts(recv_counts, counts, ["src", "dst", "buf_id"], _differ)
    starts = offsets(counts, ["dst", "buf_id"], "src").select("dst", "src", "buf_id", "offset")
    placed = messages.join(_beside(starts, comm.size**2), ["dst", "src", "buf_id"])  # a row for each pair of ranks
    return placed.select(F.col("dst").cast("int").alias("rank"), "buf_id", (F.col("offset") + F.col("idx")).alias("idx"), "value")


def alltoallv_vector(messages: DataFrame, comm: Communicator) -> DataFrame:
    return messages.select(F.col("dst").cast("int").alias("rank"), F.col("src").cast("int").alias("src_rank"), "buf_id", "idx", "value")


def split_blocks(buffers: DataFrame, send_counts: DataFrame, size: int = 1 << 10) -> DataFrame:
    """Send buffers and counts (src, dst, buf_id, n) to messages for alltoallv: the send side's offsets.

    A rank's offsets are one sorted array, in which an element finds its block by bisection: a row an element throughout.
    Elements behind the last block are not sent. size: ranks at most.
    """
    starts = offsets(send_counts.where("n > 0"), ["src", "buf_id"], "dst")
    entry = F.struct("offset", "dst", "n")
    blocks = starts.groupBy("src", "buf_id").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))  # an entry a rank
    met = buffers.withColumnRenamed("rank", "src").join(_beside(blocks, size**2), ["src", "buf_id"])
    place = last_up_to(F.col("blocks"), F.col("idx"), size, lambda b: b["offset"])
    met = met.withColumn("block", F.get("blocks", place)).where(F.col("idx") < F.col("block.offset") + F.col("block.n"))
    return met.select("src", "block.dst", "buf_id", (F.col("idx") - F.col("block.offset")).alias("idx"), "value")


def alltoallv_raw(buffers: DataFrame, comm: Communicator, send_counts: DataFrame, recv_counts: DataFrame | None = None) -> DataFrame:
    """alltoallv from send buffers as they lie in memory: send_counts (src, dst, buf_id, n) cut them into blocks."""
    return alltoallv(split_blocks(buffers, send_counts, comm.size), comm, send_counts, recv_counts)


def barrier(spark: SparkSession, comm: Communicator) -> None:
    """A task for each rank, which all wait for each other. It needs a slot for each, and moves no data: actions before it
    are done, and plans that run later start later."""
    if comm.size > spark.sparkContext.defaultParallelism:
        raise InvalidArgument(f"{comm.size} ranks can't wait for each other in {spark.sparkContext.defaultParallelism} slots")

    def wait(batches):
        from pyspark import BarrierTaskContext

        BarrierTaskContext.get().barrier()
        yield from batches

    spark.range(0, comm.size, 1, comm.size).mapInArrow(wait, "id long", barrier=True).write.format("noop").mode("overwrite").save()
