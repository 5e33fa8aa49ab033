"""Reductions of floats in a fixed order: the same bits however rows are partitioned.

An element's values are laid out by rank, an array of as many places as the communicator has ranks, null where a rank has
no value; then they are combined in the order that the algorithm's messages would have, with a conversion to the
element type at each step. Places without a value are passed over. Several values of one rank are reduced first, in the
wide type and with one conversion, so an array never holds more than a value a rank.

=========  ==========================================================================================
rank       ascending ranks, from rank 0 on
ring       block b, which ends on rank b, starts on rank b + 1 and goes round
naive      block b starts with rank b's own value, then those of b - 1, b - 2, ... come in
binomial   a tree over the ranks relative to the root: neighbours first, then neighbouring pairs, and so on
doubling   the ranks beyond a power of two are folded into the first ones, then the same tree from rank 0; recursive
           halving combines in this order, too
=========  ==========================================================================================

A block is an element's part of the vector: with reduce_scatter, recv_count elements; with allreduce, its count over the
ranks, and what is left over belongs to the last block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import DataType, round_bf16, round_fp16, truncate_bf16
from meshframe.functions.reductions import MAX, MIN, PROD, SUM, reduction, stages

ORDERS = ("rank", "ring", "naive", "binomial", "doubling")
#: Up to so many ranks, an element's values are aggregated side by side, with one exchange; more take a second one.
MOST_COLUMNS = 64

_OPS = {SUM: lambda a, b: a + b, PROD: lambda a, b: a * b, MIN: F.least, MAX: F.greatest}


def _kind(dtype: DataType) -> str:
    return "double" if dtype.name == "float64" else "float"


def by_rank(buffers: DataFrame, size: int, op: str, dtype: DataType, rounding: str) -> DataFrame:
    """(buf_id, idx, v): each element's values as an array by rank."""
    kind = _kind(dtype)
    outside = F.lit(f"a rank is not below {size}")
    if size <= MOST_COLUMNS:
        partial, _, finish = stages(op, dtype, rounding)
        own = F.array(*[partial(F.when(F.col("rank") == r, F.col("value"))).cast("double") for r in range(size)])
        wrong = (F.max("rank") >= size) | (F.min("rank") < 0)
        held = buffers.groupBy("buf_id", "idx").agg(F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(outside).cast("array<double>")).otherwise(own).alias("v"))
        return held.select("buf_id", "idx", F.transform("v", lambda w: finish(w).cast(kind)).alias("v"))  # one piece of code for all ranks
    inner = buffers.groupBy("rank", "buf_id", "idx").agg(reduction(op, F.col("value"), dtype, rounding).cast(kind).alias("value"))
    rank = F.when((F.col("rank") >= 0) & (F.col("rank") < size), F.col("rank")).otherwise(F.raise_error(outside).cast("int"))
    held = inner.groupBy("buf_id", "idx").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("value").alias("v")))).alias("held"))
    return held.select("buf_id", "idx", spread("held", "r", "v", F.lit(size), kind).alias("v"))


def spread(cells: str, place: str, value: str, size: Column, kind: str) -> Column:
    """An array of structs, sorted by place, as an array of values with nulls in the gaps."""
    none = F.lit(None).cast(kind)

    def before(k: Column) -> Column:
        return F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col(cells), k - 1)[place])

    filled = F.flatten(F.transform(cells, lambda c, k: F.concat(F.array_repeat(none, (c[place] - before(k) - 1).cast("int")), F.array(c[value]))))
    return F.concat(filled, F.array_repeat(none, (size - F.size(filled)).cast("int")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """From left to right over what is not null."""
    there = F.filter(values, lambda v: v.isNotNull())
    return _let(there, lambda p: F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.get(p, F.lit(0)), step))


def _rotated(values: Column, by: Column, size: int) -> Column:
    return F.concat(F.slice(values, by + 1, F.lit(size)), F.slice(values, F.lit(1), by))


def _pairs(values: Column, size: int, step) -> Column:
    """Neighbours combined, as long as there are two."""
    def halved(places: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: _fold(F.slice(a, 2 * i + 1, F.lit(2)), step))

    while size > 1:
        size = -(-size // 2)
        values = _let(values, halved(size))
    return F.get(values, F.lit(0))


def combined(v: Column, size: int, op: str, dtype: DataType, order: str = "rank", rounding: str = "truncate", block: Column | None = None, root: int = 0) -> Column:
    """The values of an array by rank as one, in an order. block: the element's (ring, naive)."""
    if op not in _OPS:
        raise InvalidArgument(f"{op} has no order of steps")
    if order not in ORDERS:
        raise InvalidArgument(f"unknown order {order}")
    kind = _kind(dtype)
    end = {"bfloat16": truncate_bf16 if rounding == "truncate" else round_bf16, "float16": round_fp16}.get(dtype.name, lambda c: c.cast(kind))

    def step(a: Column, b: Column) -> Column:
        return end(_OPS[op](a, b))

    if order == "rank":
        return _fold(v, step)
    if order == "binomial":
        return _pairs(_rotated(v, F.lit(root), size), size, step)
    if order == "doubling":
        whole = 1 << (size.bit_length() - 1)
        extra = size - whole
        if extra:
            folded = F.transform(F.sequence(F.lit(0), F.lit(extra - 1)), lambda i: _fold(F.slice(v, 2 * i + 1, F.lit(2)), step))
            v = F.concat(folded, F.slice(v, 2 * extra + 1, F.lit(size)))
        return _pairs(v, whole, step)
    if block is None:
        raise InvalidArgument(f"order {order} needs the elements' blocks")
    if order == "ring":
        return _fold(_rotated(v, (block + 1) % size, size), step)
    return _fold(_rotated(F.reverse(v), size - 1 - block, size), step)


def block_of(idx: Column, count: int, size: int) -> Column:
    """The block of an allreduce's element: count over the ranks each, the rest with the last."""
    each = count // size
    return F.lit(size - 1) if each == 0 else F.least(F.floor(idx / each), F.lit(size - 1)).cast("int")
