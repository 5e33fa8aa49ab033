"""Reductions by a function of two blocks of elements.

The function takes two arrays of equal length, of numpy values of the element type (custom types: records of their
structured type), and gives the array of the elements' combinations. It is called on many elements at once: a task
combines what it has of every element, by halving, in tables of bounded size; one exchange brings an element's partial results
together, sorted, and they are combined in the same way as they stream by. So no list of an element's values is ever held,
and an element that a third of all rows belong to is a row a task in the exchange.

The function must be associative and commutative, as the order of combination is not fixed. Null values are no elements.
16-bit floats come as float32 and are converted once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import BUILT_IN, DataType, to_element, wrap

#: Elements that a task holds before it hands on what it has combined.
MOST_HELD = 1 << 18


@dataclass(frozen=True)
class Pairwise:
    """fn(incoming, inout) or, with context, fn(incoming, inout, Context)."""

    fn: Callable[..., np.ndarray]
    context: bool = False
    match_id: str = ""


@dataclass(frozen=True)
class Context:
    """What a function may know of a call: its match_id, and the elements' places."""

    match_id: str
    buf_id: np.ndarray
    idx: np.ndarray


def _values(column: pa.Array, record: np.dtype | None) -> np.ndarray:
    if record is None:
        return np.asarray(column)
    fixed = column.cast(pa.binary(record.itemsize))  # an error if an element has another length
    return np.frombuffer(fixed.buffers()[1], record, len(fixed), fixed.offset * record.itemsize)


def _column(values: np.ndarray, record: np.dtype | None) -> pa.Array:
    if record is None:
        return pa.array(values)
    raw = pa.py_buffer(np.ascontiguousarray(values, record).tobytes())  # numpy's functions may have changed the byte order
    return pa.Array.from_buffers(pa.binary(record.itemsize), len(values), [None, raw]).cast(pa.binary())


def folded(keys: list[np.ndarray], values: np.ndarray, op: Pairwise) -> tuple[list[np.ndarray], np.ndarray]:
    """Elements in the order of their keys, each once: pairs of neighbours of one element are combined, as long as there
    are any. The last two keys are buf_id and idx."""
    order = np.lexsort(keys[::-1])
    keys, values = [k[order] for k in keys], values[order]
    while True:
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
        if not same.any():
            return keys, values
        opens = np.concatenate(([True], ~same))
        place = np.arange(len(values)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        stay = place % 2 == 0
        left = np.flatnonzero(stay[:-1] & same)
        args = (values[left + 1], values[left], *([Context(op.match_id, keys[-2][left], keys[-1][left])] if op.context else []))
        out = np.asarray(op.fn(*args))
        if out.shape != left.shape:
            raise InvalidArgument(f"the reduction gave {out.shape} for {left.shape} elements")
        values = values.copy()
        values[left] = out
        keys, values = [k[stay] for k in keys], values[stay]


def _combine(op: Pairwise, names: list[str], record: np.dtype | None, in_order: bool):
    """in_order: rows come sorted, so all but the last element is done when a batch is; else up to MOST_HELD are kept."""

    def done(keys: list[np.ndarray], values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), _column(values, record)], names=[*names, "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not len(batch):
                continue
            keys, values = [np.asarray(batch.column(k)) for k in names], _values(batch.column("value"), record)
            if held is not None:
                keys, values = [np.concatenate(x) for x in zip(held[0], keys, strict=True)], np.concatenate((held[1], values), dtype=values.dtype)
            keys, values = held = folded(keys, values, op)
            if in_order and len(values) > 1:
                yield done([k[:-1] for k in keys], values[:-1])
                held = [k[-1:] for k in keys], values[-1:]
            elif len(values) > MOST_HELD:
                yield done(*held)
                held = None
        if held is not None:
            yield done(*held)

    return run


def reduced(buffers: DataFrame, op: Pairwise, dtype: DataType, rounding: str = "truncate", by_rank: bool = False) -> DataFrame:
    """(buf_id, idx, value) of buffers, each element once; by_rank: (rank, buf_id, idx, value), each element of a rank."""
    if dtype.kind == "custom" and dtype.record is None:
        raise InvalidArgument("elements of this type have no structure that a reduction could see")
    wide = dtype.name == "uint64"
    value = wrap(F.col("value"), BUILT_IN["int64"]) if wide else F.col("value").cast(dtype.spark)
    keys = {"rank": "int"} if by_rank else {}
    keys |= {"buf_id": "int", "idx": "bigint"}
    rows = buffers.where(F.col("value").isNotNull()).select(*[F.col(k).cast(t).alias(k) for k, t in keys.items()], value.alias("value"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + f", value {'bigint' if wide else dtype.spark}"
    record = dtype.record if dtype.kind == "custom" else None
    if wide:
        op = Pairwise(_unsigned(op), op.context, op.match_id)
    partial = rows.mapInArrow(_combine(op, list(keys), record, False), schema)
    met = partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_combine(op, list(keys), record, True), schema)
    return met if dtype.kind == "custom" else met.withColumn("value", to_element(F.col("value"), dtype, rounding))


def multiplied(buffers: DataFrame, dtype: DataType, by_rank: bool = False) -> DataFrame:
    """Products of integers: modulo 2**64, which any narrower width divides, then at the type's width."""
    rows = buffers.withColumn("value", wrap(F.col("value"), BUILT_IN["int64"]))
    out = reduced(rows, Pairwise(np.multiply), BUILT_IN["int64"], by_rank=by_rank)
    return out.withColumn("value", wrap(F.col("value"), dtype))


def _unsigned(op: Pairwise) -> Callable[..., np.ndarray]:
    """The function over the bits of longs."""
    return lambda a, b, *rest: np.asarray(op.fn(a.view(np.uint64), b.view(np.uint64), *rest)).view(np.int64)
