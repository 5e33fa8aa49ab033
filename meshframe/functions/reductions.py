"""Reductions as aggregate expressions.

Sums of integers are exact (DECIMAL) and wrapped once, which equals wrapping at each step. Products of integers as an
aggregate fold a list, which is for lists of a value a rank; pairwise.py multiplies any number of values.
min and max are Spark's (NaN is largest). bfloat16 and float16 are reduced in double precision with one conversion at the
end; orders.py has reductions in a fixed order, with a conversion at each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import WIDE, DataType, times, to_element

SUM, PROD, MIN, MAX = "sum", "prod", "min", "max"
#: A custom reduction: from a column to an aggregate (a grouped pandas UDF will do).
Custom = Callable[[Column], Column]


def _wide(value: Column, dtype: DataType) -> Column:
    return value.cast(WIDE) if dtype.kind in ("int", "uint") and dtype.bytes == 8 else value.cast("bigint") if dtype.kind in ("int", "uint") else value.cast("double")


def reduction(op: str | Custom, value: Column, dtype: DataType, rounding: str = "truncate") -> Column:
    """The aggregate that reduces value over the rows of a group."""
    if callable(op):
        return op(value)
    partial, _, finish = stages(op, dtype, rounding)
    return finish(partial(value))


def stages(op: str, dtype: DataType, rounding: str = "truncate") -> tuple[Callable[[Column], Column], ...]:
    """(partial, merge, finish): an aggregate of values in the wide type, one of such results, and their conversion to the
    element type, which is done once however many levels there are."""
    if callable(op):
        raise InvalidArgument("a reduction of the caller's own is no more than one aggregate")
    if dtype.kind == "custom":
        raise InvalidArgument("elements of a custom type need a pairwise reduction")
    if op == SUM:
        return lambda v: F.sum(_wide(v, dtype)), F.sum, lambda w: to_element(w, dtype, rounding)
    if op == PROD and dtype.kind == "float":
        return lambda v: F.product(v.cast("double")), F.product, lambda w: to_element(w, dtype, rounding)
    if op == PROD:
        return lambda v: _product(v, dtype), lambda w: _product(w, dtype), lambda w: to_element(w, dtype)
    if op in (MIN, MAX):
        least = F.min if op == MIN else F.max
        return least, least, lambda w: w.cast(dtype.spark)
    raise InvalidArgument(f"unknown reduction {op}")


def both(op: str, values: list[Column]) -> Column:
    """Partial results of columns side by side as one, nulls passed over as aggregates do; not for products of integers."""
    if op in (MIN, MAX):
        return (F.least if op == MIN else F.greatest)(*values) if len(values) > 1 else values[0]
    out = values[0]
    for v in values[1:]:
        out = F.coalesce(out + v if op == SUM else out * v, out, v)
    return out


def _product(value: Column, dtype: DataType) -> Column:
    bits = 8 * dtype.bytes
    values = F.collect_list(F.pmod(value.cast(WIDE), F.lit(str(1 << bits)).cast(WIDE)))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit("1").cast(WIDE), lambda a, b: times(a, b, bits).cast(WIDE)))
