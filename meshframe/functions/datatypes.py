"""Element types: their Spark types, integer wrap-around, and 16-bit floats.

Integers wrap in two's complement at their own width. float16 and bfloat16 are held as FLOAT columns whose values the
16-bit type can represent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument

WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class DataType:
    name: str
    bytes: int
    spark: str
    kind: str  # int, uint, float, custom
    #: The structured numpy type of a custom element, as which reductions see it.
    record: object = None


#: The element types and their sizes in bytes.
BUILT_IN = {
    t.name: t
    for t in (
        DataType("int8", 1, "tinyint", "int"),
        DataType("uint8", 1, "smallint", "uint"),
        DataType("int16", 2, "smallint", "int"),
        DataType("uint16", 2, "int", "uint"),
        DataType("int32", 4, "int", "int"),
        DataType("uint32", 4, "bigint", "uint"),
        DataType("int64", 8, "bigint", "int"),
        DataType("uint64", 8, "decimal(20,0)", "uint"),
        DataType("float16", 2, "float", "float"),
        DataType("float32", 4, "float", "float"),
        DataType("float64", 8, "double", "float"),
        DataType("bfloat16", 2, "float", "float"),
    )
}


class Registry:
    """Built-in types and those that users add: opaque elements of a fixed number of bytes, held as BINARY."""

    def __init__(self):
        self._custom: dict[str, DataType] = {}
        self._next = len(BUILT_IN)

    def register(self, size: int, record=None) -> DataType:
        """record: what numpy makes a type of, such as [("value", ">i8"), ("at", ">i8")], if elements are to be reduced."""
        if size <= 0:
            raise InvalidArgument("an element has at least one byte")
        record = None if record is None else np.dtype(record)
        if record is not None and record.itemsize != size:
            raise InvalidArgument(f"a record of {record.itemsize} bytes in an element of {size}")
        dtype = DataType(f"DTYPE_{self._next}", size, "binary", "custom", record)
        self._next += 1
        self._custom[dtype.name] = dtype
        return dtype

    def deregister(self, dtype: DataType | str) -> None:
        name = dtype if isinstance(dtype, str) else dtype.name
        if self._custom.pop(name, None) is None:
            raise InvalidArgument(f"{name} is no registered custom type")

    def __getitem__(self, name: str | DataType) -> DataType:
        if isinstance(name, DataType):
            return name
        found = BUILT_IN.get(name) or self._custom.get(name)
        if found is None:
            raise InvalidArgument(f"unknown element type {name}")
        return found

    def size(self, name: str) -> int:
        return self[name].bytes


REGISTRY = Registry()


def wrap(value: Column, dtype: DataType) -> Column:
    """An integer of any size to the type's width, as two's complement arithmetic leaves it."""
    bits = 8 * dtype.bytes
    span = F.lit(str(1 << bits)).cast(WIDE)
    if dtype.kind == "uint":
        return F.pmod(value.cast(WIDE), span).cast(dtype.spark)
    half = F.lit(str(1 << (bits - 1))).cast(WIDE)
    return (F.pmod(value.cast(WIDE) + half, span) - half).cast(dtype.spark)


def times(a: Column, b: Column, bits: int) -> Column:
    """a * b modulo 2**bits for 0 <= a, b < 2**bits, in steps that a decimal of 38 digits holds."""
    span = F.lit(str(1 << bits)).cast(WIDE)
    if bits <= 32:
        return F.pmod((a * b).cast(WIDE), span)
    low = F.lit(str(1 << 32)).cast(WIDE)
    low_part = F.pmod(b, low)
    high = ((b - low_part) / low).cast(WIDE)  # exact: no fraction is left to round
    high_part = F.pmod((F.pmod((a * high).cast(WIDE), span) * low).cast(WIDE), span)
    return F.pmod((high_part + (a * low_part).cast(WIDE)).cast(WIDE), span).cast(WIDE)


def _place(value: Column, digits: int, least: int) -> Column:
    """The value of the last binary place of a DOUBLE that is kept to so many digits, 2**least at least."""
    size = F.abs(value)
    near = F.pow(F.lit(2.0), F.floor(F.log2(size)))  # one power off at most; comparisons put it right
    power = F.when(near > size, near / 2).when(near * 2 <= size, near * 2).otherwise(near)
    return F.greatest(power * 2.0 ** (1 - digits), F.lit(2.0**least))


def _fixed(value: Column) -> Column:
    """Values that no format changes: zeros, infinities, NaN."""
    return (value == 0) | F.isnan(value) | (F.abs(value) == float("inf"))


def truncate_bf16(value: Column) -> Column:
    """A FLOAT with the lower half of its bits cleared: 8 binary digits, what is below them dropped."""
    x = value.cast("double")
    return F.when(value.isNull() | _fixed(x), value.cast("float")).otherwise(x - x % _place(x, 8, -133)).cast("float")


def _to_nearest(value: Column, digits: int, least: int, over: float) -> Column:
    """To so many binary digits, ties to even; from over on infinite."""
    x = value.cast("double")
    place = _place(x, digits, least)
    rest = x % place
    low = x - rest
    odd = F.abs(low / place) % 2 == 1
    up = (F.abs(rest) * 2 > place) | ((F.abs(rest) * 2 == place) & odd)
    whole = F.when(up, low + F.signum(x) * place).otherwise(low)
    whole = F.when(F.abs(whole) >= over, F.signum(x) * float("inf")).otherwise(whole)
    return F.when(value.isNull() | _fixed(x), value.cast("float")).otherwise(whole).cast("float")


def round_bf16(value: Column) -> Column:
    """A FLOAT rounded to the nearest bfloat16, ties to even; NaN and infinities stay."""
    return _to_nearest(value, 8, -133, 2.0**128)


def round_fp16(value: Column) -> Column:
    """A FLOAT rounded to the nearest float16, ties to even; NaN and infinities stay."""
    return _to_nearest(value, 11, -24, 65536.0)


def to_element(value: Column, dtype: DataType, rounding: str = "truncate") -> Column:
    """A wide result as an element of the type."""
    if dtype.kind in ("int", "uint"):
        return wrap(value, dtype)
    if dtype.name == "bfloat16":
        return truncate_bf16(value) if rounding == "truncate" else round_bf16(value)
    if dtype.name == "float16":
        return round_fp16(value.cast("float"))
    return value.cast(dtype.spark)
