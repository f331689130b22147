"""Logical column types and how Spark stores them.

Unsigned integers are stored in the next wider signed type; the logical type
stays in the column's metadata.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import total_ordering

from pyspark.sql import types as T

META = "quillframe.dtype"
#: Type names in their order.
ORDER = ["Null", "Bool", "Int8", "Int16", "Int32", "Int64", "Int128", "UInt8", "UInt16", "UInt32", "UInt64", "UInt128", "Float32", "Float64", "String", "List"]
_STORED = {
    "Null": T.NullType(), "Bool": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Int128": T.DecimalType(38, 0),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0), "UInt128": T.DecimalType(38, 0),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType(),
}
_BITS = {"Int8": 8, "Int16": 16, "Int32": 32, "Int64": 64, "UInt8": 8, "UInt16": 16, "UInt32": 32, "UInt64": 64}


@total_ordering
@dataclass(frozen=True)
class DType:
    name: str
    inner: DType | None = None

    def __str__(self) -> str:
        return f"List({self.inner})" if self.inner else self.name

    __repr__ = __str__

    def __lt__(self, other: DType) -> bool:
        if self.name != other.name:
            return ORDER.index(self.name) < ORDER.index(other.name)
        return bool(self.inner and other.inner and self.inner < other.inner)

    @property
    def is_float(self) -> bool:
        return self.name in ("Float32", "Float64")

    @property
    def is_integer(self) -> bool:
        return "Int" in self.name

    @property
    def is_numeric(self) -> bool:
        """Floats and integers of up to 64 bits."""
        return self.is_float or self.name in _BITS

    @property
    def bounds(self) -> tuple[int, int]:
        """Smallest and largest value of an integer type."""
        bits = _BITS[self.name]
        return (0, 2**bits - 1) if self.name[0] == "U" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)

    @property
    def spark(self) -> T.DataType:
        return T.ArrayType(self.inner.spark, True) if self.inner else _STORED[self.name]

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.spark, True, {META: str(self)} if self.name[0] == "U" else {})


Null, Bool, Int8, Int16, Int32, Int64, Int128, UInt8, UInt16, UInt32, UInt64, UInt128, Float32, Float64, String = (DType(n) for n in ORDER[:-1])


def list_of(inner: DType) -> DType:
    return DType("List", inner)


def parse(text: str) -> DType:
    """The type that ``str`` of it gives back."""
    return list_of(parse(text[5:-1])) if text.startswith("List(") else DType(text)


def of_field(field: T.StructField) -> DType:
    """The logical type of a Spark column; types beyond these (timestamps, decimals) keep Spark's name."""
    if META in field.metadata:
        return parse(field.metadata[META])
    return of_spark(field.dataType)


def of_spark(kind: T.DataType) -> DType:
    if isinstance(kind, T.ArrayType):
        return list_of(of_spark(kind.elementType))
    for name in ("Null", "Bool", "Int8", "Int16", "Int32", "Int64", "Float32", "Float64"):
        if kind == _STORED[name]:
            return DType(name)
    if isinstance(kind, T.StringType):
        return String
    return Other(kind)


class Other(DType):
    """A Spark type outside of the logical ones; it passes through and counts as no number."""

    def __init__(self, kind: T.DataType) -> None:
        super().__init__("String")
        object.__setattr__(self, "kind", kind)

    def __str__(self) -> str:
        return self.kind.simpleString()

    __repr__ = __str__

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Other) and self.kind == other.kind

    def __hash__(self) -> int:
        return hash(str(self))

    @property
    def spark(self) -> T.DataType:
        return self.kind


def of_value(value: object) -> DType:
    """The type that a Python value has by itself: int is Int32 where it fits, else Int64, else UInt64."""
    if value is None:
        return Null
    if isinstance(value, bool):
        return Bool
    if isinstance(value, int):
        return Int32 if -(2**31) <= value < 2**31 else Int64 if value < 2**63 else UInt64
    if isinstance(value, float):
        return Float64
    if isinstance(value, str):
        return String
    if isinstance(value, (list, tuple)):
        return list_of(of_values(value))
    raise ValueError(f"no column type holds {type(value).__name__}")


def of_values(values) -> DType:
    """The type of the first value that is not null; integers widen to hold all of them."""
    kinds = [of_value(v) for v in values if v is not None]
    if not kinds:
        return Null
    if kinds[0] in (Int32, Int64):
        return max(kinds, key=[Int32, Int64, UInt64].index) if set(kinds) <= {Int32, Int64, UInt64} else kinds[0]
    return kinds[0]
