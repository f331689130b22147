"""Grouped aggregation.  Rows with a null in a key belong to no group."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.dtypes import DType, Other
from quillframe.errors import DuplicateColumnName, UnsupportedOperation
from quillframe.functions.expressions import group_aggregate

if TYPE_CHECKING:
    from quillframe.frame import Frame

#: Key types and summed types of strict mode.
KEYS = ("Int32", "String", "Bool")
SUMMED = ("Int32", "UInt32", "Float32", "Float64")


class GroupBy:
    def __init__(self, frame: Frame, keys: list[str]) -> None:
        for k in keys:
            dtype = frame.dtype(k)
            if frame.strict and (dtype.name not in KEYS or isinstance(dtype, Other)) or dtype.inner:
                raise UnsupportedOperation(f"'{k}' of {dtype} can't be a group key")
        self.frame, self.keys = frame, keys

    def _aggregate(self, made: dict[str, Column], types: dict[str, DType]) -> Frame:
        names = [*self.keys, *made]
        for i, n in enumerate(names):
            if n in names[:i]:
                raise DuplicateColumnName(n)
        rows = self.frame.df
        for k in self.keys:
            rows = rows.filter(F.col(f"`{k}`").isNotNull())
        out = rows.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(*(c.alias(n) for n, c in made.items()), F.count(F.lit(1)).alias("__rows"))
        # Without keys Spark gives a row even where there is none to group.
        if not self.keys:
            out = out.filter(F.col("__rows") > 0)
        columns = [F.col(f"`{k}`") for k in self.keys] + [F.col(f"`{n}`").alias(n, metadata=types[n].field(n).metadata) for n in made]
        return self.frame._with(out.select(*columns))

    def _values(self, wanted) -> dict[str, DType]:
        return {n: t for n, t in self.frame.schema().items() if n not in self.keys and wanted(t)}

    def _each(self, kind: str, wanted) -> Frame:
        values = self._values(wanted)
        return self._aggregate({n: group_aggregate(kind, F.col(f"`{n}`"), t) for n, t in values.items()}, values)

    def count(self) -> Frame:
        """Rows of each group, in a column ``count``."""
        from quillframe.dtypes import UInt32

        return self._aggregate({"count": F.count(F.lit(1))}, {"count": UInt32})

    def sum(self) -> Frame:
        """Sums of number columns, in their own type; strict mode leaves out all but four types."""
        return self._each("sum", lambda t: not isinstance(t, Other) and (t.name in SUMMED if self.frame.strict else t.is_numeric))

    def mean(self) -> Frame:
        values = self._values(lambda t: t.is_numeric and not isinstance(t, Other))
        from quillframe.dtypes import Float64

        return self._aggregate({n: group_aggregate("mean", F.col(f"`{n}`"), t) for n, t in values.items()}, dict.fromkeys(values, Float64))

    def min(self) -> Frame:
        """Of every column with an order; strings and booleans included."""
        return self._each("min", self._ordered)

    def max(self) -> Frame:
        return self._each("max", self._ordered)

    def _ordered(self, t: DType) -> bool:
        return not t.inner and t.name != "Null" and (not self.frame.strict or not isinstance(t, Other))


