"""A named, typed column: an expression over one frame, evaluated only when asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe import dtypes as D
from quillframe.errors import CastError, IndexOutOfBounds, OtherError, TypeMismatch, UnsupportedOperation
from quillframe.functions import expressions as E
from quillframe.functions.strings import Strings

if TYPE_CHECKING:
    from quillframe.frame import Frame


class Col:
    """Built from values with ``Col.new``, or taken from a frame.

    Operators between columns of one frame are expressions over it; columns of
    different frames are first lined up by position.
    """

    def __init__(self, frame: Frame, expr: Column, name: str, dtype: D.DType, ascending: bool = False, descending: bool = False) -> None:
        self.frame, self.expr, self.name, self.dtype = frame, expr, name, dtype
        self.sorted_ascending, self.sorted_descending = ascending, descending

    # -- construction -------------------------------------------------------------------------

    @classmethod
    def new(cls, spark: SparkSession, name: str, values: Any, dtype: D.DType | None = None) -> Col:
        """A column of any sequence; its type is that of the first value which is not null, unless given."""
        from quillframe.sources.literals import frame_of

        return frame_of(spark, {name: values}, {name: dtype} if dtype else None).column(name)

    new_from_options = new

    @classmethod
    def new_empty(cls, spark: SparkSession, name: str = "", dtype: D.DType = D.Null) -> Col:
        return cls.new(spark, name, [], dtype)

    @classmethod
    def new_list(cls, spark: SparkSession, name: str, cells: list[Col | None]) -> Col:
        """A list column whose cells are columns; all must have one type, and without cells it is Null."""
        kinds = {c.dtype for c in cells if c is not None}
        if len(kinds) > 1:
            raise OtherError(f"cells of '{name}' have types {sorted(kinds)}")
        return cls.new(spark, name, [None if c is None else c.take_inner() for c in cells], D.list_of(kinds.pop() if kinds else D.Null))

    def _as(self, expr: Column, name: str | None = None, dtype: D.DType | None = None) -> Col:
        return Col(self.frame, expr, self.name if name is None else name, dtype or self.dtype)

    # -- reading ------------------------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """One column, in row order where the frame has one."""
        return self.frame._in_order().select(self.expr.cast(self.dtype.spark).alias(self.name, metadata=self.dtype.field("x").metadata))

    def to_frame(self) -> Frame:
        return self.frame.with_columns_only([self])

    def take_inner(self) -> list:
        from quillframe.frame import collected

        return [self._told(r[0]) for r in collected(self.to_df())]

    data = take_inner

    def __iter__(self) -> Iterator:
        from quillframe.frame import computed

        return (self._told(r[0]) for r in computed(self.to_df().toLocalIterator))

    def _told(self, value: Any) -> Any:
        """A stored value as Python has it: wide unsigned integers are stored as decimals."""
        return int(value) if self.dtype == D.UInt64 and value is not None else value

    def iter_valid(self) -> Iterator:
        return (v for v in self if v is not None)

    def length(self) -> int:
        return self.frame.height()

    def is_empty(self) -> bool:
        return self.frame.df.isEmpty()

    def get(self, i: int) -> Any:
        """The value at a position; None for null and outside."""
        rows = self.slice(i, 1).take_inner() if i >= 0 else []
        return rows[0] if rows else None

    def get_opt(self, i: int) -> Any:
        """Like ``get``, but a position outside is an error."""
        rows = self.slice(i, 1).take_inner() if i >= 0 else []
        if not rows:
            raise IndexOutOfBounds(i, self.length())
        return rows[0]

    def get_str(self, i: int) -> str | None:
        """The cell as text; a null is ``null``, but a null list is None."""
        value = self.get_opt(i)
        return (None if self.dtype.inner else "null") if value is None else show_value(value)

    def get_as_f64(self, i: int) -> float | None:
        value = self.get_opt(i)
        return float(value) if self.dtype.is_numeric and value is not None else None

    def is_null_at(self, i: int) -> bool:
        return self.get(i) is None

    def get_inner_series(self, i: int) -> Col | None:
        """A list cell as a column."""
        value = self.get(i)
        return None if value is None else Col.new(self.frame.spark, self.name, value, self.dtype.inner)

    def __repr__(self) -> str:
        return f"Col(name={self.name!r}, dtype={self.dtype})"

    def __str__(self) -> str:
        if self.dtype.inner:
            rows = self.head(10).take_inner()
            return f"{self.name}: [" + ", ".join("null" if v is None else show_value(v) for v in rows) + "]"
        return "[" + ", ".join("null" if v is None else show_value(v) for v in self) + "]"

    # -- names, types, order ------------------------------------------------------------------

    def rename(self, name: str) -> Col:
        return self._as(self.expr, name)

    with_name = rename

    def cast(self, to: D.DType, strict: bool = True) -> Col:
        """Strict casts change nothing but the type of columns without values; others go through Spark's try_cast."""
        if not strict:
            return self._as(self.expr.try_cast(to.spark), dtype=to)
        if to == self.dtype == D.Float64:
            return self
        if not self.frame.df.filter(self.expr.isNotNull()).isEmpty():
            raise CastError(f"column '{self.name}' of {self.dtype} can't become {to}")
        return self._as(F.lit(None).cast(to.spark), dtype=to)

    def copy(self) -> Col:
        """The same column; its flags can be set without touching this one's."""
        return Col(self.frame, self.expr, self.name, self.dtype, self.sorted_ascending, self.sorted_descending)

    clone_box = copy

    def as_any(self) -> Col | Strings:
        """The view that fits the type: string functions of a string column, else the column itself."""
        return self.str if self.dtype == D.String else self

    def expect(self, dtype: D.DType) -> Col:
        if self.dtype != dtype:
            raise TypeMismatch(self.name, dtype, self.dtype)
        return self

    def is_sorted(self) -> bool:
        return self.sorted_ascending or self.sorted_descending

    def get_flags(self) -> dict[str, bool]:
        return {"is_sorted_ascending": self.sorted_ascending, "is_sorted_descending": self.sorted_descending}

    def set_sorted_flag(self, ascending: bool, descending: bool = False) -> Col:
        """A hint, not verified; no operation relies on it."""
        self.sorted_ascending, self.sorted_descending = ascending, descending
        return self

    def sort(self, reverse: bool = False) -> Col:
        """Nulls first, or last in reverse.  Floats have no total order and are refused."""
        if self.dtype.is_float or self.dtype.inner:
            raise UnsupportedOperation(f"a column of {self.dtype} can't be sorted by itself")
        out = self.to_frame()
        key = F.col(f"`{self.name}`")
        made = out._sorted([key.desc_nulls_last() if reverse else key.asc_nulls_first()]).column(self.name)
        return made.set_sorted_flag(not reverse, reverse)

    def push(self, value: Any) -> Col:
        """With one more value at the end; a column of Null takes the value's type."""
        from quillframe.sources.literals import frame_of

        dtype = D.of_value(value) if self.dtype == D.Null else self.dtype
        last = frame_of(self.frame.spark, {self.name: [value]}, {self.name: dtype})
        return self._as(self.expr.cast(dtype.spark), dtype=dtype).to_frame()._below(last).column(self.name)

    def clear(self) -> Col:
        return Col.new_empty(self.frame.spark, self.name)

    # -- rows ---------------------------------------------------------------------------------

    def head(self, n: int = 5) -> Col:
        return self.to_frame().head(n).column(self.name)

    def tail(self, n: int = 5) -> Col:
        return self.to_frame().tail(n).column(self.name)

    def slice(self, offset: int, length: int) -> Col:
        return self.to_frame().slice(offset, length).column(self.name)

    def filter(self, mask: Col) -> Col:
        """Values where the mask is true; masks of another length are an error."""
        mine, theirs = self.aligned(mask)
        out = mine.frame.with_columns_only([mine, theirs.rename("__mask")])
        return out.filter(out.column("__mask")).drop("__mask").column(self.name)

    def to_frame_named(self, name: str) -> Frame:
        return self.rename(name).to_frame()

    def take_indices(self, indices: list[int | None]) -> Col:
        """Values at the positions, repeats allowed; outside is an error, None gives null."""
        return self.to_frame().take(indices).column(self.name)

    take_indices_option = take_indices

    def aligned(self, other: Col) -> tuple[Col, Col]:
        """Both columns over one frame, matched by position if they come from two."""
        if self.frame is other.frame or self.frame.df is other.frame.df:
            return self, Col(self.frame, other.expr, other.name, other.dtype)
        return self.frame._beside(self, other)

    # -- arithmetic and comparison ------------------------------------------------------------

    def _operand(self, other: Any) -> tuple[Col, Column]:
        """This column and the other side, over one frame and in one type."""
        if isinstance(other, Col):
            mine, theirs = self.aligned(other)
            if theirs.dtype != mine.dtype:
                raise TypeMismatch(theirs.name, mine.dtype, theirs.dtype)
            return mine, theirs.expr
        if self.dtype.is_integer and isinstance(other, int) and other >= 2**63:
            other = Decimal(other)
        return self, F.lit(other).cast(self.dtype.spark)

    def _arith(self, kind: str, other: Any, name: str | None = None, zero: str = "null") -> Col:
        mine, value = self._operand(other)
        if not mine.dtype.is_numeric:
            raise TypeMismatch(mine.name, "a number", mine.dtype)
        return mine._as(E.arithmetic(kind, mine.expr, value, mine.dtype, zero), name)

    def __add__(self, other: Any) -> Col:
        return self._arith("add", other)

    def __sub__(self, other: Any) -> Col:
        return self._arith("sub", other)

    def __mul__(self, other: Any) -> Col:
        return self._arith("mul", other)

    def __truediv__(self, other: Any) -> Col:
        """Null where the divisor is zero; integers truncate."""
        return self._arith("div", other)

    def __mod__(self, other: Any) -> Col:
        return self._arith("rem", other)

    def _scalar(self, kind: str, value: Any) -> Col:
        by_zero = "_by_zero" if kind in ("div", "rem") and value == 0 else ""
        return self._arith(kind, value, f"{self.name}_{kind}_scalar{by_zero}")

    def _series(self, kind: str, other: Col) -> Col:
        return self._arith(kind, other, f"{self.name}_{kind}_series_{other.name}", "ieee")

    def _compare(self, kind: str, other: Any) -> Col:
        mine, value = self._operand(other)
        return mine._as(E.compare(kind, mine.expr, value, mine.dtype), f"{self.name}_{kind}_{'series' if isinstance(other, Col) else 'scalar'}", D.Bool)

    def __and__(self, other: Col) -> Col:
        mine, value = self._operand(other)
        return mine._as(mine.expr & value)

    def __or__(self, other: Col) -> Col:
        mine, value = self._operand(other)
        return mine._as(mine.expr | value)

    def __invert__(self) -> Col:
        return self._as(~self.expr)

    # -- nulls and NaN ------------------------------------------------------------------------

    def is_null(self) -> Col:
        return self._as(self.expr.isNull(), f"{self.name}_is_null", D.Bool)

    def not_null(self) -> Col:
        return self._as(self.expr.isNotNull(), f"{self.name}_not_null", D.Bool)

    def _float_only(self) -> None:
        if not self.dtype.is_float:
            raise TypeMismatch(self.name, "a float", self.dtype)

    def is_nan(self) -> Col:
        """Null is no NaN."""
        self._float_only()
        return self._as(F.coalesce(F.isnan(self.expr), F.lit(False)), f"{self.name}_is_nan", D.Bool)

    def is_not_nan(self) -> Col:
        self._float_only()
        return self._as(~F.coalesce(F.isnan(self.expr), F.lit(False)), f"{self.name}_is_not_nan", D.Bool)

    def is_infinite(self) -> Col:
        self._float_only()
        return self._as(F.coalesce(F.abs(self.expr) == float("inf"), F.lit(False)), f"{self.name}_is_infinite", D.Bool)

    def fill_null(self, value: Any) -> Col:
        return self._as(F.coalesce(self.expr, F.lit(value).cast(self.dtype.spark)))

    # -- reductions ---------------------------------------------------------------------------

    def reduction(self, kind: str) -> Column:
        """``sum min max mean len all any`` as an aggregate expression, for use in a plan."""
        if kind in ("all", "any"):
            self.expect(D.Bool)
            if kind == "all":
                return F.coalesce(F.bool_and(F.coalesce(self.expr, F.lit(False))), F.lit(True))
            return F.coalesce(F.bool_or(self.expr), F.lit(False))
        return E.reduce(kind, self.expr, self.dtype)

    def _reduced(self, kind: str) -> Any:
        from quillframe.frame import computed

        value = computed(lambda: self.frame.df.agg(self.reduction(kind)).first()[0])
        return value if kind == "mean" else self._told(value)

    def sum(self) -> Any:
        return self._reduced("sum")

    def min(self) -> Any:
        return self._reduced("min")

    def max(self) -> Any:
        return self._reduced("max")

    def mean(self) -> float | None:
        return self._reduced("mean")

    def all(self) -> bool:
        """Null counts as false; true without rows."""
        return self._reduced("all")

    def any(self) -> bool:
        return self._reduced("any")

    # -- order of rows, equality --------------------------------------------------------------

    def compare_rows(self, other: Col) -> Col:
        """-1, 0 or 1 by whether this column's value stands before, with or after the other's in rising order.

        Nulls come last and are equal; NaN is above all numbers and equal to itself.
        """
        mine, value = self._operand(other)
        if mine.dtype.inner:
            raise UnsupportedOperation(f"'{mine.name}' is a list column and has no order")
        order = F.when(mine.expr.eqNullSafe(value), 0).when(mine.expr.isNull(), 1).when(value.isNull(), -1).when(mine.expr < value, -1).otherwise(1)
        return mine._as(order.cast("int"), f"{mine.name}_order", D.Int32)

    def compare_row(self, i: int, j: int) -> int:
        """How the values at two positions are ordered, by the rules of ``compare_rows``."""
        if self.dtype.inner:
            raise UnsupportedOperation(f"'{self.name}' is a list column and has no order")
        # Of a null, a number and a NaN the last part decides; values of one column compare with each other.
        a, b = ((v is None, v != v, v) for v in self.take_indices([i, j]).take_inner())
        if a[:2] != b[:2]:
            return -1 if a[:2] < b[:2] else 1
        return 0 if a[0] or a[1] or a[2] == b[2] else -1 if a[2] < b[2] else 1

    def _differs(self, other: Col, same: Callable[[Column, Column], Column]) -> bool:
        if self.length() != other.length():
            return True
        mine, theirs = self.aligned(other)
        return not mine.frame.df.filter(~same(mine.expr, theirs.expr)).isEmpty()

    def equals(self, other: Col) -> bool:
        """Name, type and values; NaN differs from itself, null equals null."""
        if (self.name, self.dtype) != (other.name, other.dtype):
            return False
        nan = (lambda a: F.coalesce(F.isnan(a), F.lit(False))) if self.dtype.is_float else (lambda a: F.lit(False))
        return not self._differs(other, lambda a, b: a.eqNullSafe(b) & ~nan(a))

    equals_missing = equals

    def series_equal(self, other: Col) -> bool:
        """Type and values, whatever the names; NaN equals NaN."""
        return self.dtype == other.dtype and not self._differs(other, lambda a, b: a.eqNullSafe(b))

    # -- strings and user functions -----------------------------------------------------------

    @property
    def str(self) -> Strings:
        return Strings(self)

    def apply(self, f: Callable, dtype: D.DType | None = None, native: bool = False) -> Col:
        """A function of each value, null included.

        With ``native`` the function maps a Spark column to a Spark column and
        stays in the JVM; otherwise it is called in Python for every value, in
        Arrow batches.  Functions must not depend on earlier calls.
        """
        to = dtype or self.dtype
        if native:
            return self._as(f(self.expr).cast(to.spark), dtype=to)
        return self._as(F.udf(f, to.spark, useArrow=True)(self.expr), dtype=to)

    par_apply = apply
    map = apply


def _add_named() -> None:
    """gt, gt_scalar, gt_series, add_scalar, add_series and so on."""
    for kind in E.COMPARE:
        def named(self, other, kind=kind):
            return self._compare(kind, other)

        for name in (kind, f"{kind}_scalar", f"{kind}_series"):
            setattr(Col, name, named)
    for kind in ("add", "sub", "mul", "div", "rem"):
        setattr(Col, f"{kind}_scalar", lambda self, value, kind=kind: self._scalar(kind, value))
        setattr(Col, f"{kind}_series", lambda self, other, kind=kind: self._series(kind, other))


_add_named()


def show_value(value: Any) -> str:
    """A cell as text: no ``.0`` on whole floats, never an exponent, lists cut after five."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "inf" if value > 0 else "-inf"
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, (list, tuple)):
        cells = ["null" if v is None else show_value(v) for v in value[:5]]
        return "[" + ", ".join(cells + ["..."] * (len(value) > 5)) + "]"
    return str(value)
