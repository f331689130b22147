"""The frame: a Spark DataFrame with named, typed columns and, where asked for, a row order."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.errors import ArithmeticException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe import dtypes as D
from quillframe.column import Col, show_value
from quillframe.functions.expressions import OVERFLOW
from quillframe.errors import ColumnNotFound, ComputeError, DuplicateColumnName, IndexOutOfBounds, InvalidArgument, MismatchedLengths, TypeMismatch, UnsupportedOperation

ROW = "__row"
_PART_BITS = 33  # of monotonically_increasing_id, for the row within a partition


class Frame:
    """Wraps ``df``.  A hidden column ``__row`` rises in row order, with gaps, once an operation needs one."""

    def __init__(self, df: DataFrame, strict: bool = True) -> None:
        names = [c for c in df.columns if c != ROW]
        _unique(names)
        self.df, self.strict = df, strict
        self._keys: list[tuple[str, bool]] = []  # of a sort that nothing followed: top rows then need no full sort
        self._types = {f.name: D.of_field(f) for f in df.schema.fields if f.name != ROW}

    # -- construction -------------------------------------------------------------------------

    @classmethod
    def new(cls, columns: list[Col]) -> Frame:
        """A frame of columns of equal length with different names."""
        _unique([c.name for c in columns])
        if not columns:
            raise InvalidArgument("give a session: Frame.new_empty(spark)")
        out = columns[0].to_frame()
        for c in columns[1:]:
            out.add_column(c)
        return out

    @classmethod
    def new_empty(cls, spark: SparkSession) -> Frame:
        from pyspark.sql.types import StructType

        return cls(spark.createDataFrame([], StructType([])))

    def _with(self, df: DataFrame) -> Frame:
        return Frame(df, self.strict)

    def copy(self) -> Frame:
        """The same rows; adding, dropping or renaming columns of the copy leaves this frame as it is."""
        out = Frame(self.df, self.strict)
        out._keys = list(self._keys)
        return out

    def extended(self) -> Frame:
        """The same rows without the type limits of strict mode."""
        return Frame(self.df, strict=False)

    # -- schema -------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def columns_names(self) -> list[str]:
        return list(self._types)

    def dtypes(self) -> list[D.DType]:
        return list(self._types.values())

    def schema(self) -> dict[str, D.DType]:
        return dict(self._types)

    def height(self) -> int:
        return self.df.count() if self._types else 0

    def width(self) -> int:
        return len(self._types)

    def shape(self) -> tuple[int, int]:
        return self.height(), self.width()

    def is_empty(self) -> bool:
        return not self._types or self.df.isEmpty()

    def dtype(self, name: str) -> D.DType:
        if name not in self._types:
            raise ColumnNotFound(name)
        return self._types[name]

    # -- columns ------------------------------------------------------------------------------

    def column(self, name: str) -> Col:
        return Col(self, F.col(f"`{name}`"), name, self.dtype(name))

    column_mut = column
    __getitem__ = column

    def column_at(self, i: int) -> Col:
        if not 0 <= i < self.width():
            raise ColumnNotFound(f"index {i}")
        return self.column(self.columns_names()[i])

    column_at_mut = column_at

    def downcast_column(self, name: str, dtype: D.DType) -> Col:
        found = self.column(name)
        if found.dtype != dtype:
            raise TypeMismatch(name, dtype, found.dtype)
        return found

    def _hidden(self) -> list[Column]:
        return [F.col(ROW)] if ROW in self.df.columns else []

    def select(self, names: Iterable[str]) -> Frame:
        names = list(names)
        for n in names:
            self.dtype(n)
        _unique(names)
        return self._with(self.df.select(*(F.col(f"`{n}`") for n in names), *self._hidden()))

    def with_columns_only(self, columns: list[Col]) -> Frame:
        """A frame of the given columns of this one."""
        _unique([c.name for c in columns])
        return self._with(self.df.select(*(c.expr.cast(c.dtype.spark).alias(c.name, metadata=c.dtype.field("x").metadata) for c in columns), *self._hidden()))

    def drop(self, name: str) -> Frame:
        self.dtype(name)
        return self.select([n for n in self._types if n != name])

    def drop_column(self, name: str) -> Col:
        """Remove a column from this frame, and return it."""
        gone = Frame(self.df, self.strict).column(name)
        self.__init__(self.drop(name).df, self.strict)
        return gone

    def add_column(self, column: Col) -> Frame:
        """Append a column to this frame: an expression over it, or foreign rows matched by position."""
        if column.name in self._types:
            raise DuplicateColumnName(column.name)
        if not self._types:
            made = column.to_frame()
        elif column.frame is self or column.frame.df is self.df:
            made = self.with_columns_only([*map(self.column, self._types), column])
        else:
            mine, theirs = _matched(self, column.to_frame(), column.name)
            made = self._with(mine.join(theirs, ROW))
        self.__init__(made.df, self.strict)
        return self

    def rename_column(self, old: str, new: str) -> Frame:
        """Rename in place of the old name; the same name changes nothing."""
        self.dtype(old)
        if new != old:
            if new in self._types:
                raise DuplicateColumnName(new)
            self.__init__(self.df.withColumnRenamed(old, new), self.strict)
        return self

    # -- rows ---------------------------------------------------------------------------------

    def with_rows(self) -> Frame:
        """With a row order: that of the scan, unless there is one."""
        return self if ROW in self.df.columns else self._with(self.df.withColumn(ROW, F.monotonically_increasing_id()))

    def _in_order(self) -> DataFrame:
        return self.df.orderBy(ROW) if ROW in self.df.columns else self.df

    def dense(self) -> Frame:
        """With rows numbered from 0 without gaps."""
        return self._dense()[0]

    def _dense(self) -> tuple[Frame, int]:
        """With rows numbered from 0 without gaps, and how many there are.

        The rows are checkpointed, so that they lie the same in both passes;
        the first counts those of each partition, which gives every partition
        its first number.  Nothing but these counts passes through the driver.
        """
        df = _checkpointed(self._in_order()).withColumn("__at", F.monotonically_increasing_id())
        part = F.shiftright("__at", _PART_BITS)
        counts = {r[0]: r[1] for r in df.groupBy(part.alias("p")).count().collect()}
        starts, n = [], 0
        for p in sorted(counts):
            starts.append((p, n))
            n += counts[p]
        offsets = self.spark.createDataFrame(starts, "__p long, __start long")
        out = df.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(ROW, F.col("__start") + F.col("__at").bitwiseAND((1 << _PART_BITS) - 1))
        return self._with(out.select(*(F.col(f"`{c}`") for c in self._types), ROW)), n

    def _beside(self, a: Col, b: Col) -> tuple[Col, Col]:
        """Columns of two frames over one, matched by position."""
        left, right = _matched(a.to_frame_named("__a"), b.to_frame_named("__b"), b.name)
        both = self._with(left.join(right, ROW))
        return Col(both, F.col("__a"), a.name, a.dtype), Col(both, F.col("__b"), b.name, b.dtype)

    def _below(self, other: Frame) -> Frame:
        """This frame's rows, then the other's."""
        mine, theirs = self.with_rows().df, other.with_rows().df
        last = 1 << 62
        return self._with(mine.unionByName(theirs.withColumn(ROW, F.col(ROW) + last)))

    def filter(self, mask: Col) -> Frame:
        """Rows where the mask is true; null drops a row."""
        if mask.frame is self or mask.frame.df is self.df:
            return self._with(self.df.filter(mask.expr))
        mine, theirs = _matched(self, mask.to_frame_named("__mask"), mask.name)
        return self._with(mine.join(theirs, ROW).filter("__mask").drop("__mask"))

    par_filter = filter

    def head(self, n: int = 5) -> Frame:
        if self._keys:
            return self._with(self.df.limit(n))
        rows = self.with_rows()
        return rows._with(rows.df.orderBy(ROW).limit(n))

    def tail(self, n: int = 5) -> Frame:
        if self._keys:
            last = self.df.orderBy(*(_key(name, not down) for name, down in self._keys)).limit(n)
            return self._with(last.orderBy(*(_key(name, down) for name, down in self._keys)))
        rows = self.with_rows()
        return rows._with(rows.df.orderBy(F.desc(ROW)).limit(n).orderBy(ROW))

    def slice(self, offset: int, length: int) -> Frame:
        """``length`` rows from ``offset`` on, as far as there are any.  They end in one task: for pages, not for shares of a table."""
        if self._keys:
            return self._with(self.df.offset(offset).limit(length))
        rows = self.with_rows()
        return rows._with(rows.df.orderBy(ROW).offset(offset).limit(length))

    def take(self, indices: list[int | None]) -> Frame:
        """Rows at the positions, in that order; None gives a row of nulls."""
        dense, n = self._dense()
        for i in indices:
            if i is not None and not 0 <= i < n:
                raise IndexOutOfBounds(i, n)
        wanted = self.spark.createDataFrame(list(enumerate(indices)), "__out long, __want long")
        joined = wanted.join(dense.df, F.col("__want") == F.col(ROW), "left")
        return self._with(joined.select(*(F.col(f"`{c}`") for c in self._types), F.col("__out").alias(ROW)))

    def _sorted(self, keys: list[Column]) -> Frame:
        rows = self.with_rows()
        ordered = rows.df.orderBy(*keys, ROW)
        return self._with(ordered.drop(ROW))._numbered()

    def _numbered(self) -> Frame:
        return self._with(self.df.withColumn(ROW, F.monotonically_increasing_id()))

    def sort(self, by: list[str], descending: list[bool]) -> Frame:
        """By several columns.  Rising order has nulls last, falling order first; NaN is above all numbers."""
        if len(by) != len(descending):
            raise InvalidArgument(f"{len(by)} columns, but {len(descending)} directions")
        for name in by:
            if self.dtype(name).inner:
                raise UnsupportedOperation(f"'{name}' is a list column and has no order")
        if not by:
            return self
        # Sorting leaves rows in place; a row number is taken from there only if an operation asks for one.
        keys = list(zip(by, descending, strict=True))
        out = self._with(self.df.drop(ROW).orderBy(*(_key(name, down) for name, down in keys)))
        out._keys = keys
        return out

    # -- groups, joins, output (see operators/ and sources/) --------------------------------------

    def groupby(self, keys: Iterable[str]):
        from quillframe.operators.groupby import GroupBy

        return GroupBy(self, list(keys))

    def inner_join(self, right: Frame, left_on: str, right_on: str) -> Frame:
        return self._join(right, left_on, right_on, "inner")

    def left_join(self, right: Frame, left_on: str, right_on: str) -> Frame:
        return self._join(right, left_on, right_on, "left")

    def right_join(self, right: Frame, left_on: str, right_on: str) -> Frame:
        return self._join(right, left_on, right_on, "right")

    def outer_join(self, right: Frame, left_on: str, right_on: str) -> Frame:
        return self._join(right, left_on, right_on, "full_outer")

    def _join(self, right: Frame, left_on: str, right_on: str, how: str) -> Frame:
        from quillframe.operators.joins import join

        return join(self, right, left_on, right_on, how)

    def reduce(self, **columns: tuple[str, str]) -> Frame:
        """One row of whole-column reductions: ``reduce(total=("price", "sum"))``."""
        return self._with(self.df.agg(*(self.column(c).reduction(kind).alias(name) for name, (c, kind) in columns.items())))

    def to_csv(self, path: str, options=None) -> None:
        from quillframe.sources.csv_writer import write_path

        write_path(self, path, options)

    def to_csv_writer(self, out, options=None) -> None:
        from quillframe.sources.csv_writer import write

        write(self, out, options)

    def equals(self, other: Frame) -> bool:
        """Names, types and all rows, in any order; NaN equals NaN."""
        if self.schema() != other.schema() or self.columns_names() != other.columns_names():
            return False
        a, b = (f.df.select(*(F.col(f"`{c}`") for c in f._types)) for f in (self, other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def rows(self) -> list[tuple[Any, ...]]:
        told = [self.column(c)._told for c in self._types]
        return [tuple(f(v) for f, v in zip(told, r, strict=True)) for r in collected(self._in_order().select(*(F.col(f"`{c}`") for c in self._types)))]

    def __repr__(self) -> str:
        return f"Frame(columns={self.width()}, schema={{{', '.join(f'{k}: {v}' for k, v in self._types.items())}}})"

    def __str__(self) -> str:
        """A grid of the first ten rows."""
        n = self.height()
        if not n:
            return "DataFrame (0x0)"
        cells = [["null" if v is None else show_value(v) for v in r] for r in self.head(10).rows()]
        table = [self.columns_names(), [str(t) for t in self.dtypes()], *cells]
        widths = [max(len(r[i]) for r in table) for i in range(self.width())]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        line = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, widths, strict=True)) + "|"
        out = [rule, line(table[0]), line(table[1]), rule, *map(line, cells), rule]
        return "\n".join(out + [f"... {n - 10} more rows"] * (n > 10))


def _key(name: str, down: bool) -> Column:
    c = F.col(f"`{name}`")
    return c.desc_nulls_first() if down else c.asc_nulls_last()


def _checkpointed(df: DataFrame) -> DataFrame:
    from quillframe.sources.scratch import shared_folder

    shared_folder(df.sparkSession)
    return df.checkpoint()


def collected(df: DataFrame) -> list:
    """All rows; overflow and division of integers by zero as the library's own error."""
    return computed(df.collect)


def computed(action):
    """What an action gives; overflow and division of integers by zero as the library's own error."""
    try:
        return action()
    except ArithmeticException as e:
        raise ComputeError(str(e)) from e
    except SparkRuntimeException as e:
        if OVERFLOW in str(e):
            raise ComputeError(str(e)) from e
        raise


def _unique(names: list[str]) -> None:
    for i, n in enumerate(names):
        if n in names[:i]:
            raise DuplicateColumnName(n)


def _matched(left: Frame, right: Frame, name: str) -> tuple[DataFrame, DataFrame]:
    """Two frames with dense row numbers, after a check that they are equally long."""
    (mine, expected), (theirs, found) = left._dense(), right._dense()
    if expected != found:
        raise MismatchedLengths(expected, found, name)
    return mine.df, theirs.df
