"""CSV writer: one file, or any text stream, in row order.

Rows come to the driver one partition at a time; nothing is held beyond that.
For output at scale, ``write_parts`` lets every task write a file of its own.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime
from enum import Enum
from typing import IO, TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import functions as F

from quillframe.column import show_value
from quillframe.errors import CsvError, IoError
from quillframe.frame import computed
from quillframe.sources.csv_reader import NUMBER

if TYPE_CHECKING:
    from quillframe.frame import Frame


class QuoteStyle(Enum):
    ALWAYS = csv.QUOTE_ALL
    NECESSARY = csv.QUOTE_MINIMAL
    NEVER = csv.QUOTE_NONE
    NON_NUMERIC = csv.QUOTE_NONNUMERIC


@dataclass(frozen=True)
class WriteCsvOptions:
    has_header: bool = True
    delimiter: str = ","
    na_rep: str = ""
    quote_style: QuoteStyle = QuoteStyle.NECESSARY
    line_terminator: str = "\n"

    @classmethod
    def builder(cls) -> WriteCsvOptionsBuilder:
        return WriteCsvOptionsBuilder()


class WriteCsvOptionsBuilder:
    """Every field of ``WriteCsvOptions`` has a setter."""

    def __init__(self) -> None:
        self._made = WriteCsvOptions()

    def __getattr__(self, name: str):
        if name not in WriteCsvOptions.__dataclass_fields__:
            raise AttributeError(name)

        def put(value):
            self._made = replace(self._made, **{name: value})
            return self

        return put

    def build(self) -> WriteCsvOptions:
        return self._made


def _quoted(cell: str, o: WriteCsvOptions, numeric: bool, alone: bool) -> str:
    if o.quote_style is QuoteStyle.NEVER:
        return cell
    need = any(x in cell for x in (o.delimiter, '"', "\n", "\r")) or (alone and not cell)
    if o.quote_style is QuoteStyle.ALWAYS or need or (o.quote_style is QuoteStyle.NON_NUMERIC and not numeric):
        return '"' + cell.replace('"', '""') + '"'
    return cell


_number = re.compile(NUMBER).match


def _is_number(cell: str) -> bool:
    return _number(cell) is not None


def _line(cells: list[str], o: WriteCsvOptions) -> str:
    return o.delimiter.join(_quoted(c, o, _is_number(c), len(cells) == 1) for c in cells)


def _cells(row, o: WriteCsvOptions) -> list[str]:
    return [o.na_rep if v is None else show_value(v) for v in row]


def _checked(o: WriteCsvOptions) -> None:
    if o.line_terminator != "\r\n" and len(o.line_terminator.encode()) != 1:
        raise CsvError("a line ends with one byte or a carriage return and line feed")


def write(frame: Frame, out: IO[str], options: WriteCsvOptions | None = None) -> None:
    """To an open text stream.  A frame without columns writes nothing, one without rows its header."""
    o = options or WriteCsvOptions()
    _checked(o)
    names = frame.columns_names()
    if not names:
        return
    if o.has_header:
        out.write(_line(names, o) + o.line_terminator)
    rows = frame._in_order().select(*(F.col(f"`{n}`") for n in names))
    for r in computed(rows.toLocalIterator):
        out.write(_line(_cells(r, o), o) + o.line_terminator)


def write_path(frame: Frame, path: str, options: WriteCsvOptions | None = None) -> None:
    try:
        with open(path, "w", encoding="utf-8", newline="") as out:
            write(frame, out, options)
    except OSError as e:
        raise IoError(str(e)) from e


def write_parts(frame: Frame, path: str, options: WriteCsvOptions | None = None) -> None:
    """A folder of CSV files, one for each task, by the same rules as ``write``; each begins with the header.

    Cells become text in Arrow batches, as Spark's own writer has other rules for floats, quotes and lists.
    """
    o = options or WriteCsvOptions()
    _checked(o)
    names = frame.columns_names()
    if not names:
        raise CsvError("a frame without columns has no records to write")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if o.has_header:
            yield pa.RecordBatch.from_arrays([pa.array([_line(names, o)])], ["value"])
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for c in columns:
                if any(isinstance(v, datetime) and v.tzinfo for v in c):
                    c[:] = [v and v.replace(tzinfo=None) for v in c]
            yield pa.RecordBatch.from_arrays([pa.array([_line(_cells(r, o), o) for r in zip(*columns, strict=True)], pa.string())], ["value"])

    rows = frame.df.select(*(F.col(f"`{n}`") for n in names))
    rows.mapInArrow(run, "value string").write.option("lineSep", o.line_terminator).text(path)
