"""Frames from Python values."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quillframe import dtypes as D
from quillframe.errors import InvalidArgument, MismatchedLengths
from quillframe.frame import ROW, Frame


def frame_of(spark: SparkSession, columns: dict[str, Any] | list[tuple[str, Any]] | None = None, types: dict[str, D.DType] | None = None) -> Frame:
    """A frame of named sequences; types are those of the values unless given.

    Pairs instead of a dictionary may repeat a name, which is an error.
    """
    from quillframe.frame import _unique

    pairs = list(columns.items() if isinstance(columns, dict) else columns or [])
    _unique([n for n, _ in pairs])
    if not pairs:
        return Frame.new_empty(spark)
    data = [(n, list(v)) for n, v in pairs]
    for n, v in data:
        if len(v) != len(data[0][1]):
            raise MismatchedLengths(len(data[0][1]), len(v), n)
    kinds = {n: (types or {}).get(n) or D.of_values(v) for n, v in data}
    for n, v in data:
        _check(n, v, kinds[n])
    floats = {n for n, k in kinds.items() if k.is_float}
    wide = {n for n, k in kinds.items() if isinstance(k.spark, T.DecimalType)}
    rows = [tuple(None if x is None else float(x) if n in floats else Decimal(x) if n in wide else x for (n, _), x in zip(data, cells, strict=True)) + (i,) for i, cells in enumerate(zip(*(v for _, v in data), strict=True))]
    schema = T.StructType([*(kinds[n].field(n) for n, _ in data), T.StructField(ROW, T.LongType())])
    return Frame(spark.createDataFrame(rows, schema))


def _check(name: str, values: list, kind: D.DType) -> None:
    if kind.name[-1:].isdigit() and kind.is_integer and kind.is_numeric:
        low, high = kind.bounds
        for v in values:
            if v is not None and not low <= v <= high:
                raise InvalidArgument(f"{v} in '{name}' is no {kind}")


def read_parquet(spark: SparkSession, path: str, strict: bool = True) -> Frame:
    return Frame(spark.read.parquet(path), strict)
