"""CSV reader with a fixed order of type inference, and its options.

Records are parsed by Spark as text, split over tasks unless a quoted field
holds a line break; types are applied as expressions.  What can only be known
from the data is found in small jobs: the header, whether records are ragged,
and the first values of each column.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe import dtypes as D
from quillframe.errors import CsvError, IoError, UnsupportedOperation
from quillframe.frame import Frame, _unique
from quillframe.sources.scratch import scratch

#: Grammars of numbers and the words for true and false.
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
TRUE = ["true", "t", "yes", "y", "1"]
FALSE = ["false", "f", "no", "n", "0"]
_BAD = "__bad_record"


@dataclass(frozen=True)
class ReadCsvOptions:
    delimiter: str = ","
    has_header: bool = True
    infer_schema: bool = True
    infer_schema_length: int | None = 100  # values of each column; None: all
    dtypes: dict[str, D.DType] | None = None
    skip_rows: int = 0
    comment_char: str | None = None
    use_columns: list[str] | None = None
    na_values: set[str] = field(default_factory=set)

    @classmethod
    def builder(cls) -> ReadCsvOptionsBuilder:
        return ReadCsvOptionsBuilder()


class ReadCsvOptionsBuilder:
    """``ReadCsvOptions.builder().delimiter(";").build()``: every field has a setter."""

    def __init__(self) -> None:
        self._made = ReadCsvOptions()

    def __getattr__(self, name: str):
        if name not in ReadCsvOptions.__dataclass_fields__:
            raise AttributeError(name)

        def put(value):
            self._made = replace(self._made, **{name: value})
            return self

        return put

    def build(self) -> ReadCsvOptions:
        return self._made


def integer(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


_PARSERS = {"Int64": integer, "Float64": number, "Bool": boolean, "String": lambda c: c}


def infer_column_type(values: list[str]) -> D.DType:
    """The first of Int64, Float64 and Bool that all values parse as; else String, as without values."""
    import re

    fits = {
        D.Int64: lambda v: re.fullmatch(INTEGER, v) is not None and -(2**63) <= int(v) < 2**63,
        D.Float64: lambda v: re.fullmatch(NUMBER, v) is not None,
        D.Bool: lambda v: v.lower() in TRUE + FALSE,
    }
    return next((t for t, fit in fits.items() if values and all(map(fit, values))), D.String)


def _exists(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    except Py4JJavaError as e:
        raise IoError(f"{path}: {e.java_exception.getMessage()}") from e
    if not found:
        raise IoError(f"{path}: no such file")


def _parsed(reader, source: str | DataFrame) -> DataFrame:
    """Records of a path, or of a frame of lines, which stay in the JVM."""
    if isinstance(source, str):
        return reader.csv(source)
    spark = source.sparkSession
    lines = getattr(source._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(lines), spark)


def _rest(spark: SparkSession, path: str, lines: int) -> str:
    """A copy of a file in the shared folder without its first lines.

    A file whose quoted fields hold line breaks is read by one task in any case; it is copied by the JVM as bytes.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    at = fs_path(path)
    fs = at.getFileSystem(conf)
    begin, found = 0, 0
    stream = fs.open(at)
    try:
        while found < lines:
            block = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(1 << 16, stream.available()) or 1))
            ends = [i for i, c in enumerate(block) if c == 10]
            if found + len(ends) >= lines:
                begin += ends[lines - found - 1] + 1
            else:
                begin += len(block)
            found += len(ends)
        stream.seek(begin)
        to = fs_path(scratch(spark) + ".csv")
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, to.getFileSystem(conf).create(to), conf, True)
    finally:
        stream.close()
    return to.toString()


def read_csv(spark: SparkSession, path: str, options: ReadCsvOptions | None = None) -> Frame:
    o = options or ReadCsvOptions()
    _exists(spark, path)
    lines = spark.read.text(path)
    source: object = path
    if o.skip_rows:
        if len(lines.take(o.skip_rows)) < o.skip_rows:
            raise CsvError(f"{path} has fewer than {o.skip_rows} lines to skip")
        # The first lines are those of the first partition, so their numbers have no gaps.
        source = lines = lines.withColumn("__n", F.monotonically_increasing_id()).filter(F.col("__n") >= o.skip_rows).select("value")
    quoted = not lines.filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
    if quoted and o.skip_rows:
        source = _rest(spark, path, o.skip_rows)
    reader = lambda: spark.read.option("sep", o.delimiter).option("escape", '"').option("multiLine", quoted).option("comment", o.comment_char or "\u0000")
    try:
        first = _parsed(reader().option("header", False), source).first()
    except PySparkException as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "empty" in str(e).lower():
            return Frame.new_empty(spark)
        raise CsvError(str(e)) from e
    if first is None:
        return Frame.new_empty(spark)
    names = [x or "" for x in first] if o.has_header else [f"column_{i}" for i in range(len(first))]
    _unique(names)
    raw = _records(reader(), source, len(names), o)
    chosen = names if o.use_columns is None else o.use_columns
    for n in chosen:
        if n not in names:
            raise CsvError(f"there is no column '{n}' to use")
    if not chosen:
        return Frame.new_empty(spark)
    text = raw.select(*(_known(F.col(f"_{names.index(n)}"), o).alias(n) for n in chosen))
    types = _types_of(text, chosen, o)
    for n, t in types.items():
        if t.name not in _PARSERS:
            raise UnsupportedOperation(f"'{n}' can't be read as {t}")
    return Frame(text.select(*(_PARSERS[types[n].name](F.col(f"`{n}`")).alias(n) for n in chosen)))


def _records(reader, source, width: int, o: ReadCsvOptions) -> DataFrame:
    """All records as text columns ``_0``, ``_1``, ...; a ragged one is an error, found in a pass over all."""
    schema = T.StructType([*(T.StructField(f"_{i}", T.StringType()) for i in range(width)), T.StructField(_BAD, T.StringType())])
    raw = reader.option("header", o.has_header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).schema(schema)
    raw = _parsed(raw, source)
    fields = [F.col(f"_{i}") for i in range(width)]
    ragged = raw.select(F.col(_BAD), F.coalesce(*fields, F.lit("")).alias("any")).filter(F.col(_BAD).isNotNull()).limit(1).collect()
    if ragged:
        raise CsvError(f"a record has another number of fields than {width}: {ragged[0][0]!r}")
    if o.comment_char:
        raw = raw.filter(F.coalesce(*(F.nullif(c, F.lit("")) for c in fields)).isNotNull())
    return raw


def _known(c: Column, o: ReadCsvOptions) -> Column:
    """The value, or null where it is empty or one of the given marks."""
    return F.when((c != "") & ~c.isin(sorted(o.na_values)), c) if o.na_values else F.nullif(c, F.lit(""))


def _types_of(text: DataFrame, names: list[str], o: ReadCsvOptions) -> dict[str, D.DType]:
    """Given types, and those of the first values of all other columns, which one job brings.

    Without a limit one aggregate over all columns tells which types fit; with one, a
    column whose first rows hold too few values takes a job of its own.
    """
    given = o.dtypes or {}
    types = {n: given.get(n, D.String) for n in names}
    open_ = [n for n in names if n not in given] if o.infer_schema else []
    if not open_:
        return types
    kinds = (D.Int64, D.Float64, D.Bool)
    column = lambda n: F.col(f"`{n}`")
    if o.infer_schema_length is None:
        each = [F.struct(F.count(column(n)), *(F.count(_PARSERS[t.name](column(n))) for t in kinds)).alias(f"c{i}") for i, n in enumerate(open_)]
        for n, (some, *fits) in zip(open_, text.agg(*each).first(), strict=True):
            types[n] = next((t for t, fit in zip(kinds, fits, strict=True) if some and fit == some), D.String)
        return types
    rows = text.select(*map(column, open_)).take(2 * o.infer_schema_length)
    for i, n in enumerate(open_):
        values = [r[i] for r in rows if r[i] is not None][: o.infer_schema_length]
        if len(values) < o.infer_schema_length and len(rows) == 2 * o.infer_schema_length:
            values = [r[0] for r in text.select(column(n)).filter(column(n).isNotNull()).take(o.infer_schema_length)]
        types[n] = infer_column_type(values)
    return types
