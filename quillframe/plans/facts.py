"""Queries for what the library tells in Python: constructors, readers of cells, texts, files, equality.

Each returns rows (k, v): a number and a text.  They read small dimension
tables, as such calls bring values to the driver; SQL states the same rows.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe import dtypes as D
from quillframe.column import Col, show_value
from quillframe.errors import FrameError
from quillframe.frame import Frame
from quillframe.plans.catalog import ORACLE, QUERIES, load, query
from quillframe.sources.csv_reader import ReadCsvOptions, read_csv
from quillframe.sources.csv_writer import QuoteStyle, WriteCsvOptions, write_parts
from quillframe.sources.literals import frame_of
from quillframe.sources.scratch import scratch


def fact(name: str, sql: str):
    """Register a function that gives values; numbered from 0, shown as text, they are the rows."""

    def put(f: Callable[[SparkSession, str], Iterable[Any]]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = [(k, None if v is None else show_value(v)) for k, v in enumerate(f(spark, sf_dir))]
            return spark.createDataFrame(rows, "k long, v string")

        QUERIES[name], ORACLE[name] = run, sql

    return put


def constants(*values: str) -> str:
    """SQL of fixed rows."""
    return "SELECT k::BIGINT AS k, v::VARCHAR AS v FROM (VALUES " + ", ".join(f"({k}, {v})" for k, v in enumerate(values)) + ") t(k, v)"


def nations(spark: SparkSession, sf_dir: str) -> Frame:
    return load(spark, sf_dir, "nation").sort(["n_nationkey"], [False])


def names(spark: SparkSession, sf_dir: str) -> list[str]:
    return nations(spark, sf_dir).column("n_name").take_inner()


def failed(action: Callable[[], Any]) -> str:
    try:
        action()
    except FrameError as e:
        return type(e).__name__
    return "nothing"


NAMES = "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation"
SOME = "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey <> 2 THEN n_name END AS v FROM nation"


def some(spark: SparkSession, sf_dir: str) -> Col:
    """Names of nations, null in one region, as a literal column."""
    rows = nations(spark, sf_dir).rows()
    return Col.new_from_options(spark, "n_name", [None if r[2] == 2 else r[1] for r in rows])


# -- construction ---------------------------------------------------------------------------------


@query("frame_of_columns", "SELECT n_name, n_regionkey FROM nation")
def _(spark, d):
    return Frame.new([load(spark, d, "nation").column("n_name"), load(spark, d, "nation").column("n_regionkey")])


@query("frame_literal", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey, n_nationkey / 2.0::DOUBLE AS half FROM nation")
def _(spark, d):
    told = names(spark, d)
    return frame_of(spark, {"n_name": told, "n_nationkey": list(range(len(told))), "half": [k / 2 for k in range(len(told))]}, {"n_nationkey": D.Int64})


fact("frame_new_empty", constants("'0'", "'0'", "'true'"))(lambda spark, d: [*Frame.new_empty(spark).shape(), Frame.new_empty(spark).is_empty()])
fact("col_new_list", NAMES)(lambda spark, d: Col.new(spark, "x", names(spark, d)).take_inner())
fact("col_new_tuple", NAMES)(lambda spark, d: Col.new(spark, "x", tuple(names(spark, d))).take_inner())
fact("col_new_iterator", NAMES)(lambda spark, d: Col.new(spark, "x", (n for n in names(spark, d))).take_inner())
fact("col_new_options", SOME)(lambda spark, d: some(spark, d).take_inner())
fact("col_type_of_first_value", constants("'String'", "'Int32'", "'Int64'", "'UInt64'", "'Float64'", "'Bool'", "'Null'", "'List(Int32)'"))(
    lambda spark, d: [Col.new(spark, "x", [None, v]).dtype for v in ("a", 1, 2**40, 2**63, 0.5, True, None, [1])])
fact("col_new_empty", constants("'Int16'", "'0'", "'true'"))(lambda spark, d: [(c := Col.new_empty(spark, "x", D.Int16)).dtype, c.length(), c.is_empty()])
fact("col_default", constants("''", "'Null'", "'0'"))(lambda spark, d: [(c := Col.new_empty(spark)).name, c.dtype, c.length()])


def by_region(spark: SparkSession, d: str) -> Col:
    """A list column: the keys of each region's nations, and a null cell."""
    rows = nations(spark, d).rows()
    cells = [Col.new(spark, "keys", [r[0] for r in rows if r[2] == region]) for region in range(5)]
    return Col.new_list(spark, "keys", [*cells, None])


@query("col_new_list_column", "SELECT n_nationkey AS keys FROM nation")
def _(spark, d):
    return Frame(by_region(spark, d).to_frame().df.select(F.explode("keys").alias("keys")))


_SHOWN = "'[' || array_to_string(list(n_nationkey ORDER BY n_nationkey)[1:5], ', ') || CASE WHEN count(*) > 5 THEN ', ...' ELSE '' END || ']'"
fact("list_cell_text", f"SELECT n_regionkey::BIGINT AS k, {_SHOWN} AS v FROM nation GROUP BY 1 UNION ALL SELECT 5, NULL")(lambda spark, d: [by_region(spark, d).get_str(i) for i in range(6)])
fact("list_cell_as_column", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_nationkey::VARCHAR AS v FROM nation WHERE n_regionkey = 3")(lambda spark, d: by_region(spark, d).get_inner_series(3).take_inner())
fact("list_column_text", f"SELECT 0::BIGINT AS k, 'keys: [' || string_agg(v, ', ' ORDER BY r) || ', null]' AS v FROM (SELECT n_regionkey AS r, {_SHOWN} AS v FROM nation GROUP BY 1) UNION ALL SELECT 1, 'Col(name=''keys'', dtype=List(Int32))'")(
    lambda spark, d: [str(c := by_region(spark, d)), repr(c)])


# -- cells ----------------------------------------------------------------------------------------

fact("col_take_inner", NAMES)(lambda spark, d: nations(spark, d).column("n_name").data())
fact("col_iter", SOME)(lambda spark, d: list(some(spark, d)))
fact("col_iter_valid", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name AS v FROM nation WHERE n_regionkey <> 2")(lambda spark, d: list(some(spark, d).iter_valid()))
fact("col_get", "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 4, NULL")(lambda spark, d: [nations(spark, d).column("n_name").get(i) for i in (0, 1, 2, 3, 99)])
fact("col_get_opt", "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 2, 'IndexOutOfBounds'")(
    lambda spark, d: [*((c := nations(spark, d).column("n_name")).get_opt(i) for i in (0, 1)), failed(lambda: c.get_opt(25))])
fact("col_get_str", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 2 THEN 'null' ELSE n_name END AS v FROM nation WHERE n_nationkey < 10")(lambda spark, d: [(c := some(spark, d)).get_str(i) for i in range(10)])
fact("col_get_as_f64", "SELECT n_nationkey::BIGINT AS k, n_regionkey::VARCHAR AS v FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 5, NULL")(
    lambda spark, d: [*((f := nations(spark, d)).column("n_regionkey").get_as_f64(i) for i in range(5)), f.column("n_name").get_as_f64(0)])
fact("col_is_null_at", "SELECT n_nationkey::BIGINT AS k, (n_regionkey = 2)::VARCHAR AS v FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 10, 'true'")(lambda spark, d: [*((c := some(spark, d)).is_null_at(i) for i in range(10)), c.is_null_at(99)])
fact("col_text", "SELECT 0::BIGINT AS k, '[' || string_agg(CASE WHEN n_regionkey = 2 THEN 'null' ELSE n_name END, ', ' ORDER BY n_nationkey) || ']' AS v FROM nation UNION ALL SELECT 1, 'Col(name=''n_name'', dtype=String)'")(
    lambda spark, d: [str(c := some(spark, d)), repr(c)])


# -- schema ---------------------------------------------------------------------------------------


@query("downcast_column", "SELECT c_nationkey FROM customer")
def _(spark, d):
    return load(spark, d, "customer").downcast_column("c_nationkey", D.Int32).to_frame()


fact("downcast_column_wrong", constants("'TypeMismatch'", "'ColumnNotFound'"))(lambda spark, d: [failed(lambda: load(spark, d, "customer").downcast_column("c_name", D.Int32)), failed(lambda: load(spark, d, "customer").column("none"))])
fact("frame_shape", "SELECT 0::BIGINT AS k, count(*)::VARCHAR AS v FROM lineitem UNION ALL SELECT 1, '11' UNION ALL SELECT 2, count(*)::VARCHAR FROM lineitem UNION ALL SELECT 3, '11'")(
    lambda spark, d: [*(f := load(spark, d, "lineitem")).shape(), f.height(), f.width()])
fact("frame_schema", constants("'n_nationkey'", "'n_name'", "'n_regionkey'", "'Int32'", "'String'", "'Int32'", "'String'"))(
    lambda spark, d: [*(f := load(spark, d, "nation")).columns_names(), *f.dtypes(), f.schema()["n_name"]])
fact("frame_is_empty", "SELECT 0::BIGINT AS k, (count(*) = 0)::VARCHAR AS v FROM orders UNION ALL SELECT 1, (count(*) = 0)::VARCHAR FROM orders WHERE o_totalprice < 0")(
    lambda spark, d: [(f := load(spark, d, "orders")).is_empty(), f.filter(f.column("o_totalprice").lt(0.0)).is_empty()])
fact("frame_repr", constants("'Frame(columns=2, schema={r_regionkey: Int32, r_name: String})'"))(lambda spark, d: [repr(load(spark, d, "region"))])
fact("frame_text", """WITH w AS (SELECT greatest(max(length(r_name)), 6)::INTEGER AS w FROM region), rule AS (SELECT '+' || repeat('-', 13) || '+' || repeat('-', w + 2) || '+' AS rule, w FROM w)
SELECT 0::BIGINT AS k, rule AS v FROM rule UNION ALL SELECT 1, '| r_regionkey | ' || rpad('r_name', w, ' ') || ' |' FROM rule UNION ALL SELECT 2, '| Int32       | ' || rpad('String', w, ' ') || ' |' FROM rule
UNION ALL SELECT 3, rule FROM rule UNION ALL SELECT 4 + r_regionkey, '| ' || rpad(r_regionkey::VARCHAR, 11, ' ') || ' | ' || rpad(r_name, w, ' ') || ' |' FROM region, rule UNION ALL SELECT 9, rule FROM rule""")(
    lambda spark, d: str(load(spark, d, "region").sort(["r_regionkey"], [False])).split("\n"))
fact("col_schema", "SELECT 0::BIGINT AS k, 'c_acctbal' AS v UNION ALL SELECT 1, 'Float64' UNION ALL SELECT 2, count(*)::VARCHAR FROM customer UNION ALL SELECT 3, 'false'")(
    lambda spark, d: [(c := load(spark, d, "customer").column("c_acctbal")).name, c.dtype, c.length(), c.is_empty()])
fact("col_push", f"{NAMES} UNION ALL SELECT count(*), 'more' FROM nation")(lambda spark, d: nations(spark, d).column("n_name").push("more").take_inner())
fact("col_clear", constants("'n_name'", "'Null'", "'0'"))(lambda spark, d: [(c := nations(spark, d).column("n_name").clear()).name, c.dtype, c.length()])
fact("frame_copy", constants("'n_nationkey,n_name,n_regionkey'", "'n_nationkey,n_regionkey,twice'"))(lambda spark, d: _copied(load(spark, d, "nation")))
fact("col_copy", constants("'false'", "'true'"))(lambda spark, d: [(c := nations(spark, d).column("n_name")).copy().set_sorted_flag(True) and c.is_sorted(), c.copy().set_sorted_flag(True).is_sorted()])
fact("col_views", constants("'Strings'", "'Col'", "'TypeMismatch'"))(lambda spark, d: [type((f := nations(spark, d)).column("n_name").as_any()).__name__, type(f.column("n_regionkey").as_any()).__name__, failed(lambda: f.column("n_name").expect(D.Int32))])
fact("col_sorted_flags", constants("'false'", "'true'", "'false'", "'true'", "'false'"))(
    lambda spark, d: [(c := nations(spark, d).column("n_name")).is_sorted(), (up := c.sort()).is_sorted(), up.get_flags()["is_sorted_descending"], c.sort(reverse=True).get_flags()["is_sorted_descending"], c.push("x").is_sorted()])


def _copied(f: Frame) -> list[str]:
    made = f.copy()
    made.drop_column("n_name")
    made.add_column((made.column("n_regionkey") * 2).rename("twice"))
    return [",".join(x.columns_names()) for x in (f, made)]


# -- equality and order ---------------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> list[tuple[Col, Col]]:
    a, b = (load(spark, d, "customer") for _ in range(2))
    nan = Col.new(spark, "x", [1.0, float("nan"), None])
    return [
        (a.column("c_name"), b.column("c_name")), (a.column("c_name"), b.column("c_name").rename("other")), (a.column("c_name"), b.column("c_mktsegment").rename("c_name")),
        (a.column("c_acctbal"), (b.column("c_acctbal") + 0.5).rename("c_acctbal")), (a.column("c_name"), b.head(7).column("c_name")), (nan, nan.copy())]


fact("col_equals", constants("'true'", "'false'", "'false'", "'false'", "'false'", "'false'"))(lambda spark, d: [a.equals(b) for a, b in _pairs(spark, d)])
fact("col_equals_missing", constants("'true'", "'false'", "'false'", "'false'", "'false'", "'false'"))(lambda spark, d: [a.equals_missing(b) for a, b in _pairs(spark, d)])
fact("col_series_equal", constants("'true'", "'true'", "'false'", "'false'", "'false'", "'true'"))(lambda spark, d: [a.series_equal(b) for a, b in _pairs(spark, d)])
fact("frame_equals", constants("'true'", "'false'", "'false'", "'false'"))(lambda spark, d: [(f := load(spark, d, "customer")).equals(g := load(spark, d, "customer")), f.equals(g.drop("c_name")), f.equals(g.head(9)), f.equals(g.copy().rename_column("c_name", "n"))])


@query("compare_rows", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < l_tax THEN -1 WHEN l_discount = l_tax THEN 0 ELSE 1 END AS l_discount_order FROM lineitem")
def _(spark, d):
    f = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return f.with_columns_only([f.column("l_orderkey"), f.column("l_linenumber"), f.column("l_discount").compare_rows(f.column("l_tax"))])


fact("compare_row", constants("'-1'", "'1'", "'0'", "'-1'", "'1'", "'0'", "'-1'"))(
    lambda spark, d: [(c := Col.new(spark, "x", [1.0, 2.0, None, None, float("nan")])).compare_row(i, j) for i, j in ((0, 1), (1, 0), (0, 0), (1, 2), (2, 4), (2, 3), (1, 4))])
fact("group_of_no_rows", constants("'n_regionkey'", "'Int32'", "'0'"))(lambda spark, d: [(g := (f := load(spark, d, "nation")).filter(f.column("n_nationkey").lt(0)).groupby(["n_regionkey"]).count()).columns_names()[0], g.dtypes()[0], g.height()])


# -- unsigned types -------------------------------------------------------------------------------

_KINDS = (D.UInt8, D.UInt16, D.UInt32, D.UInt64)
fact("unsigned_overflow", constants(*["'ComputeError'"] * 16))(lambda spark, d: [failed(x) for t in _KINDS for x in _too_much(spark, t)])
fact("unsigned_arithmetic", " UNION ALL ".join(f"SELECT ({i} * (SELECT count(*) FROM nation) + n_nationkey)::BIGINT AS k, (({2**t.bounds[1].bit_length() - 1}::HUGEINT - n_nationkey) - 7 + n_nationkey)::VARCHAR AS v FROM nation" for i, t in enumerate(_KINDS)))(
    lambda spark, d: [v for t in _KINDS for v in _near_the_top(spark, d, t)])


def _too_much(spark: SparkSession, t: D.DType) -> list[Callable[[], Any]]:
    top = t.bounds[1]
    c = Col.new(spark, "u", [top, 0, None], t)
    return [(c + 1).take_inner, (c - 1).take_inner, (c * 2).take_inner, Col.new(spark, "u", [top, 1], t).sum]


def _near_the_top(spark: SparkSession, d: str, t: D.DType) -> list[int]:
    keys = nations(spark, d).column("n_nationkey").take_inner()
    c = Col.new(spark, "u", [t.bounds[1] - k for k in keys], t)
    return ((c - 7) + Col.new(spark, "k", keys, t)).take_inner()


fact("integer_division_by_zero", constants("'ComputeError'", "'ComputeError'"))(lambda spark, d: [failed((a := (f := nations(spark, d)).column("n_nationkey")).div_series(b := f.column("n_regionkey")).take_inner), failed(a.rem_series(b).take_inner)])


# -- files ----------------------------------------------------------------------------------------

_CUSTOMER = "c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment"


def _customers(spark: SparkSession, d: str) -> Frame:
    f = load(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    known = Col(f, F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "c_acctbal", D.Float64)
    return f.with_columns_only([f.column("c_custkey"), f.column("c_name"), known, f.column("c_mktsegment")])


@query("csv_read_options", "SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS column_2, c_custkey AS column_0 FROM customer")
def _(spark, d):
    path = scratch(spark)
    write_parts(_customers(spark, d), path, WriteCsvOptions(has_header=False, delimiter=";", na_rep="NA", quote_style=QuoteStyle.ALWAYS))
    options = ReadCsvOptions.builder().delimiter(";").has_header(False).na_values({"NA"}).use_columns(["column_2", "column_0"]).infer_schema_length(None).build()
    return read_csv(spark, path, options)


@query("csv_read_skip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || chr(10) || n_regionkey AS n_name FROM nation")
def _(spark, d):
    """Two lines before the header, a comment, and line breaks in quoted fields."""
    rows = [f'{k},"{n}\n{r}"' for k, n, r in nations(spark, d).rows()]
    text = "\n".join(["any", 'thing "', "n_nationkey,n_name", *rows[:9], "# a comment", *rows[9:]])
    path = scratch(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    part = next(r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect())
    return read_csv(spark, part, ReadCsvOptions.builder().skip_rows(2).comment_char("#").build())


_LINES = "SELECT row_number() OVER (ORDER BY {by}) AS k, {line} AS v FROM {table}"


@fact("to_csv", "SELECT 0::BIGINT AS k, 's_suppkey,s_name,s_nationkey' AS v UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey), s_suppkey || ',' || s_name || ',' || s_nationkey FROM supplier")
def _(spark, d):
    with tempfile.TemporaryDirectory() as folder:  # of the driver, which writes this one file and reads it
        path = os.path.join(folder, "out.csv")
        load(spark, d, "supplier").drop("s_acctbal").sort(["s_suppkey"], [False]).to_csv(path)
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()


def _styles(spark: SparkSession, d: str) -> list[str]:
    out = io.StringIO()
    for style in (QuoteStyle.ALWAYS, QuoteStyle.NECESSARY, QuoteStyle.NEVER, QuoteStyle.NON_NUMERIC):
        rows = nations(spark, d)
        spaced = (Col(rows, F.concat("n_name", F.lit(", x")), "n_name", D.String),)
        rows.with_columns_only([rows.column("n_nationkey"), *spaced]).to_csv_writer(out, WriteCsvOptions(has_header=False, quote_style=style))
    return out.getvalue().splitlines()


fact("csv_quote_styles", " UNION ALL ".join(f"SELECT ({i} * (SELECT count(*) FROM nation) + n_nationkey)::BIGINT AS k, {line} AS v FROM nation" for i, line in enumerate((
    "'\"' || n_nationkey || '\",\"' || n_name || ', x\"'", "n_nationkey || ',\"' || n_name || ', x\"'", "n_nationkey || ',' || n_name || ', x'", "n_nationkey || ',\"' || n_name || ', x\"'"))))(_styles)


def _written(frame: Frame, options: WriteCsvOptions | None = None) -> str:
    out = io.StringIO()
    frame.to_csv_writer(out, options)
    return out.getvalue()


fact("csv_line_terminator", "SELECT 0::BIGINT AS k, 'r_name' || chr(13) || chr(10) || string_agg(r_name, chr(13) || chr(10) ORDER BY r_regionkey) || chr(13) || chr(10) AS v FROM region UNION ALL SELECT 1, 'CsvError'")(
    lambda spark, d: [_written(f := load(spark, d, "region").sort(["r_regionkey"], [False]).select(["r_name"]), WriteCsvOptions(line_terminator="\r\n")), failed(lambda: _written(f, WriteCsvOptions(line_terminator="ab")))])
fact("csv_empty", constants("''", "'n_nationkey,n_name,n_regionkey' || chr(10)"))(lambda spark, d: [_written(Frame.new_empty(spark)), _written((f := load(spark, d, "nation")).filter(f.column("n_nationkey").lt(0)))])
fact("csv_list_cells", f"SELECT 0::BIGINT AS k, 'keys' AS v UNION ALL SELECT n_regionkey + 1, '\"' || {_SHOWN} || '\"' FROM nation GROUP BY n_regionkey UNION ALL SELECT 6, '\"\"'")(lambda spark, d: _written(by_region(spark, d).to_frame()).splitlines())


@query("csv_write_parts", f"SELECT c_custkey || ';\"' || c_name || '\";' || coalesce(rtrim(rtrim(printf('%.2f', c_acctbal), '0'), '.'), '\"NA\"') || ';\"' || c_mktsegment || '\"' AS value FROM (SELECT {_CUSTOMER} FROM customer)")
def _(spark, d):
    path = scratch(spark)
    write_parts(_customers(spark, d), path, WriteCsvOptions(has_header=False, delimiter=";", na_rep="NA", quote_style=QuoteStyle.NON_NUMERIC))
    return Frame(spark.read.text(path))
