"""One query for each operator, on whole tables, with equivalent DuckDB SQL.

The tables hold no null and no NaN, so queries that show their rules put some
in first: a null where ``l_quantity > 45``, a NaN where ``l_linenumber = 7``.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.column import Col
from quillframe.dtypes import Bool, Float64, Int32, String
from quillframe.frame import Frame
from quillframe.sources.literals import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Frame:
    """A table without type limits, with only the named columns if any are named."""
    frame = read_parquet(spark, f"{sf_dir}/{name}.parquet", strict=False)
    return frame.select(columns) if columns else frame


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], Frame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).df.drop("__row")
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _with(frame: Frame, *columns: Col) -> Frame:
    """Named expressions beside the frame's own columns."""
    return frame.with_columns_only([*map(frame.column, frame.columns_names()), *columns])


def _own(frame: Frame, expr: Column, name: str, dtype) -> Col:
    return Col(frame, expr, name, dtype)


KEYS = ("l_orderkey", "l_linenumber")
SQL_KEYS = "l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str, *more: str) -> Frame:
    return load(spark, sf_dir, "lineitem", *KEYS, *more)


def _holed(spark: SparkSession, sf_dir: str) -> Frame:
    """lineitem keys, q (l_quantity with nulls) and v (l_discount with NaN)."""
    base = _lines(spark, sf_dir, "l_quantity", "l_discount", "l_returnflag")
    q = _own(base, F.when(F.col("l_quantity") <= 45, F.col("l_quantity")), "q", Float64)
    v = _own(base, F.when(F.col("l_linenumber") == 7, F.lit(math.nan)).when(F.col("l_quantity") <= 45, F.col("l_discount")), "v", Float64)
    return base.with_columns_only([*map(base.column, (*KEYS, "l_returnflag")), q, v])


HOLED = f"(SELECT {SQL_KEYS}, l_returnflag, CASE WHEN l_quantity <= 45 THEN l_quantity END AS q, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE WHEN l_quantity <= 45 THEN l_discount END AS v FROM lineitem)"


# -- projections ----------------------------------------------------------------------------------


@query("scan_select", "SELECT l_shipdate, l_quantity FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").select(["l_shipdate", "l_quantity"])


@query("drop_rename_add", "SELECT * EXCLUDE (c_name) REPLACE (c_mktsegment AS c_mktsegment), c_acctbal * 2 AS double_balance FROM (SELECT c_custkey AS customer, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)")
def _(spark, d):
    f = load(spark, d, "customer").drop("c_name").rename_column("c_custkey", "customer")
    return f.add_column((f.column("c_acctbal") * 2.0).rename("double_balance"))


@query("drop_column", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, d):
    f = load(spark, d, "customer", "c_custkey", "c_name", "c_acctbal")
    f.drop_column("c_name")
    return f


@query("column_at", "SELECT c_name FROM customer")
def _(spark, d):
    return load(spark, d, "customer").column_at(1).to_frame()


@query("add_foreign_column", "SELECT s_suppkey, s_name, s_suppkey + 10 AS far FROM supplier")
def _(spark, d):
    f, other = load(spark, d, "supplier", "s_suppkey", "s_name"), load(spark, d, "supplier")
    return f.add_column((other.column("s_suppkey") + 10).rename("far").to_frame().column("far"))


@query("cast_extended", f"SELECT {SQL_KEYS}, l_quantity::INTEGER AS l_quantity FROM lineitem")
def _(spark, d):
    f = _lines(spark, d, "l_quantity")
    return f.with_columns_only([f.column(KEYS[0]), f.column(KEYS[1]), f.column("l_quantity").cast(Int32, strict=False)])


# -- predicates -----------------------------------------------------------------------------------

_SIGN = {"gt": ">", "lt": "<", "eq": "=", "neq": "<>", "gte": ">=", "lte": "<="}


def _predicates() -> None:
    for kind, sign in _SIGN.items():
        @query(f"filter_{kind}_scalar", f"SELECT {SQL_KEYS}, l_quantity FROM lineitem WHERE l_quantity {sign} 25")
        def _(spark, d, kind=kind):
            f = _lines(spark, d, "l_quantity")
            return f.filter(getattr(f.column("l_quantity"), kind)(25.0))

        @query(f"filter_{kind}_series", f"SELECT {SQL_KEYS}, l_discount, l_tax FROM lineitem WHERE l_discount {sign} l_tax")
        def _(spark, d, kind=kind):
            f = _lines(spark, d, "l_discount", "l_tax")
            return f.filter(getattr(f.column("l_discount"), f"{kind}_series")(f.column("l_tax")))

        holds = "true" if kind == "neq" else "false"

        @query(f"cmp_nan_{kind}", f"SELECT {SQL_KEYS}, CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN {holds} ELSE v {sign} 0.05 END AS v_{kind}_scalar FROM {HOLED}")
        def _(spark, d, kind=kind):
            f = _holed(spark, d)
            return f.with_columns_only([*map(f.column, KEYS), getattr(f.column("v"), kind)(0.05)])

        @query(f"compare_null_{kind}_series", f"SELECT {SQL_KEYS}, q {sign} l_linenumber::DOUBLE AS q_{kind}_series FROM {HOLED}")
        def _(spark, d, kind=kind):
            f = _holed(spark, d)
            number = _own(f, F.col("l_linenumber").cast("double"), "n", Float64)
            return f.with_columns_only([*map(f.column, KEYS), getattr(f.column("q"), kind)(number)])


_predicates()


@query("filter_null_mask", f"SELECT {SQL_KEYS}, q FROM {HOLED} WHERE q > 20")
def _(spark, d):
    f = _holed(spark, d)
    return f.filter(f.column("q").gt(20.0)).select([*KEYS, "q"])


@query("par_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000")
def _(spark, d):
    f = load(spark, d, "orders", "o_orderkey", "o_totalprice")
    return f.par_filter(f.column("o_totalprice").gte(100000.0))


@query("filter_series", "SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    f = load(spark, d, "orders")
    return f.column("o_totalprice").filter(f.column("o_orderstatus").eq("F")).to_frame()


@query("mask_and_or_not", f"SELECT {SQL_KEYS} FROM lineitem WHERE (l_quantity > 30 AND NOT l_discount > 0.05) OR l_returnflag = 'R'")
def _(spark, d):
    f = _lines(spark, d, "l_quantity", "l_discount", "l_returnflag")
    return f.filter(f.column("l_quantity").gt(30.0) & ~f.column("l_discount").gt(0.05) | f.column("l_returnflag").eq("R")).select(KEYS)


_NULLS = {
    "is_null": ("q", "q IS NULL"), "not_null": ("q", "q IS NOT NULL"), "is_nan": ("v", "coalesce(isnan(v), false)"), "is_not_nan": ("v", "NOT coalesce(isnan(v), false)"),
}
for _kind, (_on, _sql) in _NULLS.items():
    @query(_kind, f"SELECT {SQL_KEYS}, {_sql} AS {_on}_{_kind} FROM {HOLED}")
    def _(spark, d, kind=_kind, on=_on):
        f = _holed(spark, d)
        return f.with_columns_only([*map(f.column, KEYS), getattr(f.column(on), kind)()])


@query("is_infinite", f"SELECT {SQL_KEYS}, coalesce(isinf(w), false) AS w_is_infinite FROM (SELECT {SQL_KEYS}, CASE WHEN l_linenumber = 6 THEN '-inf'::DOUBLE ELSE v END AS w FROM {HOLED})")
def _(spark, d):
    f = _holed(spark, d)
    w = _own(f, F.when(F.col("l_linenumber") == 6, F.lit(-math.inf)).otherwise(F.col("v")), "w", Float64)
    return f.with_columns_only([*map(f.column, KEYS), w.is_infinite()])


@query("fill_null", f"SELECT {SQL_KEYS}, coalesce(q, -1) AS q FROM {HOLED}")
def _(spark, d):
    f = _holed(spark, d)
    return f.with_columns_only([*map(f.column, KEYS), f.column("q").fill_null(-1.0)])


for _kind, _sql in (("all", "coalesce(bool_and(coalesce(q > 0, false)), true)"), ("any", "coalesce(bool_or(q > 44), false)")):
    @query(f"bool_{_kind}", f"SELECT {_sql} AS found FROM {HOLED}")
    def _(spark, d, kind=_kind):
        f = _holed(spark, d)
        m = f.column("q").gt(0.0 if kind == "all" else 44.0).rename("m")
        return f.with_columns_only([m]).reduce(found=("m", kind))


# -- arithmetic -----------------------------------------------------------------------------------

for _kind, _sign in (("add", "+"), ("sub", "-"), ("mul", "*")):
    @query(f"arith_{_kind}_scalar", f"SELECT {SQL_KEYS}, q {_sign} 1.5::DOUBLE AS q_{_kind}_scalar FROM {HOLED}")
    def _(spark, d, kind=_kind):
        f = _holed(spark, d)
        return f.with_columns_only([*map(f.column, KEYS), getattr(f.column("q"), f"{kind}_scalar")(1.5)])

    @query(f"arith_{_kind}_series", f"SELECT {SQL_KEYS}, l_extendedprice {_sign} l_tax AS l_extendedprice_{_kind}_series_l_tax FROM lineitem")
    def _(spark, d, kind=_kind):
        f = _lines(spark, d, "l_extendedprice", "l_tax")
        return f.with_columns_only([*map(f.column, KEYS), getattr(f.column("l_extendedprice"), f"{kind}_series")(f.column("l_tax"))])

    @query(f"operator_{_kind}", f"SELECT {SQL_KEYS}, l_quantity {_sign} l_discount AS by_column, l_tax {_sign} 2.5::DOUBLE AS by_value FROM lineitem")
    def _(spark, d, kind=_kind):
        f = _lines(spark, d, "l_quantity", "l_discount", "l_tax")
        op = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}[kind]
        return f.with_columns_only([*map(f.column, KEYS), op(f.column("l_quantity"), f.column("l_discount")).rename("by_column"), op(f.column("l_tax"), 2.5).rename("by_value")])


def _whole(spark: SparkSession, d: str) -> Frame:
    """part keys, a signed integer and a divisor that is sometimes zero."""
    f = load(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    a = _own(f, (F.col("p_size") * 7 - 150).cast("int"), "a", Int32)
    b = _own(f, (F.col("p_size") % 5 - 2).cast("int"), "b", Int32)
    return f.with_columns_only([f.column("p_partkey"), f.column("p_retailprice"), a, b])


WHOLE = "(SELECT p_partkey, p_retailprice, p_size * 7 - 150 AS a, p_size % 5 - 2 AS b FROM part)"
for _kind, _op, _sign in (("div", "__truediv__", "//"), ("rem", "__mod__", "%")):
    @query(f"arith_int_{_kind}", f"SELECT p_partkey, (a {_sign} NULLIF(b, 0))::INTEGER AS by_column, (a {_sign} 4)::INTEGER AS by_value, NULL::INTEGER AS by_zero FROM {WHOLE}")
    def _(spark, d, op=_op):
        f = _whole(spark, d)
        apply = lambda other, name: getattr(f.column("a"), op)(other).rename(name)
        return f.with_columns_only([f.column("p_partkey"), apply(f.column("b"), "by_column"), apply(4, "by_value"), apply(0, "by_zero")])

    @query(f"arith_{_kind}_scalar", f"SELECT p_partkey, (a {_sign} 3)::INTEGER AS a_{_kind}_scalar, NULL::INTEGER AS a_{_kind}_scalar_by_zero FROM {WHOLE}")
    def _(spark, d, kind=_kind):
        f = _whole(spark, d)
        return f.with_columns_only([f.column("p_partkey"), *(getattr(f.column("a"), f"{kind}_scalar")(v) for v in (3, 0))])

    @query(f"arith_int_{_kind}_series", f"SELECT p_partkey, (a {_sign} b)::INTEGER AS a_{_kind}_series_b FROM {WHOLE} WHERE b <> 0")
    def _(spark, d, kind=_kind):
        f = _whole(spark, d)
        f = f.filter(f.column("b").neq(0))
        return f.with_columns_only([f.column("p_partkey"), getattr(f.column("a"), f"{kind}_series")(f.column("b"))])


@query("arith_float_div_zero_null", f"SELECT p_partkey, p_retailprice / NULLIF(b, 0)::DOUBLE AS p_retailprice FROM {WHOLE}")
def _(spark, d):
    f = _whole(spark, d)
    return f.with_columns_only([f.column("p_partkey"), f.column("p_retailprice") / _own(f, F.col("b").cast("double"), "b", Float64)])


@query("arith_float_div_ieee", f"SELECT p_partkey, CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'nan'::DOUBLE WHEN a > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE a::DOUBLE / b END AS a_div_series_b FROM {WHOLE}")
def _(spark, d):
    f = _whole(spark, d)
    a, b = (_own(f, F.col(c).cast("double"), c, Float64) for c in "ab")
    return f.with_columns_only([f.column("p_partkey"), a.div_series(b)])


@query("arith_float_rem_ieee", f"SELECT p_partkey, CASE WHEN b = 0 THEN 'nan'::DOUBLE ELSE a::DOUBLE % b::DOUBLE END AS a_rem_series_b FROM {WHOLE}")
def _(spark, d):
    f = _whole(spark, d)
    a, b = (_own(f, F.col(c).cast("double"), c, Float64) for c in "ab")
    return f.with_columns_only([f.column("p_partkey"), a.rem_series(b)])


# -- reductions -----------------------------------------------------------------------------------


@query("series_reduce", f"SELECT round(sum(q), 4) AS q_sum, min(q) AS q_min, max(q) AS q_max, round(avg(q), 8) AS q_mean, count(*) AS q_len FROM {HOLED}")
def _(spark, d):
    out = _holed(spark, d).reduce(**{f"q_{k}": ("q", k) for k in ("sum", "min", "max", "mean", "len")})
    return out.with_columns_only([_own(out, F.round("q_sum", 4), "q_sum", Float64), out["q_min"], out["q_max"], _own(out, F.round("q_mean", 8), "q_mean", Float64), out["q_len"]])


@query("series_reduce_nan", f"SELECT 'nan'::DOUBLE AS v_sum, min(v) FILTER (NOT isnan(v)) AS v_min, max(v) FILTER (NOT isnan(v)) AS v_max, 'nan'::DOUBLE AS v_mean FROM {HOLED}")
def _(spark, d):
    return _holed(spark, d).reduce(**{f"v_{k}": ("v", k) for k in ("sum", "min", "max", "mean")})


@query("series_reduce_int_text", "SELECT sum(p_size)::INTEGER AS size_sum, min(p_size) AS size_min, max(p_size) AS size_max, min(p_brand) AS brand_min, max(p_brand) AS brand_max FROM part")
def _(spark, d):
    return load(spark, d, "part").reduce(size_sum=("p_size", "sum"), size_min=("p_size", "min"), size_max=("p_size", "max"), brand_min=("p_brand", "min"), brand_max=("p_brand", "max"))


# -- strings --------------------------------------------------------------------------------------

_TEXT = {
    "contains": (("the",), "contains(text, 'the')", "text_contains_the"), "startswith": (("The",), "starts_with(text, 'The')", "text_startswith_The"), "endswith": ((".",), "suffix(text, '.')", "text_ends"),
    "str_len": ((), "strlen(text)", "text_len"), "replace": (("the", "THE"), "replace(text, 'the', 'THE')", "text_replace"), "to_lowercase": ((), "lower(text)", "text_lower"),
}
for _kind, (_args, _sql, _name) in _TEXT.items():
    @query(f"str_{_kind.removeprefix('str_')}", f"SELECT doc_id, {_sql} AS {_name} FROM documents")
    def _(spark, d, kind=_kind, args=_args, name=_name):
        f = load(spark, d, "documents", "doc_id", "text")
        return f.with_columns_only([f.column("doc_id"), getattr(f.column("text").str, kind)(*args).rename(name)])


@query("str_upper", "SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment_upper, upper(lower(c_name)) AS c_name_lower_upper FROM customer")
def _(spark, d):
    f = load(spark, d, "customer")
    return f.with_columns_only([f.column("c_custkey"), f.column("c_mktsegment").str.to_uppercase(), f.column("c_name").str.to_lowercase().str.to_uppercase()])


for _kind, _sql in (("strip", r"^\s+|\s+$"), ("lstrip", r"^\s+"), ("rstrip", r"\s+$")):
    @query(f"str_{_kind}", f"SELECT c_custkey, regexp_replace(chr(9) || ' ' || c_name || ' ' || chr(10), '{_sql}', '', 'g') AS t_{_kind} FROM customer")
    def _(spark, d, kind=_kind):
        f = load(spark, d, "customer")
        t = _own(f, F.concat(F.lit("\t "), F.col("c_name"), F.lit(" \n")), "t", String)
        return f.with_columns_only([f.column("c_custkey"), getattr(t.str, kind)()])


# -- groups ---------------------------------------------------------------------------------------

_FLOATS = ("l_extendedprice", "l_discount")


def _rounded(f: Frame, digits: int, *names: str) -> Frame:
    return f.with_columns_only([_own(f, F.round(n, digits), n, Float64) if n in names else f.column(n) for n in f.columns_names()])


@query("group_count", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupby(["o_orderpriority"]).count()


@query("group_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 4) AS l_discount FROM lineitem GROUP BY 1")
def _(spark, d):
    return _rounded(_rounded(load(spark, d, "lineitem", "l_returnflag", *_FLOATS).groupby(["l_returnflag"]).sum(), 2, "l_extendedprice"), 4, "l_discount")


@query("group_mean", "SELECT l_returnflag, round(avg(l_linenumber), 8) AS l_linenumber, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1")
def _(spark, d):
    return _rounded(_rounded(load(spark, d, "lineitem", "l_returnflag", "l_linenumber", "l_extendedprice").groupby(["l_returnflag"]).mean(), 8, "l_linenumber"), 4, "l_extendedprice")


for _kind in ("min", "max"):
    @query(f"group_{_kind}", f"SELECT p_type, {_kind}(p_partkey) AS p_partkey, {_kind}(p_name) AS p_name, {_kind}(p_brand) AS p_brand, {_kind}(p_size) AS p_size, {_kind}(p_retailprice) AS p_retailprice FROM part GROUP BY 1")
    def _(spark, d, kind=_kind):
        return getattr(load(spark, d, "part").groupby(["p_type"]), kind)()


@query("group_multi_key", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return load(spark, d, "lineitem").groupby(["l_returnflag", "l_linestatus"]).count()


@query("group_int_key", "SELECT p_size, count(*) AS count FROM part GROUP BY 1")
def _(spark, d):
    return load(spark, d, "part").groupby(["p_size"]).count()


@query("group_bool_key", "SELECT p_size > 25 AS large, sum(p_size)::INTEGER AS p_size FROM part GROUP BY 1")
def _(spark, d):
    f = load(spark, d, "part", "p_size")
    return _with(f, f.column("p_size").gt(25).rename("large")).groupby(["large"]).sum()


@query("group_null_key", "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def _(spark, d):
    f = load(spark, d, "orders", "o_orderpriority")
    return f.with_columns_only([_own(f, F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")), "o_orderpriority", String)]).groupby(["o_orderpriority"]).count()


for _kind in ("sum", "mean", "min", "max"):
    @query(f"group_nan_{_kind}", f"SELECT l_linenumber, round({'avg' if _kind == 'mean' else _kind}(v) FILTER (NOT isnan(v)), 6) AS v FROM {HOLED} GROUP BY 1")
    def _(spark, d, kind=_kind):
        return _rounded(getattr(_holed(spark, d).select(["l_linenumber", "v"]).groupby(["l_linenumber"]), kind)(), 6, "v")


@query("group_sum_saturate", "SELECT p_type, least(greatest(sum(p_size * 20000000::BIGINT), -2147483648), 2147483647)::INTEGER AS big FROM part GROUP BY 1")
def _(spark, d):
    f = load(spark, d, "part", "p_type", "p_size")
    return f.with_columns_only([f.column("p_type"), (f.column("p_size") * 20000000).rename("big")]).groupby(["p_type"]).sum()


@query("group_no_keys", "SELECT count(*) AS count FROM orders HAVING count(*) > 0")
def _(spark, d):
    return load(spark, d, "orders").groupby([]).count()


# -- joins ----------------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str, nulls: bool = False) -> tuple[Frame, Frame]:
    """Customers and suppliers by a text key of their nation and the last digit of their key."""
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    key = lambda k, n: F.concat_ws("-", F.col(n), F.col(k) % 40)
    hide = (lambda k, e: F.when(F.col(k) % 50 != 0, e)) if nulls else (lambda k, e: e)
    left = c.with_columns_only([_own(c, hide("c_custkey", key("c_custkey", "c_nationkey")), "id", String), c.column("c_custkey"), c.column("c_acctbal").rename("value")])
    right = s.with_columns_only([_own(s, hide("s_suppkey", key("s_suppkey", "s_nationkey")), "key", String), s.column("s_suppkey"), s.column("s_acctbal").rename("value")])
    return left, right


def _sides_sql(nulls: bool) -> str:
    hide = (lambda k, e: f"CASE WHEN {k} % 50 <> 0 THEN {e} END") if nulls else (lambda k, e: e)
    left = hide("c_custkey", "c_nationkey || '-' || c_custkey % 40")
    right = hide("s_suppkey", "s_nationkey || '-' || s_suppkey % 40")
    return f"WITH l AS (SELECT {left} AS id, c_custkey, c_acctbal AS value FROM customer), r AS (SELECT {right} AS key, s_suppkey, s_acctbal AS value FROM supplier) "


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    for _nulls in (False, True):
        _columns = "r.key, r.s_suppkey, r.value, l.c_custkey, l.value AS value_left" if _how == "right" else "l.id, l.c_custkey, l.value, r.s_suppkey, r.value AS value_right"

        # A full join on IS NOT DISTINCT FROM is put as two parts, as not every engine has one.
        _on = "l.id IS NOT DISTINCT FROM r.key"
        if _how == "outer":
            _body = f"SELECT {_columns} FROM l LEFT JOIN r ON {_on} UNION ALL SELECT NULL, NULL, NULL, r.s_suppkey, r.value FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE {_on})"
        elif _how == "right":
            _body = f"SELECT {_columns} FROM r LEFT JOIN l ON {_on}"
        else:
            _body = f"SELECT {_columns} FROM l {_sql} r ON {_on}"

        @query(f"join_{_how}{'_nullkey' if _nulls else ''}", _sides_sql(_nulls) + _body)
        def _(spark, d, how=_how, nulls=_nulls):
            left, right = _sides(spark, d, nulls)
            return getattr(left, f"{how}_join")(right, "id", "key")


@query("join_int_key", "SELECT o_orderkey, o_totalprice, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return load(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey").inner_join(load(spark, d, "customer", "c_custkey", "c_name"), "o_custkey", "c_custkey")


# -- order ----------------------------------------------------------------------------------------


def _placed(sorted_frame: Frame) -> Frame:
    """With each row's position, which shows the order."""
    return Frame(sorted_frame.dense().df.withColumnRenamed("__row", "place"), strict=False)


@query("sort_multi", "SELECT p_partkey, p_type, p_size, row_number() OVER (ORDER BY p_type, p_size DESC, p_partkey) - 1 AS place FROM part")
def _(spark, d):
    return _placed(load(spark, d, "part", "p_partkey", "p_type", "p_size").sort(["p_type", "p_size", "p_partkey"], [False, True, False]))


for _name, _down, _sql in (("asc", False, "q NULLS LAST, l_orderkey, l_linenumber"), ("desc", True, "q DESC NULLS FIRST, l_orderkey DESC, l_linenumber DESC")):
    @query(f"sort_nulls_{_name}", f"SELECT l_orderkey, l_linenumber, q, row_number() OVER (ORDER BY {_sql}) - 1 AS place FROM {HOLED}")
    def _(spark, d, down=_down):
        return _placed(_holed(spark, d).select([*KEYS, "q"]).sort(["q", *KEYS], [down] * 3))


@query("sort_series", "SELECT p_size, row_number() OVER (ORDER BY p_size DESC) - 1 AS place FROM part")
def _(spark, d):
    return _placed(load(spark, d, "part").column("p_size").sort(reverse=True).to_frame())


@query("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def _(spark, d):
    return load(spark, d, "orders", "o_orderkey", "o_totalprice").sort(["o_orderkey"], [False]).head(7)


@query("tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def _(spark, d):
    return load(spark, d, "orders", "o_orderkey", "o_totalprice").sort(["o_orderkey"], [False]).tail(7)


@query("slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def _(spark, d):
    return load(spark, d, "orders", "o_orderkey").sort(["o_orderkey"], [False]).slice(10, 20)


@query("take_indices", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (0, 4) UNION ALL SELECT 4, r_name FROM region WHERE r_regionkey = 4 UNION ALL SELECT NULL, NULL")
def _(spark, d):
    return load(spark, d, "region").sort(["r_regionkey"], [False]).take([4, 0, 4, None])


# -- user functions, lists, files -----------------------------------------------------------------


@query("apply_int", "SELECT p_partkey, (p_size * 3 - p_size // 2 + p_size % 5 * 10)::INTEGER AS p_size FROM part")
def _(spark, d):
    f = load(spark, d, "part", "p_partkey", "p_size")
    return f.with_columns_only([f.column("p_partkey"), f.column("p_size").apply(lambda x: x * 3 - x // 2 + x % 5 * 10)])


@query("par_apply_int_native", "SELECT p_partkey, (p_size * 3 - p_size // 2 + p_size % 5 * 10)::INTEGER AS p_size FROM part")
def _(spark, d):
    f = load(spark, d, "part", "p_partkey", "p_size")
    return f.with_columns_only([f.column("p_partkey"), f.column("p_size").par_apply(lambda c: c * 3 - F.floor(c / 2) + c % 5 * 10, native=True)])


@query("par_apply_double", "SELECT p_partkey, round(sin(p_retailprice) * cos(p_retailprice) + sqrt(p_retailprice), 9) AS p_retailprice FROM part")
def _(spark, d):
    f = load(spark, d, "part", "p_partkey", "p_retailprice")
    made = f.column("p_retailprice").par_apply(lambda x: None if x is None else math.sin(x) * math.cos(x) + math.sqrt(x), Float64)
    return f.with_columns_only([f.column("p_partkey"), _own(f, F.round(made.expr, 9), "p_retailprice", Float64)])


@query("map_changes_type", f"SELECT {SQL_KEYS}, coalesce(q > 10, false) AS q FROM {HOLED}")
def _(spark, d):
    f = _holed(spark, d)
    return f.with_columns_only([*map(f.column, KEYS), f.column("q").map(lambda x: x is not None and x > 10, Bool)])


@query("list_take", "SELECT vec_id, embedding FROM embeddings WHERE label = 3")
def _(spark, d):
    f = load(spark, d, "embeddings")
    return f.filter(f.column("label").eq(3)).select(["vec_id", "embedding"])


@query("list_inner", "SELECT unnest(embedding) AS embedding FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)")
def _(spark, d):
    f = load(spark, d, "embeddings", "vec_id", "embedding").sort(["vec_id"], [False])
    return f.column("embedding").get_inner_series(0).to_frame()


@query("list_equal", "SELECT true AS same, false AS with_others, false AS with_fewer")
def _(spark, d):
    a, b = (load(spark, d, "embeddings") for _ in range(2))
    one, two = a.column("embedding"), b.column("embedding")
    turned = two._as(F.when(F.col("vec_id") % 100 == 7, F.reverse("embedding")).otherwise(F.col("embedding")))
    return Frame(spark.createDataFrame([(one.series_equal(two), one.series_equal(turned), one.series_equal(two.head(3)))], "same boolean, with_others boolean, with_fewer boolean"))


@query("pipeline_readme", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def flagship(spark, d):
    f = load(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    f = f.filter(f.column("l_quantity").gt(25.0)).select(["l_returnflag", "l_extendedprice"])
    return _rounded(f.groupby(["l_returnflag"]).sum(), 2, "l_extendedprice").sort(["l_returnflag"], [False])


@query("csv_golden", "SELECT 'a,b' || chr(10) || '1,\"x,y\"' || chr(10) || '2.5,NA' || chr(10) AS written")
def _(spark, d):
    from quillframe.sources.csv_writer import WriteCsvOptions
    from quillframe.sources.literals import frame_of

    out = io.StringIO()
    frame_of(spark, {"a": [1.0, 2.5], "b": ["x,y", None]}).to_csv_writer(out, WriteCsvOptions(na_rep="NA"))
    return Frame(spark.createDataFrame([(out.getvalue(),)], "written string"))


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    from quillframe.sources.csv_reader import read_csv
    from quillframe.sources.csv_writer import write_parts
    from quillframe.sources.scratch import scratch

    path = scratch(spark)
    write_parts(load(spark, d, "customer"), path)
    return read_csv(spark, path)
