"""Rules of null, NaN, division and overflow, as Catalyst expressions."""

from __future__ import annotations

import operator
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.dtypes import DType

#: How the message of an overflow begins that Spark has no error of its own for.
OVERFLOW = "unsigned overflow"
COMPARE = {"gt": operator.gt, "lt": operator.lt, "eq": operator.eq, "neq": operator.ne, "gte": operator.ge, "lte": operator.le}


def compare(kind: str, a: Column, b: Column, dtype: DType) -> Column:
    """Null where either side is; with NaN only ``neq`` holds."""
    plain = COMPARE[kind](a, b)
    if not dtype.is_float:
        return plain
    nan = (F.isnan(a) & b.isNotNull()) | (F.isnan(b) & a.isNotNull())  # isnan of a null is false
    # A conjunction, so that a filter's plain comparison still reaches the scan.
    return plain | nan if kind == "neq" else plain & ~nan


def within(c: Column, dtype: DType) -> Column:
    """In the stored type.  Spark's own types check their bounds; unsigned ones are stored in wider types and checked here."""
    if dtype.name[0] != "U" or not dtype.is_numeric:
        return c.cast(dtype.spark)
    low, high = (F.lit(Decimal(x)).cast("decimal(38,0)") if dtype.name == "UInt64" else F.lit(x) for x in dtype.bounds)
    wrong = F.raise_error(F.concat(F.lit(f"{OVERFLOW}: "), c.cast("string"), F.lit(f" is no {dtype}")))
    return F.when((c >= low) & (c <= high), c).when(c.isNotNull(), wrong.cast(dtype.spark)).cast(dtype.spark)


def arithmetic(kind: str, a: Column, b: Column, dtype: DType, zero: str = "null") -> Column:
    """``add sub mul div rem`` in the type of the operands.

    Integer division truncates and overflow is an error.  By ``zero`` a zero
    divisor gives null, or raises for integers and follows IEEE for floats.
    """
    if kind in ("add", "sub", "mul"):
        made = {"add": operator.add, "sub": operator.sub, "mul": operator.mul}[kind](a, b)
        return within(made, dtype)
    if zero == "ieee" and dtype.is_float:
        safe = F.when(b != 0, b)
        if kind == "rem":
            return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.lit(float("nan"))).otherwise(a % safe).cast(dtype.spark)
        # The sign of a zero divisor counts: -0.0 turns the infinity round.
        negative = F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
        odd = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(F.signum(a) * negative * F.lit(float("inf")))
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, odd).otherwise(a / safe).cast(dtype.spark)
    divisor = b if zero == "ieee" else F.nullif(b, F.lit(0).cast(dtype.spark))
    if kind == "rem":
        return (a % divisor).cast(dtype.spark)
    if dtype.is_float:
        return (a / divisor).cast(dtype.spark)
    if dtype.name == "UInt64":  # div gives a signed 64-bit number
        return ((a - a % divisor) / divisor).cast(dtype.spark)
    return F.call_function("div", a, divisor).cast(dtype.spark)


def valid(c: Column, dtype: DType) -> Column:
    """The value, or null for NaN."""
    return F.when(~F.isnan(c), c) if dtype.is_float else c


def group_aggregate(kind: str, c: Column, dtype: DType) -> Column:
    """``sum mean min max`` within a group: null and NaN are skipped, a group of nothing else is null.

    Sums keep the column's type; integers stop at its bounds.
    """
    v = valid(c, dtype)
    if kind == "mean":
        return F.avg(v.cast("double"))
    if kind == "sum":
        if dtype.is_integer:
            low, high = dtype.bounds
            wide = v.cast("decimal(38,0)") if dtype.name in ("Int64", "UInt64") else v
            total = F.sum(wide)  # greatest and least pass over nulls, so a null sum is kept apart
            return F.when(total.isNotNull(), F.greatest(F.least(total, F.lit(Decimal(high) if high > 2**63 else high)), F.lit(low))).cast(dtype.spark)
        return F.sum(v.cast("double")).cast(dtype.spark)
    return getattr(F, kind)(v)


def reduce(kind: str, c: Column, dtype: DType) -> Column:
    """A whole column's ``sum min max mean len``: null is skipped; NaN reaches sums and means, not extremes."""
    if kind == "len":
        return F.count(F.lit(1))
    if kind == "mean":
        return F.avg(c.cast("double"))
    if kind == "sum":
        if dtype.is_integer:
            return within(F.sum(c.cast("decimal(38,0)") if dtype.name in ("Int64", "UInt64") else c), dtype)
        return F.sum(c).cast(dtype.spark)
    return getattr(F, kind)(valid(c, dtype))
