"""Equi-joins on one key of each side; a null key matches a null key.

Inner, left and outer joins give the left columns, then the right ones without
their key; a right column whose name is taken gets ``_right``.  A right join
gives the right columns first, and its left ones get ``_left``.  An outer
join's key comes from the left side alone, so rows of the right side without a
match have none.  Spark plans the null-safe key as a hash or sort-merge join.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from quillframe.dtypes import String
from quillframe.errors import DuplicateColumnName, JoinKeyTypeError

if TYPE_CHECKING:
    from quillframe.frame import Frame


def join(left: Frame, right: Frame, left_on: str, right_on: str, how: str) -> Frame:
    """``how``: inner, left, right or full_outer."""
    for side, frame, key in (("left", left, left_on), ("right", right, right_on)):
        found = frame.dtype(key)
        wrong = found != String if left.strict else found != left.dtype(left_on)
        if wrong:
            raise JoinKeyTypeError(side, key, String if left.strict else left.dtype(left_on), found)
    first, second, drop, suffix = (right, left, left_on, "_left") if how == "right" else (left, right, right_on, "_right")
    names = first.columns_names()
    a, b = ("r", "l") if how == "right" else ("l", "r")
    columns = [F.col(f"{a}.`{n}`").alias(n) for n in names]
    out = list(names)
    for n in second.columns_names():
        if n == drop:
            continue
        new = f"{n}{suffix}" if n in names else n
        if new in out:
            raise DuplicateColumnName(new)
        out.append(new)
        columns.append(F.col(f"{b}.`{n}`").alias(new))
    l, r = left.df.drop("__row").alias("l"), right.df.drop("__row").alias("r")
    matched = l.join(r, F.col(f"l.`{left_on}`").eqNullSafe(F.col(f"r.`{right_on}`")), how)
    return left._with(matched.select(*columns))
