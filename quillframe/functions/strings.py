"""String functions of a column, under its ``str`` accessor.  All keep null."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.dtypes import Bool, DType, String, UInt32
from quillframe.errors import TypeMismatch

if TYPE_CHECKING:
    from quillframe.column import Col


class Strings:
    def __init__(self, col: Col) -> None:
        if col.dtype != String:
            raise TypeMismatch(col.name, String, col.dtype)
        self.col = col

    def _made(self, expr: Column, suffix: str, dtype: DType = String) -> Col:
        return self.col._as(expr, f"{self.col.name}_{suffix}", dtype)

    def contains(self, pattern: str) -> Col:
        """Whether the literal text occurs."""
        return self._made(F.contains(self.col.expr, F.lit(pattern)), f"contains_{pattern}", Bool)

    def startswith(self, pattern: str) -> Col:
        return self._made(F.startswith(self.col.expr, F.lit(pattern)), f"startswith_{pattern}", Bool)

    def endswith(self, pattern: str) -> Col:
        return self._made(F.endswith(self.col.expr, F.lit(pattern)), f"endswith_{pattern}", Bool)

    def str_len(self) -> Col:
        """Length in bytes of UTF-8."""
        return self._made(F.octet_length(self.col.expr).cast("bigint"), "len", UInt32)

    def replace(self, old: str, new: str) -> Col:
        """Every occurrence of literal text; an empty ``old`` stands between all characters and at both ends."""
        if old:
            return self._made(F.replace(self.col.expr, F.lit(old), F.lit(new)), "replace")
        return self._made(F.regexp_replace(self.col.expr, "", re.sub(r"([\\$])", r"\\\1", new)), "replace")

    def to_lowercase(self) -> Col:
        return self._made(F.lower(self.col.expr), "lower")

    def to_uppercase(self) -> Col:
        return self._made(F.upper(self.col.expr), "upper")

    def strip(self) -> Col:
        """Without Unicode white space at both ends."""
        return self._made(F.regexp_replace(self.col.expr, r"(?U)\A\s+|\s+\z", ""), "strip")

    def lstrip(self) -> Col:
        return self._made(F.regexp_replace(self.col.expr, r"(?U)\A\s+", ""), "lstrip")

    def rstrip(self) -> Col:
        return self._made(F.regexp_replace(self.col.expr, r"(?U)\s+\z", ""), "rstrip")
