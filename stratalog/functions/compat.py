"""Column expressions with SQLite's meaning, for string columns that hold any kind of value.

Each is a plain built-in expression, so filters and projections stay in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def cast_int_prefix(x: Column) -> Column:
    """The integer at the start of a text, else 0; null stays null."""
    return F.when(x.isNotNull(), F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")))


def cast_real_prefix(x: Column) -> Column:
    """The number at the start of a text, else 0.0; null stays null."""
    number = F.regexp_extract(x, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(x.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def sqlite_typeof(x: Column) -> Column:
    """null, integer, real or text, from how a text reads; the empty text counts as null."""
    return F.when(x.isNull() | (x == ""), "null").when(x.rlike(r"^[+-]?[0-9]+$"), "integer").when(x.try_cast("double").isNotNull(), "real").otherwise("text")


def trim_ws(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def substr_compat(x: Column, start: int, length: int | None = None) -> Column:
    """From a 1-based place (below 1 counts as 1); null past the end; a negative length reaches to the end."""
    begin = max(start, 1)
    rest = F.substr(x, F.lit(begin)) if length is None or length < 0 else F.substr(x, F.lit(begin), F.lit(length))
    return F.when(F.length(x) >= begin, rest)


def quote(x: Column) -> Column:
    """In single quotes; the word NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("NULL"))


def glob_pattern(pattern: str) -> str:
    """GLOB as a regular expression: ``*``, ``?`` and ``[chars]`` (a plain list of characters), over the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 1)
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > i + 1:
            out.append("[" + "".join("\\" + y if not y.isalnum() else y for y in pattern[i + 1 : end]) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(x: Column, pattern: str) -> Column:
    """Whether a text matches a GLOB pattern, case-sensitively."""
    return x.rlike(glob_pattern(pattern))


def sqlite_cmp(left: Column, op: str, right: Column) -> Column:
    """Comparison of texts: as numbers if both read as numbers, else as texts; null with null operands."""
    a, b = left.try_cast("double"), right.try_cast("double")
    as_ = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    return F.when(a.isNotNull() & b.isNotNull(), as_(a, b)).otherwise(as_(left.cast("string"), right.cast("string")))


def sqlite_sum(x: Column) -> Column:
    """Sum of texts as numbers; other texts count 0, and so does an empty input."""
    return F.coalesce(F.sum(F.coalesce(x.try_cast("double"), F.lit(0.0))), F.lit(0.0))


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def truth(x: Column) -> Column:
    """Truth of a text: null unknown, ``0`` and ``false`` false, all else true."""
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(~((x.try_cast("double") == 0).eqNullSafe(F.lit(True)) | (F.lower(x) == "false")))


def empty_as_null(x: Column) -> Column:
    """For data in which the empty text stands for null."""
    return F.nullif(x, F.lit(""))
