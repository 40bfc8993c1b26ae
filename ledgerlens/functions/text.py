"""Scalar text functions as JVM expressions (no Python UDF).

F1 clean · F2 looks_like_refusal · F3 norm_label · F4 chart intent ·
F5 year detection · F13 number labels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHART_KEYWORDS, REFUSAL_PATTERNS, YEAR_2024, YEAR_2025

# Python's ``\s`` for text: ASCII whitespace, the separators U+001C–U+001F,
# NEL and every Unicode space/line/paragraph separator. Java's ``\s`` alone
# is ASCII-only.
WHITESPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """null → ''; each whitespace run → one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")),
                                   WHITESPACE_RUN, " "))


# one alternation, Unicode-aware word boundaries like Python's ``re``
REFUSAL_REGEX = "(?U)" + "|".join(f"(?:{p})" for p in REFUSAL_PATTERNS)


def looks_like_refusal(c: str | Column) -> Column:
    """any abstention pattern found in the cleaned lower-case text."""
    return F.lower(clean(c)).rlike(REFUSAL_REGEX)


def norm_label(c: str | Column) -> Column:
    """trim, lower-case, keep only [a-z0-9]."""
    return F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "")


def is_chart_question(c: str | Column) -> Column:
    """any chart keyword as a substring of the lower-cased question."""
    q = F.lower(_col(c))
    out = F.lit(False)
    for k in CHART_KEYWORDS:
        out = out | q.contains(k)
    return out


def year_flags(c: str | Column) -> tuple[Column, Column]:
    """(show_2024, show_2025); neither mentioned → both shown."""
    q = _col(c)
    has24 = F.coalesce(q.contains(YEAR_2024), F.lit(False))
    has25 = F.coalesce(q.contains(YEAR_2025), F.lit(False))
    neither = ~has24 & ~has25
    return has24 | neither, has25 | neither


def fmt2(c: str | Column) -> Column:
    """two decimals, rounded from the exact binary value, ties to even.

    x * 200 is held exactly as p + e (the product and its rounding error, by
    splitting x in halves). Only if p is an odd whole number is x near a tie, and
    then e says on which side."""
    x = _col(c).cast("double")
    big = x * 134217729.0
    high = big - (big - x)
    p = x * 200.0
    e = (high * 200.0 - p) + (x - high) * 200.0
    down, up = (p - 1) / 2, (p + 1) / 2
    near = F.abs(p % 2) == 1
    hundredths = (F.when(~near, F.round(p / 2)).when(e > 0, up).when(e < 0, down)
                  .when(down % 2 == 0, down).otherwise(up))
    return F.format_string("%.2f", hundredths / 100)
