"""Text and key expressions, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a form puts where a value is missing. Compared in lower case, without outer blanks and full stops.
STAND_INS = [
    "unknown", "not known", "none", "null", "nil", "nan", "n/a", "na", "n.a", "n/k", "tbc", "tba", "tbd", "to be confirmed", "to be advised",
    "see notice", "see attached", "see above", "see documents", "not stated", "not disclosed", "not specified", "not provided", "not available",
    "not applicable", "not given", "unspecified", "undisclosed", "various", "various suppliers", "multiple suppliers", "anonymous", "missing",
    "undefined", "confidential", "withheld", "redacted", "test",
]


def loose_key(c: Column) -> Column:
    """Letters and digits of a key in upper case; null when there is none. Equal for keys that differ in case, blanks or separators."""
    k = F.upper(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]+", ""))
    return F.when(k != "", k)


def is_blank(c: Column) -> Column:
    """Null, empty or white space (Unicode white space and zero-width characters included)."""
    return c.isNull() | (F.regexp_replace(c.cast("string"), r"[\s\p{Z}​﻿]+", "") == "")


def is_stand_in(c: Column) -> Column:
    """A blank, punctuation only, one letter repeated three times or more, or a word that stands for a missing value."""
    s = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}.]+|[\s\p{Z}.]+$", ""))
    flat = F.regexp_replace(s, r"[\s\p{Z}]+", " ")
    return F.coalesce(
        is_blank(c) | ~c.cast("string").rlike(r"[\p{L}\p{N}]") | s.rlike(r"^(\p{L})\1{2,}$") | flat.isin(*STAND_INS), F.lit(True)
    )


def day10(c: Column) -> Column:
    """The first ten characters of an ISO date kept as text."""
    return F.substring(c, 1, 10)
