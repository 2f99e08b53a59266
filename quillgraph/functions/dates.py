"""Dates as typed: ISO days, written dates and amounts with multipliers."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


def iso_day(value: Any, anywhere: bool = False) -> str | None:
    """The ISO day that `value` is (or, with `anywhere`, contains)."""
    s = str(value).strip() if value is not None else ""
    m = _ISO.search(s) if anywhere else _ISO.fullmatch(s)
    return m.group() if m else None


def written_date(text: str) -> str | None:
    """'1 May 2025', 'May 1st, 2025' or an ISO text as ISO day."""
    if _ISO.match(text.strip()):
        return text.strip()[:10]
    words = re.findall(r"[A-Za-z]+|\d+", re.sub(r"(\d)(st|nd|rd|th)\b", r"\1", text))
    month = next((i + 1 for w in words for i, m in enumerate(MONTHS) if len(w) > 2 and m.startswith(w.lower())), None)
    day = next((int(w) for w in words if w.isdigit() and len(w) < 3), None)
    year = next((int(w) for w in words if w.isdigit() and len(w) == 4), None)
    return f"{year:04d}-{month:02d}-{day:02d}" if month and day and year else None


def parsed_day(c: Column) -> Column:
    """A text column in any of the usual layouts as a date; null for anything else."""
    s = F.regexp_replace(F.trim(c), r"(\d)(st|nd|rd|th)\b", "$1")
    layouts = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "dd-MM-yyyy"]
    return F.coalesce(F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")), *[F.try_to_timestamp(s, F.lit(x)) for x in layouts]).cast("date")


def amount_of(text: str) -> float | None:
    """'GBP 10 million', '£1,200.50', '3k' as a number."""
    m = re.search(r"(-?\d[\d,]*(?:\.\d+)?)\s*(k|m|bn|b|thousand|million|billion)?\b", text.lower())
    if not m:
        return None
    return float(m.group(1).replace(",", "")) * {None: 1, "k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "b": 1e9, "billion": 1e9}[m.group(2)]


def amount(c: Column) -> Column:
    """A column of written amounts as double: currency signs, thousands separators, per cent and k/m/bn multipliers; null if there is no number."""
    s = F.lower(F.trim(F.split(c, "\n")[0]))
    n = F.expr("try_cast(null as double)")
    digits = F.regexp_replace(F.regexp_extract(s, r"(-?\d[\d,]*(?:\.\d+)?)", 1), ",", "")
    unit = F.regexp_extract(s, r"\d\s*(k|m|bn|b|thousand|million|billion)\b", 1)
    times = F.when(unit.isin("k", "thousand"), 1e3).when(unit.isin("m", "million"), 1e6).when(unit.isin("bn", "b", "billion"), 1e9).otherwise(1.0)
    return F.coalesce(F.when(digits != "", digits.try_cast("double") * times), n)


def years_in(c: Column) -> Column:
    """All years 1900–2099 a text names, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
