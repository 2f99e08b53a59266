"""Small tables of unknown schema: header names, number columns and derived views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, amount

#: Share of the non-empty cells that must read as a number, and that a derived view must give.
NUMERIC, VIEW = 0.8, {"min_year": 0.5, "month": 0.3, "date": 0.5, "noparen": 0.2, "part_1": 0.5, "part_2": 0.5}


def header_names(raw: list[str]) -> list[str]:
    """Lower-case names of letters, digits and _; empty ones are col, repeated ones get a number."""
    out: list[str] = []
    for h in raw:
        base = re.sub(r"[^a-z0-9]+", "_", h.lower()).strip("_") or "col"
        n, name = 2, base
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, with `row_no` in file order. A file whose rows differ in width is refused; \\n in a cell is a line break and \\\\ a backslash."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("no", "line")).where("line <> ''")
    cells = lines.select("no", F.split("line", "\t", -1).alias("c"))
    widths = [r[0] for r in cells.select(F.size("c")).distinct().limit(2).collect()]
    if len(widths) != 1:
        raise ValueError(f"rows of different width: {sorted(widths)}")
    names = header_names(cells.where("no = 0").first()["c"])
    # An escaped backslash first becomes a sign that no text has, so that what follows it is not read as an escape.
    def cell(i: int) -> Column:
        out = F.trim(F.col("c")[i])
        for sign, means in (("\\\\", "\ue000"), ("\\n", "\n"), ("\ue000", "\\")):
            out = F.replace(out, F.lit(sign), F.lit(means))
        return out

    return cells.where("no > 0").select((F.col("no") - 1).alias("row_no"), *[cell(i).alias(n) for i, n in enumerate(names)])


def views(c: Column) -> dict[str, Column]:
    """Readings of a text cell: first number, first year, parts of a score, month, date, text without case or parentheses."""
    text = F.trim(c)
    year = F.regexp_extract(text, r"\b((?:1[5-9]|20)\d{2})\b", 1)
    month = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS):
        month = F.when(F.lower(text).rlike(rf"\b{m[:3]}[a-z]*\b"), i + 1).otherwise(month)
    part = lambda i: F.regexp_extract(text, r"^(\d+)\s*[-–:]\s*(\d+)", i).try_cast("int")
    return {
        "min_year": year.try_cast("int"), "month": month, "date": F.coalesce(F.try_to_timestamp(text, F.lit("d MMMM yyyy")), F.try_to_timestamp(text, F.lit("MMMM d, yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date"),
        "part_1": part(1), "part_2": part(2), "noparen": F.when(text.rlike(r"\([^)]*\)\s*$"), F.trim(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", ""))),
    }


def typed(df: DataFrame) -> DataFrame:
    """The table with number columns typed (the text kept as raw_…), text columns with `__norm`, and those derived views that enough cells have.

    One aggregation decides for all columns.
    """
    cols = [c for c in df.columns if c != "row_no"]
    filled = {c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "") for c in cols}
    aggs = []
    for c in cols:
        aggs.append(F.count_if(filled[c]).alias(f"{c}|n"))
        plain = F.col(c).rlike(r"^\s*[£$€]?\s*-?[\d,]+(\.\d+)?\s*%?\s*$")
        aggs.append(F.count_if(filled[c] & plain).alias(f"{c}|num"))
        aggs += [F.count_if(filled[c] & v.isNotNull()).alias(f"{c}|{k}") for k, v in views(F.col(c)).items()]
    seen = df.agg(*aggs).first()
    out = [F.col("row_no")]
    for c in cols:
        n = max(1, seen[f"{c}|n"])
        if seen[f"{c}|n"] and seen[f"{c}|num"] / n >= NUMERIC:
            out += [amount(F.col(c)).alias(c), F.col(c).alias(f"raw_{c}")]
            continue
        out += [F.col(c), F.lower(F.regexp_replace(F.trim(F.col(c)), r"\s+", " ")).alias(f"{c}__norm")]
        out += [v.alias(f"{c}__{k}") for k, v in views(F.col(c)).items() if seen[f"{c}|{k}"] / n >= VIEW[k]]
    return df.select(*out)
