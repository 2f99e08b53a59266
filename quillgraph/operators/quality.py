"""Profiles, integrity checks and outlier fences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row per column in one pass: `column, n_rows, n_null, n_blank, null_rate, example` (the smallest value)."""
    parts = []
    for c in df.columns:
        s = F.col(c).cast("string")
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.trim(s) == "").alias("n_blank"),
                F.min(F.when(F.trim(s) != "", s)).alias("example"),
            )
        )
    out = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return out.select("column", "n_rows", "n_null", "n_blank", F.coalesce(F.try_divide(F.col("n_null").cast("double"), F.col("n_rows")), F.lit(0.0)).alias("null_rate"), "example")


def outlier_fence(df: DataFrame, key: str, total: str, n: str, times: float = 1.5, least: int = 8) -> DataFrame:
    """Keys whose log10 mean lies beyond `times` interquartile ranges: `key, log_mean, lower, upper, side`. Fewer than `least` keys: none."""
    ok = df.where((F.col(n) > 0) & (F.col(total) > 0)).select(F.col(key).alias("key"), F.log10(F.col(total) / F.col(n)).alias("log_mean"))
    q = ok.agg(F.percentile("log_mean", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    q = q.select((F.col("q")[0] - times * (F.col("q")[1] - F.col("q")[0])).alias("lower"), (F.col("q")[1] + times * (F.col("q")[1] - F.col("q")[0])).alias("upper"), F.lit(1).alias("__one"))
    out = ok.withColumn("__one", F.lit(1)).join(F.broadcast(q), "__one").drop("__one")  # one row
    side = F.when(F.col("log_mean") < F.col("lower"), "low").when(F.col("log_mean") > F.col("upper"), "high")
    return out.withColumn("side", side).where("side is not null")


def contributors(df: DataFrame, by: list[str], value: Column, nominal: float = 1.0, dominant: float = 0.9) -> DataFrame:
    """Per group of `by` what stands behind a sum, in one aggregation: `n_values, largest, total, share, nominal_only, dominated`.

    Nulls contribute nothing. `nominal_only`: no value exceeds `nominal` (placeholders); `dominated`: one of several values is at least
    `dominant` of the total. A total of zero is divided as one; a group without values is neither.
    """
    g = df.withColumn("__v", value.cast("decimal(38,6)")).groupBy(*by).agg(F.count("__v").alias("n_values"), F.max("__v").cast("double").alias("largest"), F.sum("__v").cast("double").alias("total"))
    n, largest, total = F.col("n_values"), F.col("largest"), F.col("total")
    share = F.round(F.abs(largest) / F.when(total == 0, F.lit(1.0)).otherwise(F.abs(total)), 4)
    return g.withColumns({"share": share, "nominal_only": F.coalesce(largest <= nominal, F.lit(False)), "dominated": F.coalesce((n > 1) & (share >= dominant), F.lit(False))})


def determines(df: DataFrame, anchors: list[str], answer: str) -> DataFrame:
    """Rows whose anchors determine the answer: the rows of groups with exactly one distinct answer."""
    one = df.groupBy(*anchors).agg(F.count_distinct(answer).alias("__n")).where("__n = 1").select(*anchors)
    on = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in anchors))
    return df.alias("a").join(one.alias("b"), on, "left_semi")


@dataclass(frozen=True)
class Check:
    """A check of a table: rows that break it are counted; more than `allowed` of them (a share below 1) is FAIL, or WARN if it only warns."""

    area: str
    name: str
    df: DataFrame
    broken: Column | None = None
    unique: tuple[str, ...] = ()
    refers: tuple[str, DataFrame, str] | None = None
    allowed: float = 0.0
    warns: bool = False


def count_checks(checks: list[Check]) -> DataFrame:
    """`area, name, n_bad, n_rows` of all checks as one lazy frame: conditions are aggregates, keys counted per value, references anti-joined."""
    out = []
    for c in checks:
        if c.unique:
            g = c.df.groupBy(*c.unique).agg(F.count(F.lit(1)).alias("k"))
            a = g.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_bad"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"))
        elif c.refers:
            column, target, key = c.refers
            ids = target.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
            j = c.df.join(ids, F.col(column) == F.col("__k"), "left")
            a = j.agg(F.count_if(F.col("__hit").isNull()).alias("n_bad"), F.count(F.lit(1)).alias("n_rows"))
        else:
            a = c.df.agg(F.count_if(F.coalesce(c.broken, F.lit(True))).alias("n_bad"), F.count(F.lit(1)).alias("n_rows"))
        out.append(a.select(F.lit(c.area).alias("area"), F.lit(c.name).alias("name"), F.col("n_bad").cast("long").alias("n_bad"), F.col("n_rows").cast("long").alias("n_rows")))
    return reduce(DataFrame.unionByName, out)


def judge_checks(checks: list[Check], counts: DataFrame) -> DataFrame:
    """`area, name, status, n_bad, n_rows` from the counts of the checks."""
    status = F.lit(None).cast("string")
    for c in checks:
        bad = F.col("n_bad") > F.lit(c.allowed) * F.col("n_rows") if 0 < c.allowed < 1 else F.col("n_bad") > c.allowed
        status = F.when((F.col("area") == c.area) & (F.col("name") == c.name), F.when(bad, "WARN" if c.warns else "FAIL").otherwise("PASS")).otherwise(status)
    return counts.select("area", "name", status.alias("status"), "n_bad", "n_rows")


def run_checks(checks: list[Check]) -> DataFrame:
    """`area, name, status, n_bad, n_rows` of all checks as one lazy frame."""
    return reduce(DataFrame.unionByName, (judge_checks([c], count_checks([c])) for c in checks))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """`value, n, share`."""
    g = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = g.agg(F.sum("n").alias("__all"), F.lit(1).alias("__one"))
    return g.withColumn("__one", F.lit(1)).join(F.broadcast(whole), "__one").select("value", "n", (F.col("n") / F.col("__all")).alias("share"))  # one row


def flag_summary(df: DataFrame, decision: str, flags: str) -> DataFrame:
    """`flag, n` and the number of each decision, from a JSON list of flags per row."""
    f = df.select(decision, F.explode(F.from_json(flags, "array<string>")).alias("flag"))
    return f.groupBy("flag", decision).agg(F.count(F.lit(1)).alias("n"))
