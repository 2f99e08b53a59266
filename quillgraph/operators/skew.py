"""Joins and prefix sums that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 1 / 64, least: int = 50_000) -> list:
    """Keys that hold more than `share` of the rows and more than `least` rows. There are at most 1/share of them, whatever the data."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least)
    top = counts.orderBy(F.desc("count")).limit(int(1 / share)).collect()
    if not top:
        return []
    total = df.count()
    return [r[0] for r in top if r["count"] > share * total]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy: list | None = None, salts: int = 32) -> DataFrame:
    """`left` joined with `right` (unique per key) where a heavy key of `left` is spread over `salts` tasks.

    Only the rows of `right` that belong to heavy keys are repeated, once for each salt. Rows with a null key match nothing.
    """
    hot = heavy_keys(left, key) if heavy is None else heavy
    if not hot:
        return left.join(right, key, how)
    others = [c for c in left.columns if c != key]
    salt = F.when(F.col(key).isin(*hot), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(F.lit(0))
    spread = F.when(F.col(key).isin(*hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.withColumn("__salt", salt.cast("int"))
    b = right.withColumn("__salt", F.explode(spread))
    return a.join(b, [key, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, group: list[str], order: Column, name: str = "__rank", buckets: int = 64) -> DataFrame:
    """Rows numbered from 1 within `group` by `order` (a long hash or number), without one task for a large group.

    Rows are bucketed by the order's high bits; a row's number is the size of the earlier buckets plus its place in its own.
    """
    from pyspark.sql import Window as W

    width = (2**63) // (buckets // 2)
    d = df.withColumn("__o", order.cast("long")).withColumn("__b", F.floor(F.col("__o") / F.lit(width)).cast("int"))
    sizes = d.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    on = reduce(lambda a, b: a & b, (F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in [*group, "__b"]))
    inner = W.partitionBy(*group, "__b").orderBy("__o")
    d = d.withColumn("__r", F.row_number().over(inner))
    return d.alias("d").join(starts.alias("s"), on).select(*[F.col(f"d.{c}") for c in df.columns], (F.col("__r") + F.col("__s")).alias(name))
