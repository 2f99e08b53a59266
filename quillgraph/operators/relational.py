"""Relational operators that the record graph needs beyond Spark's own: validated, scoped and aligned joins, latest rows, samplers, set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class NotUnique(ValueError):
    """A key that must be unique is not."""


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, after checking that no key occurs twice."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise NotUnique(f"{keys} is not unique")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Left join where every left row meets at most one right row."""
    return left.join(assert_unique(right, keys) if check else right, keys, "left")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key are left out. The order must be total for a stable result."""
    d = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    return d.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest order of each key by one aggregation (no sort of whole groups): hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def scoped_join(left: DataFrame, right: DataFrame, narrow: list[str], wide: list[str]) -> DataFrame:
    """Inner join on the narrow keys, and on the wide ones for left rows that have no narrow match: `match_scope` says which."""
    exact = left.join(right, narrow).withColumn("match_scope", F.lit("narrow"))
    others = [c for c in right.columns if c not in wide and c not in narrow]
    whole = right.select(*wide, *others).distinct()
    missed = left.join(right.select(*narrow).distinct(), narrow, "left_anti")
    return exact.unionByName(missed.join(whole, wide).withColumn("match_scope", F.lit("wide")).select(*exact.columns))


def aligned(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides' values per key, a missing one is 0: `key, left, right`."""
    x = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full")
    return x.select(key, F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))


def set_difference_report(found: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """One row `n_missing, n_extra` of two sets of keys."""
    a, b = found.select(key).distinct(), reference.select(key).distinct()
    missing = b.join(a, key, "left_anti").select(F.lit(1).alias("missing"), F.lit(0).alias("extra"))
    extra = a.join(b, key, "left_anti").select(F.lit(0).alias("missing"), F.lit(1).alias("extra"))
    return missing.unionByName(extra).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing"), F.coalesce(F.sum("extra"), F.lit(0)).alias("n_extra"))


def divide(df: DataFrame, key: str, holds: Column) -> DataFrame:
    """Keys all of whose rows meet the condition (relational division), by one aggregation."""
    return df.groupBy(key).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("__all")).where("__all").select(key)


def bag_union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def groupings(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """The aggregates of several groupings in one pass (grouping sets): `grouping` names the columns, those not grouped by are null."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    name = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s)
        name = F.when(F.grouping_id() == bits, F.lit("+".join(s))).otherwise(name)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(name.alias("grouping"), *aggs)


def mode(value: Column) -> Column:
    """The most frequent value of a group; of several the smallest."""
    return F.mode(value, True)


# --- samplers ---------------------------------------------------------------------------------------------------------------------------


def hash_order(*cols: str) -> Column:
    """A stable order that has nothing to do with the values: the SHA-1 of the columns."""
    return F.sha1(F.concat_ws("|", *cols))


def round_robin(df: DataFrame, family: str, priority: list[Column], n: int) -> DataFrame:
    """n rows taken from the families in turn, each family in its own order."""
    r = df.withColumn("__turn", F.row_number().over(W.partitionBy(family).orderBy(*priority)))
    return r.orderBy("__turn", family).limit(n).drop("__turn")


def stratified(df: DataFrame, strata: list[str], share: float, order: Column, least: int = 1) -> DataFrame:
    """A share of each stratum (at least `least` rows), the first ones by `order`."""
    sizes = df.groupBy(*strata).agg(F.greatest(F.lit(least), F.round(F.count(F.lit(1)) * share)).alias("__quota"))
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*strata).orderBy(order)))
    on = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata))
    return ranked.alias("a").join(sizes.alias("b"), on).where("__r <= __quota").select(*[F.col(f"a.{c}") for c in df.columns])


def bucketed(df: DataFrame, column: str, keep: int, other: str = "other") -> Column:
    """`column` with all but its `keep` most frequent values (ties: the smaller) called `other`."""
    top = [r[0] for r in df.groupBy(column).count().orderBy(F.desc("count"), column).limit(keep).collect()]
    return F.when(F.col(column).isin(*top), F.col(column)).otherwise(F.lit(other))


def head_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def hash_sample(df: DataFrame, key: str, per_mille: int) -> DataFrame:
    """The rows whose key's MD5 falls into the first `per_mille` of 1000 buckets."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return df.where(bucket < per_mille)


def apportion(weights: dict[str, float], total: int) -> dict[str, int]:
    """Whole shares of `total` by largest remainder (ties: the smaller name). A handful of names, on the driver."""
    whole = sum(weights.values()) or 1
    exact = {k: total * w / whole for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def apportion_within(weights: dict[str, float], room: dict[str, int], total: int) -> dict[str, int]:
    """`apportion` where a name takes at most its room; what does not fit is shared out again among those with room left."""
    out = dict.fromkeys(weights, 0)
    while total > 0:
        free = {k: w for k, w in weights.items() if out[k] < room.get(k, 0) and w > 0}
        if not free:
            break
        given = {k: min(n, room[k] - out[k]) for k, n in apportion(free, total).items()}
        if not any(given.values()):
            break
        for k, n in given.items():
            out[k] += n
            total -= n
    return out


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of b against c discordant pairs."""
    from math import comb

    n = b + c
    return 1.0 if not n else min(1.0, 2 * sum(comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
