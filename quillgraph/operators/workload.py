"""Question workloads: specs mined from the records, twins, split hygiene, routing and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings as S
from ..session import cut
from .relational import hash_order, round_robin


def mine_groups(df: DataFrame, key: str, groupings: list[list[str]], low: int, high: int) -> DataFrame:
    """`fields, anchor, n`: combinations of values with between `low` and `high` records, of several groupings in one pass."""
    cols = list(dict.fromkeys(c for g in groupings for c in g))
    shown = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols])
    g = shown.groupingSets([[F.col(c) for c in s] for s in groupings], *[F.col(c) for c in cols]).agg(F.count_distinct(key).alias("n"), *[F.grouping(c).alias(f"__g_{c}") for c in cols])
    anchor = F.concat_ws("|", *[F.when(F.col(f"__g_{c}") == 0, F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("")))) for c in cols])
    fields = F.concat_ws("+", *[F.when(F.col(f"__g_{c}") == 0, F.lit(c)) for c in cols])
    filled = reduce(lambda a, b: a & b, (((F.col(f"__g_{c}") == 1) | (F.trim(c) != "")) for c in cols))
    return g.where(filled & F.col("n").between(low, high)).select(fields.alias("fields"), anchor.alias("anchor"), "n")


def sample_specs(groups: DataFrame, n: int) -> DataFrame:
    """n of the mined combinations, the groupings in turn, each in the order of its anchors' hash."""
    return round_robin(groups, "fields", [hash_order("anchor"), F.col("anchor")], n)


def boolean_twins(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """`a, yes, no`: for n values of `a` a value of `b` that occurs with it and one that does not (the first by hash): twin questions of
    opposite answer. Values of `b` must be few; they are one array."""
    seen = df.where((F.trim(a) != "") & (F.trim(b) != "")).groupBy(F.col(a).alias("a")).agg(F.array_sort(F.collect_set(F.col(b).cast("string"))).alias("own"))
    every = df.where(F.trim(b) != "").agg(F.array_sort(F.collect_set(F.col(b).cast("string"))).alias("all"), F.lit(1).alias("one"))
    d = seen.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").withColumn("rest", F.array_except("all", "own")).where(F.size("rest") > 0)
    pick = lambda c: F.col(c)[F.pmod(F.xxhash64("a"), F.size(c)).cast("int")]
    return d.select("a", pick("own").alias("yes"), pick("rest").alias("no")).orderBy(hash_order("a"), "a").limit(n)


def split_leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """`key, splits, n`: keys that stand in more than one split."""
    g = rows.where(F.col(key).isNotNull() & (F.trim(split) != "")).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.where(F.size("s") > 1).select(key, F.array_join("s", "|").alias("splits"), "n")


def seal_report(rows: DataFrame, keys: list[str], split: str, train: str) -> DataFrame:
    """`key, n_rows, n_leaked`: held-out rows, and those whose key also stands in training, for each key."""
    out = []
    for k in keys:
        d = rows.where(F.col(k).isNotNull() & (F.trim(k) != ""))
        held = d.where((F.col(split) != train) & (F.trim(split) != ""))
        seen = d.where(F.col(split) == train).select(k).distinct().withColumn("__in", F.lit(True))
        out.append(held.join(seen, k, "left").agg(F.lit(k).alias("key"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce("__in", F.lit(False))).alias("n_leaked")))
    return reduce(DataFrame.unionByName, out)


def trigram_similar(a: DataFrame, b: DataFrame, block: str, text: str, key: str, least: float = 0.7) -> DataFrame:
    """`a, b, jaccard`: rows of two sides of one block whose texts share character trigrams."""
    side = lambda d, s: d.select(F.col(key).alias(s), F.col(block).alias("__block"), S.char_ngrams(F.lower(text), 3).alias(f"g{s}"))
    j = side(a, "a").join(side(b, "b"), "__block").withColumn("jaccard", F.round(S.jaccard(F.col("ga"), F.col("gb")), 6))
    return j.where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def cut_at_total(groups: DataFrame, order: list, size: str, target: int, buckets: int = 64) -> DataFrame:
    """Groups in their order until their sizes reach the target; the one that reaches it is the last.

    Groups are cut into ranges of their order by Spark's range partitioning; sizes before a range are sums of whole ranges, so no task
    sees all groups.
    """
    ranges = groups.repartitionByRange(buckets, *order).withColumn("__p", F.spark_partition_id())
    ranges = cut(ranges)
    sums = ranges.groupBy("__p").agg(F.sum(size).alias("__s"))
    starts = sums.select("__p", F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # at most `buckets` rows
    inside = F.coalesce(F.sum(size).over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = ranges.withColumn("__in", inside).join(F.broadcast(starts), "__p")
    return d.where(F.col("__start") + F.col("__in") < target).drop("__p", "__in", "__start")


def top_up(have: DataFrame, pool: DataFrame, key: str, target: int, order: list) -> DataFrame:
    """`have` with rows of the pool whose key it lacks, first by order, until it has `target` rows."""
    missing = max(0, target - have.count())
    return have.unionByName(pool.join(have.select(key), key, "left_anti").orderBy(*order).limit(missing).select(*have.columns))


def route(plans: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """`key, route`: accepted if the verdict is pass, regenerate after a first failure, rejected after more, pending without a verdict.

    `verdicts` has `key, passed, attempt`; the latest attempt counts.
    """
    last = verdicts.groupBy(key).agg(F.max_by("passed", "attempt").alias("passed"), F.max("attempt").alias("attempt"))
    r = F.when(F.col("attempt").isNull(), "pending").when(F.col("passed"), "accepted").when(F.col("attempt") <= 1, "regenerate").otherwise("rejected")
    return plans.select(key).join(last, key, "left").select(key, r.alias("route"))


def pass_at_k(runs: DataFrame, family: str, item: str, passed: str) -> DataFrame:
    """`family, n_items, pass_at_k, mean_hits`: the share of items with any hit, and hits per item."""
    per = runs.groupBy(family, item).agg(F.count_if(F.col(passed)).alias("hits"))
    return per.groupBy(family).agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("pass_at_k"), F.round(F.avg("hits"), 6).alias("mean_hits"))


def paired(a: DataFrame, b: DataFrame, key: str, hit: str) -> DataFrame:
    """One row `n, both, only_a, only_b, neither` of two runs over the same items; mcnemar_p judges the two middle ones."""
    j = a.select(key, F.col(hit).alias("x")).join(b.select(key, F.col(hit).alias("y")), key)
    n = lambda c, name: F.count_if(c).alias(name)
    x, y = F.col("x"), F.col("y")
    return j.agg(F.count(F.lit(1)).alias("n"), n(x & y, "both"), n(x & ~y, "only_a"), n(~x & y, "only_b"), n(~x & ~y, "neither"))


def usage(runs: DataFrame, by: str, tokens: str, error: str) -> DataFrame:
    """`by, n, tokens, p50, p95, n_errors`."""
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"), F.percentile(tokens, 0.5).alias("p50"), F.percentile(tokens, 0.95).alias("p95"), F.count_if(F.coalesce(F.trim(error) != "", F.lit(False))).alias("n_errors")
    )


def adjudicated(decisions: DataFrame, least: float = 0.9) -> DataFrame:
    """Decisions on pairs with `valid` (a known decision, a confidence in [0, 1], different ends) and `gate`: merge only if valid, confident,
    and without a flag that forbids it; else review or reject."""
    known = F.col("decision").isin("merge", "reject", "review")
    valid = F.coalesce(known & F.col("confidence").between(0, 1) & (F.col("a") != F.col("b")), F.lit(False))
    barred = F.exists(F.coalesce("risk_flags", F.array().cast("array<string>")), lambda f: f.isin("official_scheme_conflict", "trusted_id_conflict"))
    gate = F.when(~valid, "invalid").when((F.col("decision") == "merge") & (F.col("confidence") >= least) & ~barred, "merge").when(F.col("decision") == "reject", "reject").otherwise("review")
    return decisions.withColumn("valid", valid).withColumn("gate", gate)


def without_fields(rows: DataFrame, fields: DataFrame, hidden: list[str], key: str) -> DataFrame:
    """`rows` less those of which a constraint names a hidden field, with `reason` null; the dropped ones come with the reason.

    `fields` is `key, field`, one row a constraint. A row without constraints stays.
    """
    bad = fields.where(F.col("field").isin(*hidden)).groupBy(key).agg(F.concat(F.lit("hidden:"), F.array_join(F.array_sort(F.collect_set("field")), ",")).alias("reason"))
    return rows.join(bad, key, "left")


def boundary_ties(counts: DataFrame, group: str, name: str, n: str, k: int) -> DataFrame:
    """`group, n, n_tied, n_places`: groups whose top k would depend on the order of rows: more names share the k-th count than places are left."""
    w = W.partitionBy(group).orderBy(F.desc(n))
    d = counts.withColumn("__rank", F.rank().over(w))
    per = d.groupBy(group, F.col(n).alias("n"), "__rank").agg(F.count(F.lit(1)).alias("n_tied"))
    return per.where((F.col("__rank") <= k) & (F.col("__rank") + F.col("n_tied") - 1 > k)).select(group, "n", "n_tied", (F.lit(k + 1) - F.col("__rank")).cast("long").alias("n_places"))


def whole_splits(rows: DataFrame, key: str, split: str, order: list[str]) -> DataFrame:
    """`rows` with `new_split`: rows of one key all stand in the split that holds most of them (ties: the first of `order`).

    Rows without key or split keep what they have; splits outside `order` come last.
    """
    place = reduce(lambda x, i: F.when(F.col(split) == order[i], i).otherwise(x), range(len(order)), F.lit(len(order)))
    held = rows.where(F.col(key).isNotNull() & (F.trim(split) != "")).groupBy(key, split).agg(F.count(F.lit(1)).alias("__n")).withColumn("__place", place)
    home = held.groupBy(key).agg(F.min_by(split, F.struct(-F.col("__n"), F.col("__place"), F.col(split))).alias("__home"))
    return rows.join(home, key, "left").withColumn("new_split", F.when(F.trim(split) != "", F.coalesce("__home", split)).otherwise(F.col(split))).drop("__home")
