"""Names to what they stand for: registries, name variants, cells and columns of a table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings as S


def name_variants(df: DataFrame, name: str) -> DataFrame:
    """`folded, name, n`: every spelling of a folded name with its rows."""
    return df.where(F.trim(name) != "").groupBy(F.lower(F.regexp_replace(F.trim(name), r"\s+", " ")).alias("folded"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def best_variant(df: DataFrame, name: str) -> DataFrame:
    """`folded, name, n_variants, n_rows`: the spelling with most rows of each folded name (ties: the smaller)."""
    v = name_variants(df, name)
    return v.groupBy("folded").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_rows"))


def derive_registry(df: DataFrame, key: str, name: str, year: str, most: int = 10) -> DataFrame:
    """`key, modal_name, variants, first_year, last_year, n_rows` of each key from its rows: the most frequent name, the `most` first variants."""
    per = df.where(F.trim(name) != "").groupBy(key, F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("a"), F.max(year).alias("b"))
    r = per.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "name")))
    return r.groupBy(key).agg(
        F.max(F.when(F.col("r") == 1, F.col("name"))).alias("modal_name"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("name")))), "|").alias("variants"),
        F.min("a").alias("first_year"), F.max("b").alias("last_year"), F.sum("n").alias("n_rows"),
    )


@dataclass(frozen=True)
class Resolved:
    names: tuple[str, ...]
    score: float
    confident: bool


def resolve_org(df: DataFrame, name: str, mention: str, least: float = 0.85, margin: float = 0.10, k: int = 5) -> Resolved:
    """The spellings of the organisation a mention means: the best equivalence class by Jaro-Winkler, confident if it is good and clearly
    before the next; an exact spelling is taken as it is."""
    v = df.where(F.trim(name) != "").groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("key", S.equivalence_key(F.col("name")))
    want = v.sparkSession.range(1).select(S.equivalence_key(F.lit(mention)).alias("k")).first()[0]
    g = v.groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names"), F.sum("n").alias("n"), F.max(F.col("name") == mention).alias("exact"))
    s = g.withColumn("score", F.when(F.col("exact"), 2.0).otherwise(S.jaro_winkler(F.col("key"), F.lit(want))))
    top = s.orderBy(F.desc("score"), F.desc("n"), "key").limit(k).collect()
    if not top:
        return Resolved((), 0.0, False)
    if top[0]["exact"]:
        return Resolved((mention,), 1.0, True)
    clear = len(top) < 2 or top[0]["score"] - top[1]["score"] >= margin
    return Resolved(tuple(top[0]["names"]), top[0]["score"], top[0]["score"] >= least and clear)


def link_cells(df: DataFrame, question: str, columns: int = 4, cells: int = 5) -> DataFrame:
    """`column, cell, score, rank`: the cells nearest to a question by shared words, `cells` of each of the best `columns` columns."""
    words = sorted(set(re.findall(r"\w+", question.lower())))
    q = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in df.columns])
    own = F.array_distinct(F.regexp_extract_all(F.lower("cell"), F.lit(r"\w+"), F.lit(0)))
    d = df.select(F.inline(pairs)).where(F.trim("cell") != "").distinct().withColumn("own", own)
    d = d.withColumn("score", F.round(F.size(F.array_intersect("own", q)) / F.greatest(F.size("own"), F.lit(1)), 6)).where("score > 0")
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("score"), "cell"))).where(F.col("rank") <= cells)
    best = d.groupBy("column").agg(F.max("score").alias("m")).orderBy(F.desc("m"), "column").limit(columns).select("column")
    return d.join(best, "column", "left_semi").select("column", "cell", "score", "rank")


def ground_literals(df: DataFrame, column: str, literals: DataFrame) -> DataFrame:
    """`literal, value`: each literal's value of the column that is the same but for case, blanks and punctuation (ties: the smaller)."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    v = df.select(F.col(column).cast("string").alias("value")).distinct().withColumn("k", fold(F.col("value"))).where("k <> ''")
    return literals.withColumn("k", fold(F.col("literal"))).join(v, "k").groupBy("literal").agg(F.min("value").alias("value"))


def ground_field(mention: str, fields: dict[str, str], wanted: str | None = None, least: float = 0.72, margin: float = 0.08) -> str | None:
    """The field (name → type) that a mention names: by an alias, else by n-gram cosine if it is near enough and clearly the nearest of those
    of the wanted type. A handful of fields, on the driver."""
    from collections import Counter
    from math import sqrt

    from ..plans.queryspec import ALIASES

    key = re.sub(r"[^a-z0-9]+", "_", mention.lower()).strip("_")
    if key in fields or ALIASES.get(key) in fields:
        return key if key in fields else ALIASES[key]

    def grams(s: str) -> Counter:
        s = f" {s.replace('_', ' ')} "
        return Counter(s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1))

    def cosine(a: Counter, b: Counter) -> float:
        norm = sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0

    own = grams(key)
    scored = sorted(((cosine(own, grams(f)), f) for f, t in fields.items() if wanted is None or t == wanted), reverse=True)
    if not scored or scored[0][0] < least or (len(scored) > 1 and scored[0][0] - scored[1][0] < margin):
        return None
    return scored[0][1]
