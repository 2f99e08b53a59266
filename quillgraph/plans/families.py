"""Question families over a universe, mined set by set: each is one aggregation that gives every anchor with its answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bridges import BRIDGES, Bridge

OUT = ("family", "anchor", "answer")
USED = frozenset({"contract_node_id", "buyer_name", "supplier_name", "release_year", "tender_category", "tender_cpv_id", "value_amount", "value_is_additive"})


def _row(family: str, anchor: list[str], answer: Column) -> list[Column]:
    return [F.lit(family).alias("family"), F.concat_ws("|", *[F.col(c).cast("string") for c in anchor]).alias("anchor"), answer.cast("string").alias("answer")]


def _filled(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.trim(F.col(c).cast("string")) != "" for c in cols)))


def existence(u: DataFrame) -> DataFrame:
    """Buyer, year and category that occur together."""
    by = ["buyer_name", "release_year", "tender_category"]
    return _filled(u, *by).select(*by).distinct().select(*_row("exists", by, F.lit(True)))


def field_equality(u: DataFrame) -> DataFrame:
    """The category of the one record of a buyer and year."""
    by = ["buyer_name", "release_year"]
    g = _filled(u, *by, "tender_category").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("tender_category").alias("c"))
    return g.where("n = 1").select(*_row("field_equality", by, F.col("c")))


def threshold(u: DataFrame, least: float) -> DataFrame:
    """Whether the additive values of a year and category exceed a number."""
    by = ["release_year", "tender_category"]
    g = _filled(u, *by).where("value_is_additive").groupBy(*by).agg(F.sum(F.col("value_amount").cast("decimal(38,6)")).alias("s"))
    return g.select(*_row("numeric_threshold", by, F.col("s") > least))


def extremes(u: DataFrame) -> DataFrame:
    """The records of the greatest and of the smallest positive value of a buyer and year (ties: the smaller key)."""
    by = ["buyer_name", "release_year"]
    g = _filled(u, *by).where("value_amount > 0").groupBy(*by)
    best = g.agg(F.min_by("contract_node_id", F.struct(-F.col("value_amount"), "contract_node_id")).alias("hi"), F.min_by("contract_node_id", F.struct("value_amount", "contract_node_id")).alias("lo"))
    return best.select(*_row("max", by, F.col("hi"))).unionByName(best.select(*_row("min", by, F.col("lo"))))


def rankings(u: DataFrame, k: int) -> DataFrame:
    """The k buyers with most records of each year, in order (ties: the smaller name)."""
    g = _filled(u, "buyer_name", "release_year").groupBy("release_year", "buyer_name").agg(F.count(F.lit(1)).alias("n"))
    top = g.withColumn("r", F.row_number().over(W.partitionBy("release_year").orderBy(F.desc("n"), "buyer_name"))).where(F.col("r") <= k)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "buyer_name"))), lambda x: x["buyer_name"]), "|")
    return top.groupBy("release_year").agg(names.alias("a")).select(*_row("top_k", ["release_year"], F.col("a")))


def sets(u: DataFrame) -> DataFrame:
    """The categories of a buyer and year."""
    by = ["buyer_name", "release_year"]
    g = _filled(u, *by, "tender_category").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("tender_category")), "|").alias("a"))
    return g.select(*_row("set", by, F.col("a")))


def comparisons(u: DataFrame) -> DataFrame:
    """Whether a buyer has more records in a year than in the year before."""
    g = _filled(u, "buyer_name", "release_year").groupBy("buyer_name", "release_year").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(W.partitionBy("buyer_name").orderBy("release_year"))
    last = F.lag("release_year").over(W.partitionBy("buyer_name").orderBy("release_year"))
    d = g.withColumn("b", before).withColumn("y", last).where("y = release_year - 1")
    return d.select(*_row("comparison", ["buyer_name", "release_year"], F.col("n") > F.col("b")))


def bridge(u: DataFrame, name: str, b: Bridge) -> DataFrame:
    """How many different values each parameter of a named sub-query gives."""
    by = list(b.by.values())
    g = _filled(u, *by, b.gives).groupBy(*by).agg(F.count_distinct(b.gives).alias("n"))
    return g.select(*_row(name, by, F.col("n")))


def extended(u: DataFrame, least: float = 1e7, k: int = 3) -> DataFrame:
    """`family, anchor, answer` of all families that need an operation of their own."""
    return reduce(DataFrame.unionByName, [existence(u), field_equality(u), threshold(u, least), extremes(u), rankings(u, k), sets(u), comparisons(u)])


def bridges(u: DataFrame) -> DataFrame:
    """`family, anchor, answer` of the families that go through a named sub-query."""
    return reduce(DataFrame.unionByName, [bridge(u, name, b) for name, b in BRIDGES.items()])
