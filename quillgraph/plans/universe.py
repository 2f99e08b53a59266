"""The record universe: one wide row per contract, over the star schema (orders are contracts, customers buyers, suppliers suppliers)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table


@dataclass(frozen=True)
class Universe:
    """A frame of records with a unique `key`, and what its columns are."""

    df: DataFrame
    key: str = "contract_node_id"
    unique: bool = True
    #: Columns that hold a timestamp as text: an equality with a bare day means that day.
    day_fields: frozenset[str] = field(default_factory=lambda: frozenset({"release_date", "award_date_signed", "contract_period_start", "contract_period_end"}))

    #: Builds the universe again with the named columns only, so that what they do not need is neither read nor joined.
    rebuild: Callable[[frozenset[str]], Universe] | None = None

    def narrow(self, names: set[str]) -> Universe:
        """The universe with the key and those of `names` it has."""
        return self.rebuild(frozenset(names) | {self.key}) if self.rebuild else self

    @property
    def fields(self) -> frozenset[str]:
        return frozenset(self.df.columns)

    def is_array(self, name: str) -> bool:
        return isinstance(self.df.schema[name].dataType, T.ArrayType)

    def is_number(self, name: str) -> bool:
        return isinstance(self.df.schema[name].dataType, T.NumericType)


def contract_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Contract records of the star schema. Values of awards and contracts may be summed, estimates of tenders may not."""
    o = table(spark, d, "orders")
    source = F.when(F.col("o_orderstatus") == "F", "award").when(F.col("o_orderstatus") == "P", "contract").otherwise("tender")
    return o.select(
        F.concat(F.lit("contract:"), F.col("o_orderkey")).alias("contract_node_id"), F.concat(F.lit("ocds-"), F.col("o_orderkey")).alias("ocid"), F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cust_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.year("o_orderdate").alias("release_year"), F.col("o_orderpriority").alias("tender_category"),
        F.col("o_totalprice").cast("double").alias("value_amount"), source.alias("value_source"), F.col("o_orderstatus").isin("F", "P").alias("value_is_additive"),
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    """`nation_key, place`: nation and region names."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation_key"), F.concat_ws("/", "r_name", "n_name").alias("place"))


def sorted_set(c: str | Column) -> Column:
    """Distinct non-empty values in ascending order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.collect_set(F.when(c != "", c)))


def line_summary(spark: SparkSession, d: str, suppliers: bool = True, parts: bool = True, regions: bool = True) -> DataFrame:
    """Per contract, by one aggregation of its lines: sorted supplier names and places and their number; signing and period dates, product
    code and number of lines. What is not wanted is not read."""
    line = table(spark, d, "lineitem")
    aggs = []
    if suppliers:
        s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
        s = s.join(places(spark, d), F.col("s_nationkey") == F.col("nation_key"), "left") if regions else s.withColumn("place", F.lit(None).cast("string"))
        line = line.join(s.select("l_suppkey", "s_name", "place"), "l_suppkey", "left")
        aggs += [sorted_set("s_name").alias("supplier_names"), sorted_set("place").alias("supplier_regions"), F.size(F.collect_set("l_suppkey")).alias("supplier_count")]
    if parts:
        line = line.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey", "left")
        day = F.date_format("l_shipdate", "yyyy-MM-dd")
        aggs += [
            F.min("p_brand").alias("tender_cpv_id"), F.min("p_name").alias("tender_title"), F.min(day).alias("award_date_signed"), F.max(day).alias("contract_period_end"),
            F.min("l_shipdate").alias("__s"), F.max("l_shipdate").alias("__e"), F.count(F.lit(1)).cast("int").alias("evidence_count"),
        ]
    return line.groupBy(F.col("l_orderkey").alias("order_key")).agg(*aggs)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down (also below zero)."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(86400)).cast("long")


#: Columns of the universe that come from each joined side; the others are the contract's own.
FROM_BUYER = {"buyer_name", "buyer_regions", "buyer_count"}
FROM_SUPPLIERS = {"supplier_names", "supplier_name", "supplier_regions", "supplier_count"}
FROM_LINES = {"tender_cpv_id", "tender_title", "award_date_signed", "has_award_signed_date", "contract_period_end", "contract_duration_days", "evidence_count"}


def star_universe(spark: SparkSession, d: str, names: frozenset[str] | None = None) -> Universe:
    """The universe of a star-schema directory, or its columns `names` alone. Missing text is the empty string, missing numbers are null;
    NaN amounts are null. Sides of which no column is wanted are not joined."""
    wanted = lambda part: names is None or bool(names & part)
    df = contract_nodes(spark, d)
    none = F.array().cast("array<string>")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = {c: F.col(c) for c in ("contract_node_id", "ocid", "release_date", "release_year", "tender_category", "value_source", "value_is_additive")}
    out["value_amount"] = F.when(~F.isnan("value_amount"), F.col("value_amount"))
    if wanted(FROM_BUYER):
        buyer = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
        if wanted({"buyer_regions"}):
            buyer = buyer.join(places(spark, d), F.col("c_nationkey") == F.col("nation_key"), "left")
        else:
            buyer = buyer.withColumn("place", F.lit(None).cast("string"))
        df = df.join(buyer.select(F.col("c_custkey").alias("cust_key"), F.col("c_name").alias("buyer_name"), F.col("place").alias("buyer_region")), "cust_key", "left")
        out |= {"buyer_name": blank("buyer_name"), "buyer_regions": F.array_compact(F.array("buyer_region")), "buyer_count": F.when(F.col("buyer_name").isNull(), 0).otherwise(1)}
    with_suppliers, with_parts = wanted(FROM_SUPPLIERS), wanted(FROM_LINES)
    if with_suppliers or with_parts:
        df = df.join(line_summary(spark, d, with_suppliers, with_parts, wanted({"supplier_regions"})), "order_key", "left")
    if with_suppliers:
        listed = F.coalesce("supplier_names", none)
        out |= {
            "supplier_names": listed, "supplier_name": F.when(F.size(listed) > 0, listed[0]).otherwise(""), "supplier_regions": F.coalesce("supplier_regions", none),
            "supplier_count": F.coalesce("supplier_count", F.lit(0)),
        }
    if with_parts:
        out |= {
            "tender_cpv_id": blank("tender_cpv_id"), "tender_title": blank("tender_title"), "award_date_signed": blank("award_date_signed"), "has_award_signed_date": blank("award_date_signed") != "",
            "contract_period_end": blank("contract_period_end"), "contract_duration_days": days_between(F.col("__s"), F.col("__e")), "evidence_count": F.coalesce("evidence_count", F.lit(0)),
        }
    df = df.select(*[c.alias(k) for k, c in out.items() if names is None or k in names])
    return Universe(df, rebuild=lambda more: star_universe(spark, d, more))
