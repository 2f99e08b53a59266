"""Best representative of each duplicate group: field-by-field survivorship in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_stand_in, loose_key

# Sources from the most to the least trusted.
TRUST = ["deterministic", "gov_lookup", "name_region_merge", "singleton", "unresolved"]
FIELDS = ["canonical_name", "org_type", "address_region", "org_category"]


def _trust(c: Column) -> Column:
    s = F.lower(F.trim(c))
    x = F.lit(0)
    for i, name in enumerate(reversed(TRUST)):
        x = F.when(s == name, F.lit(i + 1)).otherwise(x)
    return x


def survivors(df: DataFrame, fields: list[str] = FIELDS, key: str = "canonical_id", row: str = "row_id", name_field: str = "canonical_name") -> DataFrame:
    """One row per group of two or more: `group_row_id, n_rows` and for each field a struct `(value, row)` or null where none has a real value.

    Groups are keys equal in letters and digits; a row whose key has none belongs to no group. Each field takes the maximum of the struct
    (real value, trust of er_status, loaded_at, -row id): the most trusted source first, then the latest load, then the smallest row id.
    A null er_status or one not listed is trusted least, a null loaded_at is the earliest. Blanks, stand-ins and a name that only repeats
    the id are no real values. The maximum is combined before the shuffle, so a key with a third of all rows costs one row per task.
    An empty table gives an empty result; columns not named here play no part.
    """
    k = loose_key(F.col(key))
    d = df.select(k.alias("__k"), F.col(row).cast("long").alias("__row"), _trust(F.col("er_status")).alias("__t"), F.col("loaded_at").alias("__at"), *fields)
    aggs = []
    for f in fields:
        real = ~is_stand_in(F.col(f))
        if f == name_field:
            real = real & ~F.coalesce(loose_key(F.col(f)) == F.col("__k"), F.lit(False))
        best = F.max(F.when(real, F.struct("__t", F.coalesce("__at", F.timestamp_seconds(F.lit(-(10**10)))).alias("at"), (-F.col("__row")).alias("neg"), F.col(f).alias("v"))))
        aggs.append(best.alias(f))
    g = d.where("__k is not null").groupBy("__k").agg(F.min("__row").alias("group_row_id"), F.count(F.lit(1)).alias("n_rows"), *aggs).where("n_rows > 1")
    return g.select("group_row_id", "n_rows", *[F.when(F.col(f).isNotNull(), F.struct(F.col(f)["v"].alias("value"), (-F.col(f)["neg"]).alias("row"))).alias(f) for f in fields])


def survivor_rows(df: DataFrame, fields: list[str] = FIELDS, **kw) -> DataFrame:
    """`group_row_id, field_name, best_row_id`: the row each field of a group is taken from."""
    s = survivors(df, fields, **kw)
    return s.select("group_row_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["row"].alias("best_row_id")) for f in fields]))).where("best_row_id is not null")


def survivor_records(df: DataFrame, fields: list[str] = FIELDS, **kw) -> DataFrame:
    """`group_row_id, n_rows` and the surviving value of each field (null where no row has a real one)."""
    return survivors(df, fields, **kw).select("group_row_id", "n_rows", *[F.col(f)["value"].alias(f) for f in fields])
