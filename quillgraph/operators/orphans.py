"""References to records that do not exist, from signed change deltas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, loose_key

OUT = "edge_table string, edge_row_id long, ref_field string"


@dataclass(frozen=True)
class Reference:
    """A column of an edge table that refers to the key of a target table."""

    edges: DataFrame
    edge_table: str
    field: str
    target: DataFrame
    target_key: str
    target_name: str


def reference_deltas(refs: list[Reference]) -> DataFrame:
    """One row `+1 reference` for every edge and field that refers to something: `kind, k, at, edge_table, edge_row_id, ref_field`."""
    rows = [
        r.edges.where(~is_blank(F.col(r.field))).select(
            F.lit(r.target_name).alias("kind"),
            loose_key(F.col(r.field)).alias("k"),
            F.col("loaded_at").alias("at"),
            F.lit(r.edge_table).alias("edge_table"),
            F.col("row_id").cast("long").alias("edge_row_id"),
            F.lit(r.field).alias("ref_field"),
        )
        for r in refs
    ]
    return reduce(DataFrame.unionAll, rows)


def existence_deltas(refs: list[Reference]) -> DataFrame:
    """Signed existence per target key and instant: +1 where a row is loaded, -1 where it is withdrawn; `kind, k, at, delta`.

    A row without loaded_at was never there; one withdrawn at or before it was loaded is never in force. Rows of a key that change at the
    same instant are summed before anything is shuffled.
    """
    seen, rows = set(), []
    for r in refs:
        if r.target_name in seen:
            continue
        seen.add(r.target_name)
        live = r.target.where(F.col("loaded_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at"))))
        ends = F.array(F.struct(F.col("loaded_at").alias("at"), F.lit(1).alias("d")), F.struct(F.col("deleted_at").alias("at"), F.lit(-1).alias("d")))
        rows.append(
            live.select(F.lit(r.target_name).alias("kind"), loose_key(F.col(r.target_key)).alias("k"), F.inline(ends))
            .where(F.col("k").isNotNull() & F.col("at").isNotNull())
        )
    return reduce(DataFrame.unionAll, rows).groupBy("kind", "k", "at").agg(F.sum("d").cast("long").alias("delta"))


def orphan_ledger(refs: list[Reference]) -> DataFrame:
    """Every reference with the existence count of its key at the moment the edge was loaded.

    References and existence deltas of a key are one time line. It is cut into months, so a key that holds a third of all rows is spread
    over as many tasks as there are months; a month starts from the sum of the deltas before it (one pre-aggregated row per key and month)
    and runs on from there. Deltas count at the instant they happen, hence before the references of the same instant.
    Columns: kind, k, at, edge_table, edge_row_id, ref_field, existing (0 or less: orphan). A key without letters or digits and an edge
    without loaded_at have no existing target. Repeated edges are judged one by one.
    """
    ref = reference_deltas(refs)
    events = (
        ref.withColumn("delta", F.lit(0).cast("long"))
        .unionByName(existence_deltas(refs), allowMissingColumns=True)
        .withColumn("m", F.coalesce(F.year("at") * 12 + F.month("at"), F.lit(-1)))
    )
    # Events in time order within key and month; the deltas of earlier months come as one opening row.
    monthly = events.where("k is not null").groupBy("kind", "k", "m").agg(F.sum("delta").alias("delta"))
    before = W.partitionBy("kind", "k").orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    opening = monthly.select("kind", "k", "m", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("delta")).where("delta <> 0")
    line = events.withColumn("p", F.when(F.col("edge_row_id").isNull(), 1).otherwise(2)).unionByName(opening.withColumn("p", F.lit(0)), allowMissingColumns=True)
    run = W.partitionBy("kind", "k", "m").orderBy(F.expr("p > 0"), F.col("at"), "p").rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = line.where("k is not null").withColumn("existing", F.sum("delta").over(run)).where("p = 2")
    # An edge without loaded_at is in month -1, where no delta is.
    keyless = ref.where("k is null").withColumn("existing", F.lit(0).cast("long"))
    cols = ["kind", "k", "at", "edge_table", "edge_row_id", "ref_field", "existing"]
    return ran.select(*cols).unionByName(keyless.select(*cols))


def orphans(refs: list[Reference]) -> DataFrame:
    """The references whose key does not exist when their edge is loaded: `edge_table, edge_row_id, ref_field`. Blank references are none."""
    return orphan_ledger(refs).where("existing <= 0").select("edge_table", "edge_row_id", "ref_field")


def orphan_report(refs: list[Reference]) -> DataFrame:
    """Orphans per edge table, field and month of loaded_at: `edge_table, ref_field, month, n_refs, n_orphans` (month null: no loaded_at)."""
    month = F.date_format("at", "yyyy-MM")
    return (
        orphan_ledger(refs)
        .groupBy("edge_table", "ref_field", month.alias("month"))
        .agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("existing") <= 0).alias("n_orphans"))
    )


def current_orphan_keys(refs: list[Reference]) -> DataFrame:
    """Keys with references but no target now: signed counts per key, `kind, k, n_refs, existing` where n_refs > 0 and existing <= 0."""
    r = reference_deltas(refs).where("k is not null").groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n_refs"), F.lit(0).cast("long").alias("e"))
    x = existence_deltas(refs).groupBy("kind", "k").agg(F.lit(0).cast("long").alias("n_refs"), F.sum("delta").alias("e"))
    both = r.unionByName(x).groupBy("kind", "k").agg(F.sum("n_refs").alias("n_refs"), F.sum("e").alias("existing"))
    return both.where("n_refs > 0 and existing <= 0")


STATE = "kind string, k string, refs long, existing long"


def signed_counts(refs: list[Reference], sign: int = 1, upto: str | None = None, after: str | None = None) -> DataFrame:
    """Signed reference and existence counts per key, `kind, k, refs, existing`, of what happened after one instant and not after another.

    With `sign` -1 the rows are taken back. Both kinds of counts are pre-aggregated in one shuffle, so a hot key is one row a task. An edge
    or target without loaded_at never happened; a null or letterless key is no key.
    """
    r = reference_deltas(refs).where("k is not null").select("kind", "k", "at", F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("existing"))
    x = existence_deltas(refs).select("kind", "k", "at", F.lit(0).cast("long").alias("refs"), (F.col("delta") * sign).alias("existing"))
    rows = r.unionByName(x).where("at is not null")
    if upto is not None:
        rows = rows.where(F.col("at") <= F.lit(upto).cast("timestamp"))
    if after is not None:
        rows = rows.where(F.col("at") > F.lit(after).cast("timestamp"))
    return rows.groupBy("kind", "k").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The ledger `state` (`kind, k, refs, existing`) after signed counts of the same form; keys whose counts are both zero leave it.

    Addition in any order, so late, repeated-and-taken-back and out-of-order changes end in the same state as a recomputation. Only what
    changed is read besides the state; a state bucketed by key needs no shuffle of its own.
    """
    both = state.select("kind", "k", "refs", "existing").unionByName(deltas.select("kind", "k", "refs", "existing"))
    return both.groupBy("kind", "k").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")).where("refs <> 0 or existing <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current report of a ledger: keys with references and nothing they refer to."""
    return state.where("refs > 0 and existing <= 0").select("kind", "k", F.col("refs").alias("n_refs"), "existing")
