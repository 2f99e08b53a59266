"""Queries of problem 1 (references to records that do not exist) over the graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import STATE, Reference, apply_deltas, current_orphan_keys, orphan_keys, orphan_report, orphans, signed_counts
from ..session import table


def graph_references(spark: SparkSession, d: str) -> list[Reference]:
    """The three references of the graph: both edge tables to organisations, buyer edges to contract records."""
    org = table(spark, d, "org_nodes").select("canonical_id", "loaded_at", "deleted_at")
    rec = table(spark, d, "runtime_records").select("contract_node_id", "loaded_at", "deleted_at")
    buyer = table(spark, d, "buyer_of").select("row_id", "canonical_id", "contract_node_id", "loaded_at")
    supplier = table(spark, d, "supplier_of").select("row_id", "canonical_id", "loaded_at")
    return [
        Reference(buyer, "buyer_of", "canonical_id", org, "canonical_id", "org"),
        Reference(supplier, "supplier_of", "canonical_id", org, "canonical_id", "org"),
        Reference(buyer, "buyer_of", "contract_node_id", rec, "contract_node_id", "record"),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All orphan references at load time."""
    return orphans(graph_references(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per edge table, field and month."""
    return orphan_report(graph_references(spark, d))


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and do not exist now."""
    x = current_orphan_keys(graph_references(spark, d))
    return x.select("kind", F.col("k").alias("key"), "n_refs", F.col("existing").cast("long").alias("existing"))


#: Instants up to which the maintained ledger takes in its changes, one batch after the other; the last batch is all that follows.
BATCHES = ("2020-01-01", "2022-07-01", "2024-01-01")


def p1_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and do not exist, from a ledger kept up by batches of changes."""
    refs = graph_references(spark, d)
    state = spark.createDataFrame([], STATE)
    for after, upto in zip((None, *BATCHES), (*BATCHES, None)):
        state = apply_deltas(state, signed_counts(refs, after=after, upto=upto))
    return orphan_keys(state).select("kind", F.col("k").alias("key"), "n_refs", "existing")


_KEY = "nullif(upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '')"
_REFS = f"""
  refs as (
    select 'buyer_of' as edge_table, row_id as edge_row_id, 'canonical_id' as ref_field, 'org' as kind, canonical_id as v, {_KEY.format(c="canonical_id")} as k, loaded_at from buyer_of
    union all select 'supplier_of', row_id, 'canonical_id', 'org', canonical_id, {_KEY.format(c="canonical_id")}, loaded_at from supplier_of
    union all select 'buyer_of', row_id, 'contract_node_id', 'record', contract_node_id, {_KEY.format(c="contract_node_id")}, loaded_at from buyer_of
  ),
  r as (select * from refs where v is not null and regexp_replace(v, '[\\s\\p{{Z}}]+', '', 'g') <> ''),
  t as (
    select 'org' as kind, {_KEY.format(c="canonical_id")} as k, loaded_at, deleted_at from org_nodes
    union all select 'record', {_KEY.format(c="contract_node_id")}, loaded_at, deleted_at from runtime_records
  ),
  judged as (
    select r.*, exists(select 1 from t where t.kind = r.kind and t.k = r.k and t.loaded_at <= r.loaded_at and (t.deleted_at is null or t.deleted_at > r.loaded_at)) as ok from r
  )
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_current": p1_current, "p1_maintained": p1_maintained}
SQL = {
    "p1_found": f"with {_REFS} select edge_table, edge_row_id, ref_field from judged where not ok",
    "p1_report": f"""with {_REFS} select edge_table, ref_field, strftime(loaded_at at time zone 'UTC', '%Y-%m') as month, count(*) as n_refs, count(*) filter (not ok) as n_orphans
        from judged group by all""",
    "p1_current": f"""with {_REFS}, n as (select kind, k, count(*) as n_refs from r where k is not null group by all),
        x as (select kind, k, sum(case when deleted_at is null then 1 else 0 end) as existing from t where k is not null and loaded_at is not null and (deleted_at is null or deleted_at > loaded_at) group by all)
        select n.kind, n.k as key, n.n_refs, cast(coalesce(x.existing, 0) as bigint) as existing from n left join x on n.kind = x.kind and n.k = x.k where coalesce(x.existing, 0) <= 0""",
    "p1_maintained": f"""with {_REFS}, n as (select kind, k, count(*) as n_refs from r where k is not null and loaded_at is not null group by all),
        x as (select kind, k, sum(case when deleted_at is null then 1 else 0 end) as existing from t where k is not null and loaded_at is not null and (deleted_at is null or deleted_at > loaded_at) group by all)
        select n.kind, n.k as key, n.n_refs, cast(coalesce(x.existing, 0) as bigint) as existing from n left join x on n.kind = x.kind and n.k = x.k where coalesce(x.existing, 0) <= 0""",
}
