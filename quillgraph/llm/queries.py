"""Queries of problems 2 to 10 and their SQL, where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STAND_INS
from ..session import cut, table
from . import leakage, linkage, mojibake, names, neardup, overlap, splits, survivor, tokenize


def p2_scored(spark: SparkSession, d: str) -> DataFrame:
    """Matching observations and register rows with their confidence."""
    return linkage.matches(table(spark, d, "party_obs"), table(spark, d, "canonical_orgs"), table(spark, d, "er_pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Matching observations and register rows."""
    return p2_scored(spark, d).select("obs_id", "org_no")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Training and held-out rows that ask the same."""
    return overlap.overlaps(table(spark, d, "qa_rows")).select("row_id_a", "row_id_b").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, affected held-out rows and their mean coverage per split, source and kind of overlap."""
    rows = table(spark, d, "qa_rows").select("row_id", F.lower(F.trim("split")).alias("split"), "source")
    held = rows.where(F.col("split").isin(*overlap.HELD_OUT))
    ends = overlap.overlaps(table(spark, d, "qa_rows")).select("by", "coverage", F.explode(F.array("row_id_a", "row_id_b")).alias("row_id"))
    return (
        ends.join(held, "row_id").groupBy("split", "source", "by")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("row_id").alias("n_rows"), F.round(F.avg("coverage"), 4).alias("coverage"))
    )


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every held-out row that also stands in training: how many training rows ask the same, and how far the nearest one covers its question."""
    rows = table(spark, d, "qa_rows").select("row_id", F.lower(F.trim("split")).alias("split"))
    held = rows.where(F.col("split").isin(*overlap.HELD_OUT))
    pairs = overlap.overlaps(table(spark, d, "qa_rows"))
    ends = pairs.groupBy("row_id_a", "row_id_b").agg(F.max("coverage").alias("coverage")).select("coverage", F.explode(F.array("row_id_a", "row_id_b")).alias("row_id"))
    return ends.join(held, "row_id").groupBy("row_id", "split").agg(F.count(F.lit(1)).alias("n_links"), F.round(F.max("coverage"), 4).alias("coverage"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows bound to another row, with the smallest row id of their chain."""
    g = splits.bound_rows(table(spark, d, "qa_rows"))
    sizes = g.groupBy("group_row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_row_id")
    return g.join(sizes, "group_row_id", "left_semi").select("row_id", "group_row_id")


def p4_assign(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its split."""
    return splits.assign_splits(table(spark, d, "qa_rows"))


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows per stratum, template family and split."""
    rows = table(spark, d, "qa_rows").select("row_id", "stratum", "template_family")
    return p4_assign(spark, d).join(rows, "row_id").groupBy("stratum", "template_family", "split").agg(F.count(F.lit(1)).alias("n_rows"))


NAMES = ["buyer_name", "supplier_name"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one organisation."""
    return names.variant_pairs(table(spark, d, "runtime_records"), NAMES)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the leading one of its organisation."""
    return names.variant_groups(table(spark, d, "runtime_records"), NAMES)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The row each field of a surviving organisation record is taken from."""
    return survivor.survivor_rows(table(spark, d, "org_nodes"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group of organisation rows."""
    return survivor.survivor_records(table(spark, d, "org_nodes"))


QUESTIONS = ["natural_question", "canonical_question"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of questions that agree in three quarters of the words of the longer one."""
    return neardup.duplicate_pairs(table(spark, d, "qa_bank"), QUESTIONS)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicate questions."""
    return neardup.duplicate_groups(table(spark, d, "qa_bank"), QUESTIONS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per source, and how many documents do not come back from their ids letter for letter."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    coded = cut(tokenize.encode_corpus(docs))
    back = tokenize.decode_corpus(coded).withColumnRenamed("text", "back").join(coded.select("doc_id", F.size("ids").alias("n")), "doc_id")
    return (
        docs.join(back, "doc_id").groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.count_if(F.coalesce("text", F.lit("")) != F.col("back")).alias("n_changed"))
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold evaluation passages."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of documents to remove."""
    return leakage.removal_spans(leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and affected documents per evaluation split and source."""
    items = table(spark, d, "eval_items").select("item_id", "split", "source")
    return p9_found(spark, d).join(items, "item_id").groupBy("split", "source").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that show a wrong decoding."""
    return mojibake.repair_corpus(table(spark, d, "documents")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents with their text restored as far as it can be."""
    return mojibake.repair_corpus(table(spark, d, "documents")).where("garbled").select("doc_id", "text")


def _sql_key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '')"


def _sql_real(c: str) -> str:
    words = ", ".join("'" + w + "'" for w in STAND_INS)
    s = f"regexp_replace(lower(regexp_replace({c}, '^[\\s\\p{{Z}}.]+|[\\s\\p{{Z}}.]+$', '', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g')"
    return f"coalesce(regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') and {s} not in ({words}) and not regexp_matches({s}, '^({'|'.join(x * 3 + '+' for x in 'abcdefghijklmnopqrstuvwxyz')})$'), false)"


_P6 = f"""with d as (select *, {_sql_key("canonical_id")} as k, case lower(trim(er_status)) {" ".join(f"when '{t}' then {5 - i}" for i, t in enumerate(survivor.TRUST))} else 0 end as t from org_nodes),
  g as (select k, min(row_id) as group_row_id, count(*) as n_rows from d where k is not null group by k having count(*) > 1),
  f as ({" union all ".join(f"select k, row_id, t, loaded_at, '{f}' as field_name, {f} as v from d where {_sql_real(f)}" + (f" and coalesce({_sql_key(f)} <> k, true)" if f == "canonical_name" else "") for f in survivor.FIELDS)}),
  b as (select *, row_number() over (partition by k, field_name order by t desc, loaded_at desc nulls last, row_id) as rn from f)"""

_P4 = f"""with recursive d as (select row_id, {_sql_key("plan_id")} as p, {_sql_key("dedup_group")} as g from qa_rows),
  e as (select a.row_id as a, b.row_id as b from d a join d b on a.p = b.p union select a.row_id, b.row_id from d a join d b on a.g = b.g),
  r(row_id, grp) as (select row_id, row_id from d union select e.b, r.grp from r join e on e.a = r.row_id),
  m as (select row_id, min(grp) as group_row_id from r group by row_id)"""

QUERIES = {"p2_found": p2_found, "p2_scored": p2_scored, "p3_found": p3_found, "p3_report": p3_report, "p3_rows": p3_rows, "p4_found": p4_found, "p4_assign": p4_assign, "p4_balance": p4_balance, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_records": p6_records, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p8_stats": p8_stats, "p9_found": p9_found, "p9_spans": p9_spans, "p9_report": p9_report, "p10_found": p10_found, "p10_restored": p10_restored}
_P7 = """with w as (select row_id, f, list_filter(list_transform(regexp_split_to_array(lower(t), '\\s+'), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')), lambda x: x <> '') as ws
    from (select row_id, 'n' as f, natural_question as t from qa_bank union all select row_id, 'c', canonical_question from qa_bank)),
  x as (select row_id, f, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as p from w where len(ws) > 0),
  o as (select *, row_number() over (partition by row_id, f, word order by p) as k from x)"""

SQL = {
    "p7_found": f"""{_P7}, s as (select a.row_id as row_id_a, b.row_id as row_id_b, count(*) as c, max(greatest(a.n, b.n)) as m
        from o a join o b on a.f = b.f and a.word = b.word and a.k = b.k and a.row_id < b.row_id group by a.row_id, b.row_id, a.f)
      select distinct row_id_a, row_id_b from s where c >= 0.75 * m""",
    "p7_groups": f"""with recursive {_P7[5:]}, s as (select a.row_id as x, b.row_id as y
        from o a join o b on a.f = b.f and a.word = b.word and a.k = b.k and a.row_id < b.row_id group by a.row_id, b.row_id, a.f having count(*) >= 0.75 * max(greatest(a.n, b.n))),
      e as (select x as a, y as b from s union select y, x from s), r(row_id, grp) as (select a, a from e union select e.b, r.grp from r join e on e.a = r.row_id)
      select row_id, min(grp) as group_row_id from r group by 1""",
    "p4_found": f"{_P4} select row_id, group_row_id from m where group_row_id in (select group_row_id from m group by 1 having count(*) > 1)",
    "p6_found": f"{_P6} select g.group_row_id, b.field_name, b.row_id as best_row_id from b join g using (k) where rn = 1",
    "p6_records": f"{_P6} select g.group_row_id, g.n_rows, {', '.join(f'max(case when field_name = {chr(39)}{f}{chr(39)} then v end) as {f}' for f in survivor.FIELDS)} from g left join b on b.k = g.k and rn = 1 group by g.k, g.group_row_id, g.n_rows",
}
