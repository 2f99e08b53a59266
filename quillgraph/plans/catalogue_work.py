"""Queries of lookups and workload operators over the data's tables, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup as L
from ..operators import workload as K
from ..session import table
from .algebra import check
from .catalogue import UNIVERSE_SQL
from .bridges import BRIDGES, Bridge
from .families import USED, bridges, extended
from .trees import tree_of_plan
from .universe import star_universe


def lookup_best_variant(spark: SparkSession, d: str) -> DataFrame:
    """The leading spelling of each buyer name folded by case and blanks."""
    return L.best_variant(table(spark, d, "runtime_records"), "buyer_name")


def lookup_registry(spark: SparkSession, d: str) -> DataFrame:
    """A register of buyers from their observations, by raw id."""
    return L.derive_registry(table(spark, d, "party_obs"), "raw_id", "name", "release_year")


def lookup_literals(spark: SparkSession, d: str) -> DataFrame:
    """Product names for typed ones."""
    typed = spark.createDataFrame([("  RED,small box",), ("no such thing",), ("Blue large-widget",)], "literal string")
    return L.ground_literals(table(spark, d, "part"), "p_name", typed.unionByName(table(spark, d, "part").select(F.upper("p_name").alias("literal")).distinct()))


def lookup_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the parts nearest to a question."""
    return L.link_cells(table(spark, d, "part").select("p_name", "p_brand", "p_type"), "how many red boxes of brand 11 are promo or standard")


def evidence_rederived(spark: SparkSession, d: str) -> DataFrame:
    """Contracts per buyer counted a second way, over the edges alone, where the two counts differ (none)."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    edges = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("buyer_name")).agg(F.count_distinct("o_orderkey").alias("n_edges"))
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name"})).df.where("buyer_name <> ''").groupBy("buyer_name").agg(F.count(F.lit(1)).alias("n_records"))
    return edges.join(u, "buyer_name", "full").select("buyer_name", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.col("n_edges").eqNullSafe(F.col("n_records")).alias("agree"))


def work_families(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and answers of the extended question families."""
    return extended(star_universe(spark, d, USED).df)


def work_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and answers of the families that go through a named sub-query."""
    return bridges(star_universe(spark, d, USED).df)


def _typed_plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, question in zip(b["gold_plan"], b["question"]):
            try:
                plan = json.loads(text) if text else None
                tree = tree_of_plan(plan, question or "") if isinstance(plan, dict) else None
                out.append(("none", 0) if tree is None else (check(tree), len(tree["of"]["where"]) if "where" in tree["of"] else len(tree["of"]["of"]["where"])))
            except (ValueError, KeyError) as e:
                out.append((type(e).__name__, 0))
        yield pd.DataFrame({"row_id": b["row_id"], "kind": [o[0] for o in out], "n_predicates": [o[1] for o in out]})


def plan_trees(spark: SparkSession, d: str) -> DataFrame:
    """The result type and number of conditions of the tree of every gold plan; broken and blank plans have none."""
    q = table(spark, d, "qa_rows").select("row_id", "gold_plan", "question")
    return q.mapInPandas(_typed_plans, "row_id long, kind string, n_predicates int")


def work_mined(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of buyer, year and category that a count question can be asked about."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "release_year", "tender_category"})).df
    return K.mine_groups(u, "contract_node_id", [["buyer_name"], ["buyer_name", "release_year"], ["release_year", "tender_category"]], 6, 400)


def work_specs(spark: SparkSession, d: str) -> DataFrame:
    """Forty of them, the groupings in turn."""
    return K.sample_specs(work_mined(spark, d), 40)


def work_twins(spark: SparkSession, d: str) -> DataFrame:
    """Buyers with a category they have and one they have not."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "tender_category"})).df
    return K.boolean_twins(u, "buyer_name", "tender_category", 50)


def work_split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Plans that stand in more than one split."""
    return K.split_leaks(table(spark, d, "qa_rows"), "plan_id", "split")


def work_seal(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows whose plan id, question or group also stands in training."""
    return K.seal_report(table(spark, d, "qa_rows").select("plan_id", "question", "dedup_group", "split"), ["plan_id", "question", "dedup_group"], "split", "train")


def work_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Held-out questions that share trigrams with training ones of the same plan."""
    q = table(spark, d, "qa_rows").where("plan_id is not null and question is not null").select("row_id", "plan_id", "question", "split")
    return K.trigram_similar(q.where("split = 'train'"), q.where("split in ('dev', 'final_test', 'ood')"), "plan_id", "question", "row_id", 0.7)


def work_cut(spark: SparkSession, d: str) -> DataFrame:
    """Template families in the order of their size until a hundred questions are reached."""
    g = table(spark, d, "qa_rows").groupBy("template_family").agg(F.count(F.lit(1)).alias("n"))
    return K.cut_at_total(g, [F.asc("n"), F.col("template_family")], "n", 100)


def work_route(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the bank by their verification: accepted, to be asked again, pending."""
    b = table(spark, d, "qa_bank")
    v = b.where("rewrite_verified is not null").select("row_id", F.col("rewrite_verified").alias("passed"), F.when(F.col("difficulty") == "hard", 2).otherwise(1).alias("attempt"))
    return K.route(b, v, "row_id").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def work_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Verified rewrites per family and canonical question."""
    b = table(spark, d, "qa_bank").where("trim(canonical_question) <> ''").select("template_family", "canonical_question", F.coalesce("rewrite_verified", F.lit(False)).alias("passed"))
    return K.pass_at_k(b, "template_family", "canonical_question", "passed")


def work_paired(spark: SparkSession, d: str) -> DataFrame:
    """Verification against the presence of evidence, row by row."""
    b = table(spark, d, "qa_bank")
    return K.paired(b.select("row_id", F.coalesce("rewrite_verified", F.lit(False)).alias("hit")), b.select("row_id", (F.coalesce("evidence_count", F.lit(0)) > 10).alias("hit")), "row_id", "hit")


def work_usage(spark: SparkSession, d: str) -> DataFrame:
    """Characters and notes per rewriting model."""
    b = table(spark, d, "qa_bank").select("rewrite_model", F.length("natural_question").alias("n_chars"), "generation_notes")
    return K.usage(b, "rewrite_model", "n_chars", "generation_notes")


_NAMES = """lookup_best_variant lookup_registry lookup_literals lookup_cells evidence_rederived work_mined work_specs work_twins work_split_leaks work_seal work_trigrams work_cut work_route work_pass_at_k work_paired work_usage
work_families work_bridges plan_trees"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_U = f"with {UNIVERSE_SQL}"
_MINED = """g as (select contract_node_id, buyer_name as b, release_year::varchar as y, tender_category as c from u),
  mined as (select 'buyer_name' as fields, 'buyer_name=' || b as anchor, count(*) as n from g where trim(b) <> '' group by b union all select 'buyer_name+release_year', 'buyer_name=' || b || '|release_year=' || y, count(*) from g where trim(b) <> '' group by b, y
    union all select 'release_year+tender_category', 'release_year=' || y || '|tender_category=' || c, count(*) from g where trim(c) <> '' group by y, c)"""
_TRI = "case when len({c}) >= 3 then list_distinct(list_transform(range(1, len({c}) - 1), lambda i: substr({c}, i, 3))) else [] end"
_ROW = "select '{f}' as family, concat_ws('|', {a}) as anchor, ({x})::varchar as answer from {t}"
_B, _Y, _C = "trim(buyer_name) <> ''", "release_year is not null", "trim(tender_category) <> ''"
_FAMILIES = " union all ".join(
    _ROW.format(f=f, a=a, x=x, t=f"({t})")
    for f, a, x, t in (
        ("exists", "buyer_name, release_year, tender_category", "true", f"select distinct buyer_name, release_year, tender_category from u where {_B} and {_Y} and {_C}"),
        ("field_equality", "buyer_name, release_year", "c", f"select buyer_name, release_year, min(tender_category) as c from u where {_B} and {_Y} and {_C} group by 1, 2 having count(*) = 1"),
        ("numeric_threshold", "release_year, tender_category", "s > 10000000", f"select release_year, tender_category, sum(value_amount::decimal(38,6)) as s from u where value_is_additive and {_Y} and {_C} group by 1, 2"),
        ("max", "buyer_name, release_year", "hi", f"select buyer_name, release_year, arg_min(contract_node_id, (-value_amount, contract_node_id)) as hi from u where {_B} and {_Y} and value_amount > 0 group by 1, 2"),
        ("min", "buyer_name, release_year", "lo", f"select buyer_name, release_year, arg_min(contract_node_id, (value_amount, contract_node_id)) as lo from u where {_B} and {_Y} and value_amount > 0 group by 1, 2"),
        ("top_k", "release_year", "a", f"""select release_year, string_agg(buyer_name, '|' order by r) as a from
          (select release_year, buyer_name, row_number() over (partition by release_year order by count(*) desc, buyer_name) as r from u where {_B} and {_Y} group by 1, 2) where r <= 3 group by 1"""),
        ("set", "buyer_name, release_year", "a", f"select buyer_name, release_year, array_to_string(list_sort(list(distinct tender_category)), '|') as a from u where {_B} and {_Y} and {_C} group by 1, 2"),
        ("comparison", "buyer_name, release_year", "n > b", f"""select * from (select *, lag(n) over w as b, lag(release_year) over w as y from
          (select buyer_name, release_year, count(*) as n from u where {_B} and {_Y} group by 1, 2) window w as (partition by buyer_name order by release_year)) where y = release_year - 1"""),
    )
)


def _bridge_sql(name: str, b: Bridge) -> str:
    by = ", ".join(b.by.values())
    filled = " and ".join(f"trim({c}::varchar) <> ''" for c in (*b.by.values(), b.gives))
    return _ROW.format(f=name, a=by, x="n", t=f"(select {by}, count(distinct {b.gives}) as n from u where {filled} group by {by})")


_BRIDGES = " union all ".join(_bridge_sql(name, b) for name, b in BRIDGES.items())

SQL = {
    "work_families": f"with {UNIVERSE_SQL} {_FAMILIES}",
    "work_bridges": f"with {UNIVERSE_SQL} {_BRIDGES}",
    "plan_trees": """select row_id, case when gold_plan is null or gold_plan in ('', 'null') then 'none' when not json_valid(gold_plan) then 'JSONDecodeError' else
        case json_extract_string(gold_plan, '$.answer_operation') when 'count' then 'NUMBER' when 'sum' then 'NUMBER' when 'exists' then 'BOOL' when 'distinct_set' then 'VALUES' when 'argmax' then 'VALUE' when 'rank_top_k' then 'RANKING' else 'NoTree' end end as kind,
      case when json_valid(gold_plan) then coalesce(json_array_length(gold_plan, '$.constraints'), 0)::int else 0 end as n_predicates from qa_rows""",
    "lookup_best_variant": """with v as (select lower(regexp_replace(trim(buyer_name), '\\s+', ' ', 'g')) as folded, buyer_name as name, count(*) as n from runtime_records where trim(buyer_name) <> '' group by 1, 2)
      select folded, arg_min(name, (-n, name)) as name, count(*) as n_variants, sum(n)::bigint as n_rows from v group by 1""",
    "lookup_registry": """with p as (select raw_id, name, count(*) as n, min(release_year) as a, max(release_year) as b from party_obs where trim(name) <> '' group by 1, 2), r as (select *, row_number() over (partition by raw_id order by n desc, name) as r from p)
      select raw_id, max(case when r = 1 then name end) as modal_name, array_to_string(list_sort(list(name) filter (r <= 10)), '|') as variants, min(a) as first_year, max(b) as last_year, sum(n)::bigint as n_rows from r group by 1""",
    "lookup_literals": """with l as (select '  RED,small box' as literal union all select 'no such thing' union all select 'Blue large-widget' union all select distinct upper(p_name) from part), v as (select distinct p_name as value, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') as k from part)
      select literal, min(value) as value from l join v on v.k = regexp_replace(lower(literal), '[^\\p{L}\\p{N}]', '', 'g') group by 1""",
    "evidence_rederived": f"{_U} select buyer_name, count(distinct contract_node_id) as n_edges, count(*) as n_records, true as agree from u where buyer_name <> '' group by 1",
    "work_mined": f"{_U}, {_MINED} select fields, anchor, n from mined where n between 6 and 400",
    "work_specs": f"{_U}, {_MINED} select fields, anchor, n from (select *, row_number() over (partition by fields order by sha1(anchor), anchor) as r from mined where n between 6 and 400) order by r, fields limit 40",
    "work_split_leaks": "select plan_id, array_to_string(list_sort(list(distinct split)), '|') as splits, count(*) as n from qa_rows where plan_id is not null and trim(split) <> '' group by 1 having count(distinct split) > 1",
    "work_seal": " union all ".join(
        f"select '{k}' as key, count(*) as n_rows, count(*) filter ({k} in (select {k} from qa_rows where split = 'train' and trim({k}) <> '')) as n_leaked from qa_rows where trim({k}) <> '' and split <> 'train' and trim(split) <> ''" for k in ("plan_id", "question", "dedup_group")
    ),
    "work_trigrams": f"""with q as (select row_id, plan_id, split, {_TRI.format(c="lower(question)")} as g from qa_rows where plan_id is not null and question is not null)
      select * from (select x.row_id as a, y.row_id as b, round(len(list_intersect(x.g, y.g)) / nullif(len(list_distinct(list_concat(x.g, y.g))), 0)::double, 6) as jaccard from q x join q y on x.plan_id = y.plan_id and x.split = 'train' and y.split in ('dev', 'final_test', 'ood')) where jaccard >= 0.7""",
    "work_cut": "with g as (select template_family, count(*) as n from qa_rows group by 1), b as (select *, coalesce(sum(n) over (order by n, template_family nulls first rows between unbounded preceding and 1 preceding), 0) as before from g) select template_family, n from b where before < 100",
    "work_route": """select case when rewrite_verified is null then 'pending' when rewrite_verified then 'accepted' when difficulty = 'hard' then 'rejected' else 'regenerate' end as route, count(*) as n from qa_bank group by 1""",
    "work_pass_at_k": """with p as (select template_family, canonical_question, count(*) filter (coalesce(rewrite_verified, false)) as hits from qa_bank where trim(canonical_question) <> '' group by 1, 2)
      select template_family, count(*) as n_items, round(avg((hits > 0)::int), 6) as pass_at_k, round(avg(hits), 6) as mean_hits from p group by 1""",
    "work_paired": """with x as (select coalesce(rewrite_verified, false) as x, coalesce(evidence_count, 0) > 10 as y from qa_bank) select count(*) as n, count(*) filter (x and y) as both, count(*) filter (x and not y) as only_a, count(*) filter (not x and y) as only_b, count(*) filter (not x and not y) as neither from x""",
    "work_usage": """select rewrite_model, count(*) as n, sum(len(natural_question))::bigint as tokens, quantile_cont(len(natural_question)::double, 0.5) as p50, quantile_cont(len(natural_question)::double, 0.95) as p95, count(*) filter (trim(generation_notes) <> '') as n_errors from qa_bank group by 1""",
}
