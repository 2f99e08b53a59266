"""Queries of the other operators (graph tables, resolution, documents, quality, samplers, functions) over the data's tables, each with its SQL
where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import strings as S
from ..operators import documents as D
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import resolution as E
from ..session import table
from .catalogue import UNIVERSE_SQL
from .universe import line_summary, star_universe

# --- graph tables -----------------------------------------------------------------------------------------------------------------------


def party_summary(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each contract: sorted names, the first of them, and their number."""
    s = line_summary(spark, d, parts=False, regions=False)
    return s.select("order_key", F.array_join("supplier_names", "|").alias("names"), F.coalesce(F.get("supplier_names", F.lit(0)), F.lit("")).alias("first_name"), "supplier_count")


def org_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Contracts, additive value and years of each buyer."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "release_year", "value_amount", "value_is_additive"})).df
    return u.groupBy("buyer_name").agg(
        F.count(F.lit(1)).alias("n_contracts"), F.coalesce(F.sum(F.when(F.col("value_is_additive"), F.col("value_amount")).cast("decimal(38,6)")).cast("double"), F.lit(0.0)).alias("additive_sum"),
        F.min("release_year").alias("first_year"), F.max("release_year").alias("last_year"),
    )


def cpv_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Contracts and additive value of each product code, with its prefix codes."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "tender_cpv_id", "value_amount", "value_is_additive"})).df.where("tender_cpv_id <> ''")
    g = u.groupBy("tender_cpv_id").agg(F.count(F.lit(1)).alias("n_contracts"), F.coalesce(F.sum(F.when(F.col("value_is_additive"), F.col("value_amount")).cast("decimal(38,6)")).cast("double"), F.lit(0.0)).alias("additive_sum"))
    return g.withColumns({"prefix2": S.prefix_code(F.col("tender_cpv_id"), 2), "prefix9": S.prefix_code(F.col("tender_cpv_id"), 9)})


def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    """Keys, references, additive values and coverage of the star schema."""
    o, line, c, p, s = (table(spark, d, t) for t in ("orders", "lineitem", "customer", "part", "supplier"))
    u = star_universe(spark, d, frozenset({"contract_node_id", "value_is_additive", "value_source", "supplier_count"})).df
    return Q.run_checks(
        [
            Q.Check("orders", "key is unique", o, unique=("o_orderkey",)), Q.Check("lineitem", "key is unique", line, unique=("l_orderkey", "l_linenumber")),
            Q.Check("orders", "buyer exists", o, refers=("o_custkey", c, "c_custkey")), Q.Check("lineitem", "order exists", line, refers=("l_orderkey", o, "o_orderkey")),
            Q.Check("lineitem", "part exists", line, refers=("l_partkey", p, "p_partkey")), Q.Check("lineitem", "supplier exists", line, refers=("l_suppkey", s, "s_suppkey")),
            Q.Check("universe", "tender values are not additive", u, broken=F.col("value_is_additive") & (F.col("value_source") == "tender")),
            Q.Check("universe", "has a supplier", u, broken=F.col("supplier_count") == 0, allowed=0.001, warns=True),
        ]
    )


def latest_release(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user (ties: the larger event id), by aggregation."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return R.latest_per_key(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each contract key, keys differing in case, blanks and separators being one."""
    from ..functions.text import loose_key

    r = table(spark, d, "runtime_records").select(loose_key(F.col("contract_node_id")).alias("k"), "row_id", "loaded_at").where("k is not null")
    return R.latest_per_key(r, ["k"], [F.col("loaded_at"), -F.col("row_id")]).select("k", "row_id")


def value_fallback(spark: SparkSession, d: str) -> DataFrame:
    """An order's value: its own if released, else the sum of its lines, else an estimate, and which of them."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("line_sum"))
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    j = o.join(lines, "o_orderkey", "left")
    return j.select(
        "o_orderkey", F.round(F.coalesce(own, "line_sum", "o_totalprice"), 2).alias("best_value"), F.when(own.isNotNull(), "award").when(F.col("line_sum").isNotNull(), "contract").otherwise("tender").alias("value_source")
    )


def lot_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents to the records of their process and lot, or to all of the process where no record has the lot."""
    docs = table(spark, d, "documents").where("lot_id <> ''").select("doc_id", "ocid", F.regexp_replace("lot_id", "lot-", "a").alias("award"))
    rec = table(spark, d, "runtime_records").select("ocid", F.regexp_extract("contract_node_id", r":(a\d+)$", 1).alias("award"), F.col("row_id").alias("record_row")).where("award <> ''")
    return R.scoped_join(docs, rec, ["ocid", "award"], ["ocid"]).select("doc_id", "record_row", "match_scope")


def group_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Edges per organisation in both edge tables, a missing side being 0."""
    n = lambda t: table(spark, d, t).where("canonical_id is not null").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))
    return R.aligned(n("buyer_of"), n("supplier_of"), "canonical_id", "n")


def set_check(spark: SparkSession, d: str) -> DataFrame:
    """Notices of the records missing in the buyer edges, and the other way round."""
    return R.set_difference_report(table(spark, d, "runtime_records"), table(spark, d, "buyer_of"), "ocid")


# --- functions --------------------------------------------------------------------------------------------------------------------------


def norm_name(spark: SparkSession, d: str) -> DataFrame:
    """Normalised register names."""
    return table(spark, d, "canonical_orgs").select("org_no", S.norm_name(F.col("canonical_name")).alias("norm"))


def id_parts(spark: SparkSession, d: str) -> DataFrame:
    """Registry, value, trust and canonical id of raw identifiers."""
    c = F.col("raw_id")
    return table(spark, d, "party_obs").select("obs_id", S.scheme_of(c).alias("scheme"), S.value_of(c).alias("value"), S.is_official(S.scheme_of(c)).alias("official"), S.priority(S.scheme_of(c)).alias("priority"), S.canonical_id(c).alias("canonical"))


def region_relations(spark: SparkSession, d: str) -> DataFrame:
    """How the regions of candidate pairs relate."""
    return table(spark, d, "er_pairs").select("entity_a_id", "entity_b_id", S.region_relation(F.col("address_region_a"), F.col("address_region_b")).alias("relation"))


def name_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Token Jaccard of the names of candidate pairs."""
    t = lambda c: S.tokens(F.coalesce(F.col(c), F.lit("")))
    return table(spark, d, "er_pairs").select("entity_a_id", "entity_b_id", F.round(S.jaccard(t("norm_name_a"), t("norm_name_b")), 6).alias("jaccard"))


def name_acronym(spark: SparkSession, d: str) -> DataFrame:
    """Acronyms of register names."""
    return table(spark, d, "canonical_orgs").select("org_no", S.acronym(F.coalesce("norm_name", F.lit(""))).alias("acronym"))


def name_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler similarity of the names of candidate pairs."""
    p = table(spark, d, "er_pairs").where("norm_name_a is not null and norm_name_b is not null")
    return p.select("entity_a_id", "entity_b_id", F.round(S.jaro_winkler("norm_name_a", "norm_name_b"), 6).alias("similarity"))


def name_sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Longest-block similarity and n-gram cosine of the names of candidate pairs."""
    p = table(spark, d, "er_pairs")
    return p.select("entity_a_id", "entity_b_id", F.round(S.sequence_ratio("norm_name_a", "norm_name_b"), 6).alias("ratio"), F.round(S.ngram_cosine("norm_name_a", "norm_name_b"), 6).alias("cosine"))


def award_days(spark: SparkSession, d: str) -> DataFrame:
    """Signing dates in any layout as days."""
    return table(spark, d, "runtime_records").select("row_id", dates.parsed_day(F.col("award_date_signed")).cast("string").alias("day"))


def award_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Typed amounts as numbers."""
    return table(spark, d, "runtime_records").select("row_id", dates.amount(F.col("value_amount")).alias("amount"))


def question_years(spark: SparkSession, d: str) -> DataFrame:
    """Years that questions name."""
    return table(spark, d, "qa_rows").select("row_id", F.array_join(dates.years_in(F.col("question")).cast("array<string>"), "|").alias("years"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Hash ids of documents."""
    return table(spark, d, "documents").select("doc_id", S.stable_hash(16, F.col("ocid"), F.col("field_path"), F.col("lot_id")).alias("hash_id"))


def json_drill(spark: SparkSession, d: str) -> DataFrame:
    """A member of the events' JSON properties, summed per type."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct regions of the organisations' own region and JSON list."""
    return table(spark, d, "org_nodes").select("row_id", F.array_join(S.region_set(F.col("address_region"), F.col("address_regions")), "|").alias("regions"))


# --- resolution -------------------------------------------------------------------------------------------------------------------------


def _register(spark: SparkSession, d: str) -> DataFrame:
    return E.entity_columns(table(spark, d, "canonical_orgs"), "org_no", "canonical_name")


def er_name_region_merge(spark: SparkSession, d: str) -> DataFrame:
    """Register rows of one name and region under one id."""
    return E.name_region_merge(table(spark, d, "canonical_orgs"), key="org_no").withColumn("org_no", F.col("canonical_id").cast("long")).drop("canonical_id")


def er_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Register rows whose names begin alike and are similar."""
    return E.similar_pairs(table(spark, d, "canonical_orgs"), "org_no", "canonical_name", 0.92)


def er_multi_block(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of five blocking strategies with the strategies that found each."""
    e = E.rare_tokens(_register(spark, d), "org_no")
    return E.block_pairs(e, "org_no", E.standard_blocks()).select("a", "b", F.array_join("strategies", "|").alias("strategies"))


def er_block_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, large blocks and the largest block of each strategy."""
    return E.block_metrics(E.rare_tokens(_register(spark, d), "org_no"), "org_no", E.standard_blocks())


def er_features(spark: SparkSession, d: str) -> DataFrame:
    """Features, score, flags and tier of the candidate pairs."""
    e = E.rare_tokens(_register(spark, d), "org_no")
    return E.pair_features(E.block_pairs(e, "org_no", E.standard_blocks()), e, "org_no").withColumn("strategies", F.array_join("strategies", "|")).withColumn("risk_flags", F.array_join("risk_flags", "|"))


def er_strategy_share(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each strategy and those that no other found."""
    p = table(spark, d, "er_pairs").select(S.string_list(F.col("strategies")).alias("s"))
    x = p.select(F.explode(F.array_distinct("s")).alias("strategy"), (F.size(F.array_distinct("s")) == 1).alias("alone"))
    return x.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("alone").alias("n_alone"))


def er_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the candidate pairs that share region and a product code."""
    return E.clusters(table(spark, d, "er_pairs").where("shared_region and shared_cpv2 > 0"), "entity_a_id", "entity_b_id")


def er_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each register row of a component of equal name and region to its representative: the best status, then the most aliases."""
    orgs = table(spark, d, "canonical_orgs")
    m = E.name_region_merge(orgs, key="org_no").where("n > 1").select(F.col("canonical_id").cast("long").alias("org_no"), "merged_id")
    low = m.groupBy("merged_id").agg(F.min("org_no").alias("low"))
    members = E.clusters(m.join(low, "merged_id"), "org_no", "low")
    rank = F.when(F.col("er_status") == "deterministic", 0).when(F.col("er_status") == "gov_lookup", 1).otherwise(2)
    return E.apply_merges(orgs, members, "org_no", [rank, -F.col("n_aliases")])


def er_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Components of pairs that hold two ids of one official registry, or a pair with conflicting registries."""
    ids = table(spark, d, "canonical_orgs").where(S.is_official(F.col("official_scheme"))).select(F.col("org_no").alias("node"), F.col("official_scheme").alias("scheme"), F.col("official_id").alias("value"))
    rejected = table(spark, d, "er_pairs").where("official_scheme_conflict").select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"))
    return E.merge_conflicts(er_components(spark, d), ids, rejected)


def er_registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Observed parties by name in the health and then the education register."""
    r = table(spark, d, "canonical_orgs")
    part = lambda c: r.where(F.col("org_category") == c).select(S.norm_name(F.col("canonical_name")).alias("norm"), F.col("canonical_id").alias("registry_id"))
    return E.registry_lookup(table(spark, d, "party_obs"), "name", [("health", part("health")), ("education", part("education"))], "obs_id")


def er_role_alias(spark: SparkSession, d: str) -> DataFrame:
    """Parties without identifier by the one identified party of the same year, name and role."""
    p = table(spark, d, "party_obs")
    own = F.when((F.trim("identifier_scheme") != "") & (F.trim("identifier_id") != ""), F.concat_ws("-", "identifier_scheme", "identifier_id"))
    rows = p.select(F.col("release_year").cast("string").alias("ocid"), F.col("obs_id").cast("string").alias("raw_id"), S.norm_name(F.col("name")).alias("norm"), own.alias("canonical_id"), S.string_list(F.col("roles_json")).alias("roles"))
    return E.role_alias(rows.where("norm <> ''"))


def er_org_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Modal name, role type and regions of observations of one normalised name."""
    obs = table(spark, d, "party_obs").where("trim(norm_name) <> ''")
    return E.org_metadata(obs, "norm_name").select("norm_name", "canonical_name", "org_type", F.array_join("regions", "|").alias("regions"), "n_aliases")


# --- documents --------------------------------------------------------------------------------------------------------------------------

TERMS = ["termination", "notice", "insurance", "contract", "payment"]


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents."""
    return D.chunks(table(spark, d, "documents"))


def doc_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and words per heading word."""
    c = doc_chunks(spark, d).select(F.lower(F.regexp_extract("heading", r"([A-Za-z]+)[^A-Za-z]*$", 1)).alias("heading"), "n_words")
    return c.groupBy("heading").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_words").alias("n_words"))


def doc_topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that share most with a set of terms."""
    return D.rank_chunks(doc_chunks(spark, d), TERMS, 8).select("chunk_id", "doc_id", "score")


def doc_rank_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents ranked as chunks without heading."""
    t = table(spark, d, "documents").select("doc_id", F.lit("").alias("heading"), "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"))
    return D.rank_chunks(t, TERMS, 8).select("doc_id", "score")


def doc_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """The five documents nearest to each of three questions by TF-IDF cosine."""
    q = spark.createDataFrame([(1, "insurance for each claim"), (2, "payment within days of a valid invoice"), (3, "street lighting award")], "query_id int, query string")
    return D.tf_idf_top(table(spark, d, "documents"), q, 5)


def doc_token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Shared word trigrams of natural and canonical question."""
    q = table(spark, d, "qa_bank")
    text = lambda c: S.shingles(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^A-Za-z0-9 ]", ""), 3)
    return q.select("row_id", F.round(S.jaccard(text("natural_question"), text("question")), 6).alias("jaccard"))


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Product names nearest to a phrase."""
    return D.lexical_top(table(spark, d, "part"), "p_name", "small red", 10)


def url_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each document URL."""
    return D.url_manifest(table(spark, d, "documents"))


def url_group_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents, share with a date and mean length by source, type and both, in one pass."""
    t = table(spark, d, "documents").select("doc_id", "source", "document_type", F.col("date_published").isNotNull().cast("int").alias("dated"), "n_chars")
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dated"), 6).alias("dated_share"), F.round(F.avg("n_chars"), 4).alias("mean_chars")]
    return R.groupings(t, [["source"], ["document_type"], ["source", "document_type"]], aggs)


# --- quality and samplers ---------------------------------------------------------------------------------------------------------------


def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and blanks of every column of the organisations."""
    return Q.profile(table(spark, d, "org_nodes").select("canonical_id", "canonical_name", "org_type", "address_region", "first_activity_year", "deleted_at")).drop("example")


def sum_outlier_fence(spark: SparkSession, d: str) -> DataFrame:
    """Organisations whose mean contract value lies beyond the fence."""
    o = table(spark, d, "org_nodes").groupBy("official_scheme", "official_id").agg(F.max("supplier_additive_value_sum").alias("total"), F.max("supplier_contract_count").alias("n"))
    f = Q.outlier_fence(o.withColumn("k", F.concat_ws("-", "official_scheme", "official_id")), "k", "total", "n")
    return f.select("key", "side", F.round("log_mean", 6).alias("log_mean"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def fd_probe(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose plan determines the answer type."""
    return Q.determines(table(spark, d, "qa_rows").where("plan_id is not null").select("row_id", "plan_id", "answer_type"), ["plan_id"], "answer_type").select("row_id")


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sixty questions taken from the template families in turn."""
    q = table(spark, d, "qa_rows").select("row_id", "id", "template_family")
    return R.round_robin(q, "template_family", [R.hash_order("id"), F.col("row_id")], 60).select("row_id", "template_family")


def strat_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each stratum of questions, by hash."""
    q = table(spark, d, "qa_rows").select("row_id", "id", "difficulty", "answer_operation")
    return R.stratified(q, ["difficulty", "answer_operation"], 0.1, F.concat(R.hash_order("id"), F.col("row_id").cast("string"))).select("row_id")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """One in fifty documents, by hash of the id."""
    return R.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 20)


def head_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three latest questions of each family."""
    return R.head_per_group(table(spark, d, "qa_rows").select("row_id", "template_family", "created_at"), "template_family", [F.desc("created_at"), F.col("row_id")], 3).select("row_id", "template_family")


def bucketed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records per buyer, all but the 25 most frequent together."""
    r = table(spark, d, "runtime_records").where("buyer_name is not null")
    return r.groupBy(R.bucketed(r, "buyer_name", 25).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ambiguous_miner(spark: SparkSession, d: str) -> DataFrame:
    """Buyers and years whose contracts have three or more different first suppliers."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "release_year", "supplier_name"})).df.where("supplier_name <> ''")
    return u.groupBy("buyer_name", "release_year").agg(F.count_distinct("supplier_name").alias("n_answers")).where("n_answers >= 3")


def no_result_miner(spark: SparkSession, d: str) -> DataFrame:
    """For the buyers of five or more years, the years of the data in which they have no contract."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "release_year"})).df.select("buyer_name", "release_year").distinct()
    years = u.agg(F.array_sort(F.collect_set("release_year")).alias("all"), F.lit(1).alias("one"))  # a handful of years, one row
    g = u.groupBy("buyer_name").agg(F.collect_set("release_year").alias("own"), F.count(F.lit(1)).alias("n")).where("n >= 5").withColumn("one", F.lit(1))
    return g.join(F.broadcast(years), "one").select("buyer_name", F.explode(F.array_except("all", "own")).alias("release_year"))


def anchor_miner(spark: SparkSession, d: str) -> DataFrame:
    """Buyers with contracts in three or more years and the size that a count question needs."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "release_year"})).df
    return u.groupBy("buyer_name").agg(F.count_distinct("release_year").alias("n_years"), F.count(F.lit(1)).alias("n")).where("n_years >= 3 and n between 5 and 60")


def unique_top(spark: SparkSession, d: str) -> DataFrame:
    """Years whose leading buyer by contracts is not tied, with that buyer."""
    u = star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "release_year"})).df
    g = u.groupBy("release_year", "buyer_name").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("release_year").agg(F.max("n").alias("n"))
    top = g.join(best, ["release_year", "n"])
    return top.groupBy("release_year", "n").agg(F.count(F.lit(1)).alias("k"), F.min("buyer_name").alias("buyer_name")).where("k = 1").select("release_year", "buyer_name", "n")


def constraint_signature(spark: SparkSession, d: str) -> DataFrame:
    """Questions per signature of their constraints: the hash of the sorted field, operator and value triples."""
    kind = "constraints array<struct<field: string, op: string, value: string>>"
    q = table(spark, d, "qa_rows").select("row_id", F.from_json("gold_plan", kind)["constraints"].alias("c")).where("c is not null")
    sig = F.sha1(F.to_json(F.array_sort(F.transform("c", lambda x: F.concat_ws("|", x["field"], x["op"], x["value"])))))
    g = q.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    return g.where("n > 1").select("first_row", "n")


def value_shares(spark: SparkSession, d: str) -> DataFrame:
    """Values of the answer operation with their shares."""
    v = Q.value_counts(table(spark, d, "qa_rows"), "answer_operation")
    return v.select("value", "n", F.round("share", 6).alias("share"))


def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Questions per family in each of four splits."""
    q = table(spark, d, "qa_rows").where("split is not null")
    return q.groupBy("template_family").pivot("split", ["train", "dev", "final_test", "ood"]).agg(F.count(F.lit(1))).fillna(0)


def division_keys(spark: SparkSession, d: str) -> DataFrame:
    """Buyers all of whose contracts are additive, by one aggregation."""
    return R.divide(star_universe(spark, d, frozenset({"contract_node_id", "buyer_name", "value_is_additive"})).df, "buyer_name", F.col("value_is_additive"))


_NAMES = """party_summary org_enrichment cpv_enrichment integrity_checks latest_release latest_record value_fallback lot_fallback_join group_alignment set_check norm_name id_parts region_relations
name_jaccard name_acronym name_jaro_winkler name_sequence_ratio award_days award_amounts question_years stable_ids json_drill json_lists er_name_region_merge er_block_pairs er_multi_block er_block_metrics
er_features er_strategy_share er_components er_merge_plan er_conflicts er_registry_lookup er_role_alias er_org_metadata doc_chunks doc_chunk_stats doc_topk_overlap doc_rank_whole doc_tf_idf doc_token_jaccard
label_lookup url_manifest url_group_summary profile_nulls sum_outlier_fence fd_probe round_robin_sample strat_sample hash_sample head_per_group bucketed_counts ambiguous_miner no_result_miner anchor_miner
unique_top constraint_signature value_shares pivot_counts division_keys"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_U = f"with {UNIVERSE_SQL}"
_ADD = "coalesce(sum(case when value_is_additive then value_amount end::decimal(38,6))::double, 0)"
_LEGAL = "|".join(S.LEGAL_FORMS)
_STOP = ", ".join(f"'{w}'" for w in S.STOP_TOKENS)


def _norm(c: str) -> str:
    s = f"upper(trim(regexp_replace(strip_accents(replace({c}, chr(160), ' ')), '[^\\x00-\\x7f]', '', 'g')))"
    s = f"regexp_replace(regexp_replace({s}, '\\s*&\\s*', ' AND ', 'g'), '[^\\w\\s]', ' ', 'g')"
    return f"coalesce(trim(regexp_replace(trim(regexp_replace({s}, '\\b({_LEGAL})\\b\\.?$', '')), '\\s+', ' ', 'g')), '')"


def _toks(c: str, least: int = 3) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(trim({c}), '\\s+')), lambda w: len(w) >= {least} and w not in ({_STOP}))"


_ACRONYM = f"array_to_string(list_transform(list_filter(regexp_split_to_array(trim(coalesce(norm_name, '')), '\\s+'), lambda w: w <> '' and w not in ({_STOP})), lambda w: w[1]), '')"
_SCHEME = "case when len(string_split(raw_id, '-')) >= 3 then string_split(raw_id, '-')[1] || '-' || string_split(raw_id, '-')[2] else '' end"
_VALUE = "case when len(string_split(raw_id, '-')) >= 3 then array_to_string(string_split(raw_id, '-')[3:], '-') else '' end"
_OFFICIAL = ", ".join(f"'{s}'" for s in S.OFFICIAL)
_JL = "coalesce(from_json(case when json_valid({c}) and json_type({c}) = 'ARRAY' then {c} end, '[\"VARCHAR\"]'), [])"
_NORM_REG = f"reg as (select org_no, {_norm('canonical_name')} as norm, address_region as region, official_scheme, official_id, er_status, n_aliases, org_category, canonical_id from canonical_orgs)"


_BLOCKS = f"""{_NORM_REG}, e as (select *, {_toks("norm")} as toks, {_ACRONYM.replace("coalesce(norm_name, '')", "norm")} as acr, coalesce(region, '') as rg from reg),
  tok as (select org_no, unnest(list_filter(toks, lambda w: len(w) >= 4)) as w from e), rare as (select org_no, w from tok where w in (select w from tok group by 1 having count(*) between 2 and 10)),
  blocks as (select 'exact_norm_name' as strategy, norm as block, org_no, 80 as largest from e where norm <> '' union all select 'name_region', norm || '|' || rg, org_no, 80 from e where norm <> '' and rg <> ''
    union all select 'prefix3', substr(norm, 1, 3), org_no, 8 from e where norm <> '' union all select distinct 'rare_token', w, org_no, 80 from rare
    union all select 'acronym_region', acr || '|' || rg, org_no, 20 from e where len(acr) between 3 and 8 and rg <> ''),
  fit as (select * from (select *, count(*) over (partition by strategy, block) as n from blocks) where n between 2 and largest)"""


def _trigrams(c: str) -> str:
    w = f"regexp_split_to_array(trim(lower(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9 ]', '', 'g'))), '\\s+')"
    return f"case when len({w}) >= 3 then list_distinct(list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' '))) else [] end"


def _check(area: str, name: str, bad: str, rows: str, status: str = "FAIL", allowed: str = "0") -> str:
    return f"select '{area}' as area, '{name}' as name, ({bad})::bigint as n_bad, ({rows})::bigint as n_rows, '{status}' as fails, {allowed} as allowed"


_CHECKS = " union all ".join(
    [
        _check("orders", "key is unique", "select count(*) - count(distinct o_orderkey) from orders", "select count(*) from orders"),
        _check("lineitem", "key is unique", "select count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem", "select count(*) from lineitem"),
        _check("orders", "buyer exists", "select count(*) from orders where o_custkey not in (select c_custkey from customer)", "select count(*) from orders"),
        _check("lineitem", "order exists", "select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)", "select count(*) from lineitem"),
        _check("lineitem", "part exists", "select count(*) from lineitem where l_partkey not in (select p_partkey from part)", "select count(*) from lineitem"),
        _check("lineitem", "supplier exists", "select count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)", "select count(*) from lineitem"),
        _check("universe", "tender values are not additive", "select count(*) from u where value_is_additive and value_source = 'tender'", "select count(*) from u"),
        _check("universe", "has a supplier", "select count(*) from u where supplier_count = 0", "select count(*) from u", "WARN", "0.001 * (select count(*) from u)"),
    ]
)
_RANK = "len(list_intersect(own, want))"
SQL = {
    "party_summary": f"{_U} select l_orderkey as order_key, array_to_string(supplier_names, '|') as names, coalesce(supplier_names[1], '') as first_name, supplier_count from sup",
    "org_enrichment": f"{_U} select buyer_name, count(*) as n_contracts, {_ADD} as additive_sum, min(release_year) as first_year, max(release_year) as last_year from u group by 1",
    "cpv_enrichment": f"{_U} select tender_cpv_id, count(*) as n_contracts, {_ADD} as additive_sum, substr(tender_cpv_id, 1, 2) as prefix2, case when len(tender_cpv_id) >= 9 then substr(tender_cpv_id, 1, 9) else '' end as prefix9 from u where tender_cpv_id <> '' group by 1",
    "integrity_checks": f"{_U} select area, name, case when n_bad > allowed then fails else 'PASS' end as status, n_bad, n_rows from ({_CHECKS})",
    "latest_release": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where user_id is not null) where r = 1",
    "latest_record": "select k, row_id from (select nullif(upper(regexp_replace(contract_node_id, '[^\\p{L}\\p{N}]+', '', 'g')), '') as k, row_id, row_number() over (partition by k order by loaded_at desc, row_id) as r from runtime_records) where r = 1 and k is not null",
    "value_fallback": """select o_orderkey, round(coalesce(case when o_orderstatus = 'F' then o_totalprice end, s, o_totalprice), 2) as best_value, case when o_orderstatus = 'F' then 'award' when s is not null then 'contract' else 'tender' end as value_source
      from orders left join (select l_orderkey, sum(l_extendedprice::decimal(18,2))::double as s from lineitem group by 1) on l_orderkey = o_orderkey""",
    "lot_fallback_join": """with docs as (select doc_id, ocid, replace(lot_id, 'lot-', 'a') as award from documents where lot_id <> ''), rec as (select ocid, regexp_extract(contract_node_id, ':(a\\d+)$', 1) as award, row_id from runtime_records where regexp_matches(contract_node_id, ':(a\\d+)$'))
      select doc_id, row_id as record_row, 'narrow' as match_scope from docs join rec using (ocid, award)
      union all select doc_id, row_id, 'wide' from docs join (select distinct ocid, row_id from rec) r using (ocid) where not exists (select 1 from rec x where x.ocid = docs.ocid and x.award = docs.award)""",
    "group_alignment": """select canonical_id, coalesce(l, 0) as "left", coalesce(r, 0) as "right" from (select canonical_id, count(*) as l from buyer_of where canonical_id is not null group by 1) full join (select canonical_id, count(*) as r from supplier_of where canonical_id is not null group by 1) using (canonical_id)""",
    "set_check": "select (select count(*)::bigint from (select distinct ocid from buyer_of where ocid is not null except select ocid from runtime_records)) as n_missing, (select count(*)::bigint from (select distinct ocid from runtime_records where ocid is not null except select ocid from buyer_of)) as n_extra",
    "norm_name": f"with {_NORM_REG} select org_no, norm from reg",
    "id_parts": f"""with p as (select obs_id, {_SCHEME} as scheme, {_VALUE} as value from party_obs) select obs_id, scheme, value, upper(trim(scheme)) in ({_OFFICIAL}) as official,
      (case upper(trim(scheme)) {" ".join(f"when '{s}' then {n}" for s, n in S.SCHEMES.items())} else 50 end)::int as priority,
      case when upper(trim(scheme)) in ({_OFFICIAL}) then upper(trim(scheme)) || '-' || case when upper(trim(scheme)) = 'GB-NHS' then upper(trim(value)) else trim(value) end end as canonical from p""",
    "region_relations": """with p as (select entity_a_id, entity_b_id, upper(trim(coalesce(address_region_a, ''))) as x, upper(trim(coalesce(address_region_b, ''))) as y from er_pairs)
      select entity_a_id, entity_b_id, case when x = '' or y = '' then 'missing' when x = y then 'same' when starts_with(x, 'UK') and starts_with(y, 'UK') and (starts_with(x, y) or starts_with(y, x)) then 'compatible_hierarchy' else 'conflict' end as relation from p""",
    "name_jaccard": f"""with p as (select entity_a_id, entity_b_id, {_toks("coalesce(norm_name_a, '')")} as x, {_toks("coalesce(norm_name_b, '')")} as y from er_pairs)
      select entity_a_id, entity_b_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0)::double, 6) as jaccard from p""",
    "name_acronym": f"select org_no, case when len(a) between 2 and 8 then a else '' end as acronym from (select org_no, {_ACRONYM} as a from canonical_orgs)",
    "name_jaro_winkler": "select entity_a_id, entity_b_id, round(case when norm_name_a = '' or norm_name_b = '' then 0 else jaro_winkler_similarity(norm_name_a, norm_name_b) end, 6) as similarity from er_pairs where norm_name_a is not null and norm_name_b is not null",
    "question_years": "select row_id, array_to_string(regexp_extract_all(question, '\\b((?:19|20)\\d{2})\\b', 1), '|') as years from qa_rows",
    "stable_ids": "select doc_id, substr(sha256(coalesce(ocid, '') || '|' || coalesce(field_path, '') || '|' || coalesce(lot_id, '')), 1, 16) as hash_id from documents",
    "json_drill": "select event_type, count(k) as n, sum(k)::bigint as total from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1",
    "json_lists": f"select row_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_concat([address_region], {_JL.format(c='address_regions')}), lambda r: r is not null and trim(r) <> ''), lambda r: trim(r)))), '|') as regions from org_nodes",
    "er_name_region_merge": f"""with {_NORM_REG}, r as (select org_no, norm, coalesce(upper(trim(region)), '') as rg from reg), g as (select norm, rg, count(*) as n from r where norm <> '' group by 1, 2 having count(*) > 1)
      select r.org_no, case when n is not null then 'NR-' || substr(sha256(r.norm || '|' || r.rg), 1, 12) else r.org_no::varchar end as merged_id, coalesce(n, 1)::bigint as n from r left join g on r.norm = g.norm and r.rg = g.rg""",
    "er_block_pairs": f"""with {_NORM_REG}, e as (select org_no as id, norm, substr(norm, 1, 3) as block from reg where norm <> '')
      select * from (select x.id as a, y.id as b, x.norm as norm_a, y.norm as norm_b, round(jaro_winkler_similarity(x.norm, y.norm), 4) as similarity from e x join e y on x.block = y.block and x.id < y.id) where similarity >= 0.92""",
    "er_strategy_share": f"with p as (select list_distinct({_JL.format(c='strategies')}) as s from er_pairs) select strategy, count(*) as n_pairs, count(*) filter (alone) as n_alone from (select unnest(s) as strategy, len(s) = 1 as alone from p) group by 1",
    "er_components": """with recursive e as (select entity_a_id as a, entity_b_id as b from er_pairs where shared_region and shared_cpv2 > 0 union select entity_b_id, entity_a_id from er_pairs where shared_region and shared_cpv2 > 0),
      r(node, c) as (select a, a from e union select e.b, r.c from r join e on e.a = r.node) select node, min(c) as component from r group by 1""",
    "er_merge_plan": f"""with {_NORM_REG}, r as (select *, count(*) over (partition by norm, coalesce(upper(trim(region)), '')) as n, coalesce(upper(trim(region)), '') as rg from reg where norm <> '')
      select org_no as old_id, first_value(org_no) over (partition by norm, rg order by case er_status when 'deterministic' then 0 when 'gov_lookup' then 1 else 2 end, -n_aliases, org_no) as new_id from r where n > 1""",
    "er_conflicts": f"""with recursive e as (select entity_a_id as a, entity_b_id as b from er_pairs where shared_region and shared_cpv2 > 0 union select entity_b_id, entity_a_id from er_pairs where shared_region and shared_cpv2 > 0),
      r(node, c) as (select a, a from e union select e.b, r.c from r join e on e.a = r.node), m as (select node, min(c) as component from r group by 1)
      select distinct component, 'two_official_ids' as reason from m join canonical_orgs o on o.org_no = m.node where upper(trim(official_scheme)) in ({_OFFICIAL}) group by component, official_scheme having count(distinct official_id) > 1
      union select distinct x.component, 'rejected_pair' from er_pairs p join m x on p.entity_a_id = x.node join m y on p.entity_b_id = y.node where p.official_scheme_conflict and x.component = y.component""",
    "er_registry_lookup": f"""with {_NORM_REG}, h as (select norm, min(canonical_id) as id from reg where org_category = 'health' and norm <> '' group by 1), d as (select norm, min(canonical_id) as id from reg where org_category = 'education' and norm <> '' group by 1),
      o as (select obs_id, {_norm("name")} as norm from party_obs) select obs_id, case when h.id is not null then 'health' else 'education' end as registry, coalesce(h.id, d.id) as registry_id from o left join h using (norm) left join d using (norm) where coalesce(h.id, d.id) is not null""",
    "doc_token_jaccard": f"""with q as (select row_id, {_trigrams("natural_question")} as x, {_trigrams("question")} as y from qa_bank) select row_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0)::double, 6) as jaccard from q""",
    "doc_rank_whole": f"""with w as (select doc_id, list_distinct(regexp_extract_all(upper(coalesce(text, '')), '[A-Z0-9]+')) as own, ['CONTRACT', 'INSURANCE', 'NOTICE', 'PAYMENT', 'TERMINATION'] as want from documents)
      select doc_id, round({_RANK} / sqrt(len(own)) + {_RANK} / sqrt(5.0), 6) as score from w where {_RANK} > 0 order by score desc, lpad(doc_id::varchar, 12, '0') desc limit 8""",
    "label_lookup": """with l as (select distinct p_name as label, list_distinct(regexp_extract_all(lower(p_name), '\\w+')) as own from part), s as (select label, round((2 * len(list_intersect(own, ['red', 'small'])) + case when contains(lower(label), 'small red') or contains('small red', lower(label)) then 1 else 0 end)
      / len(list_distinct(list_concat(own, ['red', 'small'])))::double, 6) as score from l) select label, score from s where score > 0 order by score desc, len(label), label limit 10""",
    "url_group_summary": """with t as (select *, (date_published is not null)::int as dated from documents)
      select case grouping(source, document_type) when 1 then 'source' when 2 then 'document_type' else 'source+document_type' end as grouping, source, document_type, count(*) as n_docs, round(avg(dated), 6) as dated_share, round(avg(n_chars), 4) as mean_chars
      from t group by grouping sets ((source), (document_type), (source, document_type))""",
    "profile_nulls": " union all ".join(
        f"select '{c}' as \"column\", count(*) as n_rows, count(*) filter ({c} is null) as n_null, count(*) filter (trim({c}::varchar) = '') as n_blank, count(*) filter ({c} is null) / count(*)::double as null_rate from org_nodes"
        for c in ("canonical_id", "canonical_name", "org_type", "address_region", "first_activity_year", "deleted_at")
    ),
    "sum_outlier_fence": """with o as (select concat_ws('-', official_scheme, official_id) as key, official_scheme, official_id, max(supplier_additive_value_sum) as total, max(supplier_contract_count) as n from org_nodes group by official_scheme, official_id),
      m as (select key, log10(total / n) as log_mean from o where total > 0 and n > 0), q as (select quantile_cont(log_mean, 0.25) as q1, quantile_cont(log_mean, 0.75) as q3 from m having count(*) >= 8), f as (select q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from q)
      select key, case when log_mean < lower then 'low' else 'high' end as side, round(log_mean, 6) as log_mean, round(lower, 6) as lower, round(upper, 6) as upper from m, f where log_mean < lower or log_mean > upper""",
    "award_days": """select row_id, coalesce(try_strptime(substr(s, 1, 10), '%Y-%m-%d'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%d %B %Y'), try_strptime(s, '%d %b %Y'), try_strptime(s, '%B %d, %Y'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%d.%m.%Y'), try_strptime(s, '%d-%m-%Y'))::date::varchar as day
      from (select row_id, regexp_replace(trim(award_date_signed), '(\\d)(st|nd|rd|th)\\b', '\\1') as s from runtime_records)""",
    "award_amounts": """select row_id, try_cast(nullif(replace(regexp_extract(s, '(-?\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', ''), '') as double) * case regexp_extract(s, '\\d\\s*(k|m|bn|b|thousand|million|billion)\\b', 1) when 'k' then 1e3 when 'thousand' then 1e3 when 'm' then 1e6 when 'million' then 1e6
      when 'bn' then 1e9 when 'b' then 1e9 when 'billion' then 1e9 else 1 end as amount from (select row_id, lower(trim(string_split(value_amount, chr(10))[1])) as s from runtime_records)""",
    "er_role_alias": f"""with p as (select release_year, obs_id::varchar as raw_id, {_norm("name")} as norm, case when trim(identifier_scheme) <> '' and trim(identifier_id) <> '' then identifier_scheme || '-' || identifier_id end as cid, unnest({_JL.format(c="roles_json")}) as role from party_obs)
      select o.raw_id, min(k.cid) as canonical_id from p o join p k on o.release_year = k.release_year and o.norm = k.norm and o.role = k.role and o.cid is null and k.cid is not null where o.norm <> '' group by 1 having count(distinct k.cid) = 1""",
    "er_multi_block": f"""with {_BLOCKS}, big as (select b.strategy, b.block, b.org_no, e.norm from (select *, count(*) over (partition by strategy, block) as n from blocks) b join e using (org_no) where b.n > b.largest),
      rep as (select strategy, block, norm, min(org_no) as rep from big group by all),
      p as (select a.org_no as a, b.org_no as b, a.strategy from fit a join fit b on a.strategy = b.strategy and a.block = b.block and a.org_no < b.org_no
        union all select rep, org_no, strategy from big join rep using (strategy, block, norm) where org_no <> rep
        union all select x.rep, y.rep, x.strategy from rep x join rep y on x.strategy = y.strategy and x.block = y.block and x.rep < y.rep where round(jaro_winkler_similarity(x.norm, y.norm), 4) >= 0.92)
      select a, b, array_to_string(list_sort(list(distinct strategy)), '|') as strategies from p group by 1, 2""",
    "er_block_metrics": f"""with {_BLOCKS} select strategy, count(*) as n_blocks, count(*) filter (n > largest) as n_large, max(n) as largest from (select strategy, block, count(*) as n, any_value(largest) as largest from blocks group by 1, 2) where n > 1 group by 1""",
    "url_manifest": """with u as (select *, regexp_replace(trim(url), '#.*$', '') as s from documents where trim(url) <> ''),
      v as (select *, case when starts_with(s, '//') then 'https:' || s when not regexp_matches(s, '^(?i)[a-z][a-z0-9+.-]*://') then 'https://' || s else s end as t from u),
      w as (select *, lower(regexp_extract(t, '^(?i)([a-z][a-z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(regexp_extract(t, '^(?i)[a-z][a-z0-9+.-]*://[^/?]*(.*)$', 1), '/+$', '') as norm_url from v)
      select substr(sha256(norm_url), 1, 16) as url_hash, count(*) as n_rows, count(distinct ocid) as n_ocids, count(distinct doc_id) as n_docs, min(date_published) as first_published, max(date_published) as last_published,
      coalesce(array_to_string(list_sort(list(distinct source) filter (source is not null)), '|'), '') as sources, coalesce(array_to_string(list_sort(list(distinct document_type) filter (document_type is not null)), '|'), '') as document_types, min(ocid) as example_ocid from w group by norm_url""",
    "doc_tf_idf": """with q as (select 1::int as query_id, 'insurance for each claim' as query union all select 2, 'payment within days of a valid invoice' union all select 3, 'street lighting award'),
      tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) as term from documents) group by 1, 2), n as (select count(*) as n from documents),
      idf as (select term, ln((n + 1) / (count(*) + 1)) + 1 as idf from tf, n group by term, n), w as (select doc_id, term, tf * idf as w from tf join idf using (term)), norm as (select doc_id, sqrt(sum(w * w)) as norm from w group by 1),
      qw as (select query_id, term, count(*) * any_value(idf) as qw from (select query_id, unnest(regexp_extract_all(query, '[0-9a-z_]+')) as term from q) join idf using (term) group by 1, 2), qn as (select query_id, sqrt(sum(qw * qw)) as qnorm from qw group by 1),
      s as (select query_id, doc_id, round(sum(w * qw) / any_value(norm * qnorm), 6) as score from w join qw using (term) join norm using (doc_id) join qn using (query_id) group by 1, 2)
      select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 5""",
    "fd_probe": "select row_id from qa_rows where plan_id in (select plan_id from qa_rows where plan_id is not null group by 1 having count(distinct answer_type) = 1)",
    "round_robin_sample": "select row_id, template_family from (select row_id, template_family, row_number() over (partition by template_family order by sha1(id), row_id) as r from qa_rows) order by r, template_family nulls first limit 60",
    "strat_sample": """select row_id from (select row_id, row_number() over (partition by difficulty, answer_operation order by sha1(id) || row_id::varchar) as r, count(*) over (partition by difficulty, answer_operation) as n from qa_rows) where r <= greatest(1, round(n * 0.1))""",
    "hash_sample": "select doc_id from documents where ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 1000 < 20",
    "head_per_group": "select row_id, template_family from (select row_id, template_family, row_number() over (partition by template_family order by created_at desc, row_id) as r from qa_rows) where r <= 3",
    "bucketed_counts": "with t as (select buyer_name from runtime_records where buyer_name is not null group by 1 order by count(*) desc, 1 limit 25) select case when buyer_name in (select buyer_name from t) then buyer_name else 'other' end as bucket, count(*) as n from runtime_records where buyer_name is not null group by 1",
    "ambiguous_miner": f"{_U} select buyer_name, release_year, count(distinct supplier_name) as n_answers from u where supplier_name <> '' group by 1, 2 having count(distinct supplier_name) >= 3",
    "no_result_miner": f"{_U}, b as (select buyer_name from u group by 1 having count(distinct release_year) >= 5), y as (select distinct release_year from u) select b.buyer_name, y.release_year from b, y where not exists (select 1 from u where u.buyer_name = b.buyer_name and u.release_year = y.release_year)",
    "anchor_miner": f"{_U} select buyer_name, count(distinct release_year) as n_years, count(*) as n from u group by 1 having count(distinct release_year) >= 3 and count(*) between 5 and 60",
    "unique_top": f"{_U}, g as (select release_year, buyer_name, count(*) as n, rank() over (partition by release_year order by count(*) desc) as r from u group by 1, 2) select release_year, min(buyer_name) as buyer_name, max(n) as n from g where r = 1 group by 1 having count(*) = 1",
    "value_shares": "select answer_operation as value, count(*) as n, round(count(*) / (select count(*) from qa_rows)::double, 6) as share from qa_rows group by 1",
    "pivot_counts": "select template_family, count(*) filter (split = 'train') as train, count(*) filter (split = 'dev') as dev, count(*) filter (split = 'final_test') as final_test, count(*) filter (split = 'ood') as ood from qa_rows where split is not null group by 1",
    "division_keys": f"{_U} select buyer_name from u group by 1 having bool_and(value_is_additive)",
}
