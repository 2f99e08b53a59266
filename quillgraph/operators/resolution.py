"""Entity resolution: blocking, similarity joins, pair features, merges and registry lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings as S
from .components import connected_components
from .relational import first_per_key


@dataclass(frozen=True)
class Block:
    """A blocking strategy: rows with an equal key are compared; of blocks of more than `largest` rows only the similar names."""

    name: str
    keys: Column  # a string, or an array of strings
    largest: int = 80


def entity_columns(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` with its normalised name, tokens and acronym."""
    d = df.withColumn("norm", S.norm_name(F.col(name)))
    return d.withColumn("name_tokens", S.tokens(F.col("norm"))).withColumn("acronym", S.acronym(F.col("norm")))


def block_rows(entities: DataFrame, key: str, blocks: list[Block]) -> DataFrame:
    """`strategy, block, id`: every entity in each block it belongs to."""
    out = []
    for b in blocks:
        listed = entities.select(F.col(key).alias("id"), b.keys.alias("k"))
        if listed.schema["k"].dataType.simpleString().startswith("array"):
            listed = listed.select("id", F.explode("k").alias("k"))
        out.append(listed.where("k <> ''").select(F.lit(b.name).alias("strategy"), F.col("k").alias("block"), "id").distinct())
    return reduce(DataFrame.unionAll, out)


#: Part of the longer name's characters that names of a Jaro-Winkler similarity of 0.92 (0.91995 before it is rounded) share at least, and the least sum of both parts.
SHARED_PART, SHARED_SUM = 0.5997, 1.5997


def _characters(norm: Column) -> Column:
    """The characters of a name with their repetitions, in one fixed order from rare to frequent: later repetitions and rarer letters first."""
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    nth = F.transform(chars, lambda c, i: F.concat(F.lpad((99 - F.least(F.lit(99), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)))).cast("string"), 2, "0"), F.translate(c, "zqjxkvbpgwyfmcuhdlrsnoitae ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ[")))
    return F.array_sort(nth)


def similar_within(rows: DataFrame, threshold: float = 0.92) -> DataFrame:
    """`block, a, b, norm_a, norm_b, similarity` of the entities (`block, id, norm`) with similar names in a block of any size.

    A name stands once in a block, by its smallest id: other ids of the name are linked to that one, and different names by their smallest
    ids. Names of a similarity of 0.92 or more share SHARED_PART of the longer one's characters, so they meet in one of the rarest of
    these; those that do are counted on all characters and then compared. No block is skipped and no pair of different names is lost.
    """
    names = rows.groupBy("block", "norm").agg(F.min("id").alias("rep"))
    same = rows.join(names, ["block", "norm"]).where("id <> rep").select("block", F.col("rep").alias("a"), F.col("id").alias("b"), F.col("norm").alias("norm_a"), F.col("norm").alias("norm_b"), F.lit(1.0).alias("similarity"))
    other = similar_candidates(names, threshold).withColumn("similarity", F.round(S.jaro_winkler("norm_a", "norm_b"), 4)).where(F.col("similarity") >= threshold)
    return same.unionByName(other)


def similar_candidates(names: DataFrame, threshold: float = 0.92) -> DataFrame:
    """`block, a, b, norm_a, norm_b` (a < b) of the different names (`block, norm, rep`) that share enough characters to be similar."""
    if threshold < 0.92:
        raise ValueError("the shared characters are worked out for 0.92 and more")
    n = names.withColumn("chars", _characters(F.col("norm"))).withColumn("n", F.size("chars"))
    keyed = n.withColumn("k", F.explode(F.expr(f"slice(chars, 1, n - cast(ceil({SHARED_PART} * n - 1e-9) as int) + 1)")))
    x, y = (keyed.select("block", "k", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "norm", "chars", "n")]) for s in ("a", "b"))
    near = (F.col("rep_a") < F.col("rep_b")) & (F.least("n_a", "n_b") >= SHARED_PART * F.greatest("n_a", "n_b"))
    shared = F.size(F.array_intersect("chars_a", "chars_b"))
    # Never by a broadcast, for which it would be taken by the size of the names before they are exploded.
    met = x.hint("merge").join(y.hint("merge"), ["block", "k"]).where(near).where(shared / F.col("n_a") + shared / F.col("n_b") >= SHARED_SUM - 1e-9)
    return met.select("block", F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "norm_a", "norm_b").distinct()


def block_pairs(entities: DataFrame, key: str, blocks: list[Block], norm: str = "norm") -> DataFrame:
    """`a, b, strategies`: pairs of different entities that share a block; each pair once, with every strategy that found it.

    All pairs of a block of at most its strategy's size come out; a larger one gives the links of its similar names (`similar_within`).
    Sizes are counted before anything is joined.
    """
    rows = block_rows(entities, key, blocks)
    limit = reduce(lambda x, b: F.when(F.col("strategy") == b.name, F.lit(b.largest)).otherwise(x), blocks, F.lit(0))
    sizes = rows.groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("fits", F.col("n") <= limit)
    live = rows.join(sizes.where("fits").select("strategy", "block"), ["strategy", "block"], "left_semi")
    a, b = live.withColumnRenamed("id", "a"), live.withColumnRenamed("id", "b")
    small = a.join(b, ["strategy", "block"]).where("a < b").select("a", "b", "strategy")
    large = rows.join(sizes.where("not fits").select("strategy", "block"), ["strategy", "block"], "left_semi").join(entities.select(F.col(key).alias("id"), F.col(norm).alias("norm")), "id")
    linked = similar_within(large.select(F.struct("strategy", "block").alias("block"), "id", "norm")).select("a", "b", "block.strategy")
    return small.unionByName(linked).groupBy("a", "b").agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))


def block_metrics(entities: DataFrame, key: str, blocks: list[Block]) -> DataFrame:
    """`strategy, n_blocks, n_large, largest` of the blocks with two or more entities."""
    g = block_rows(entities, key, blocks).groupBy("strategy", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    limit = reduce(lambda x, b: F.when(F.col("strategy") == b.name, F.lit(b.largest)).otherwise(x), blocks, F.lit(0))
    return g.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("n") > limit).alias("n_large"), F.max("n").alias("largest"))


def rare_tokens(entities: DataFrame, key: str, most: int = 10) -> DataFrame:
    """`entities` with `rare`: the tokens of four or more letters that at most `most` entities have."""
    t = entities.select(F.col(key).alias("__id"), F.explode(F.filter("name_tokens", lambda w: F.length(w) >= 4)).alias("w"))
    rare = t.join(t.groupBy("w").count().where(F.col("count").between(2, most)).select("w"), "w").groupBy("__id").agg(F.collect_set("w").alias("rare"))
    return entities.join(rare, F.col(key) == F.col("__id"), "left").drop("__id").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


def standard_blocks() -> list[Block]:
    """Exact name, name and region, three first letters, rare tokens, acronym and region."""
    region = F.coalesce(F.col("address_region"), F.lit(""))
    return [
        Block("exact_norm_name", F.col("norm"), 80),
        Block("name_region", F.when((F.col("norm") != "") & (region != ""), F.concat_ws("|", "norm", region)).otherwise(""), 80),
        Block("prefix3", F.substring("norm", 1, 3), 8),
        Block("rare_token", F.col("rare"), 80),
        Block("acronym_region", F.when((F.length("acronym") >= 3) & (region != ""), F.concat_ws("|", "acronym", region)).otherwise(""), 20),
    ]


def similar_pairs(entities: DataFrame, key: str, name: str, threshold: float = 0.92, largest: int | None = None) -> DataFrame:
    """`a, b, norm_a, norm_b, similarity`: all pairs of entities whose names begin with the same three letters and are Jaro-Winkler similar.

    Each name is compared once, however many entities have it, and the pairs of names then give those of their entities. Only where
    `largest` is given, a block of more entities gives the links of its similar names instead (`similar_within`).
    """
    e = entities.select(F.col(key).alias("id"), S.norm_name(F.col(name)).alias("norm")).where("norm <> '' and id is not null").withColumn("block", F.substring("norm", 1, 3))
    links = None
    if largest is not None:
        sizes = e.groupBy("block").count()
        links = similar_within(e.join(sizes.where(F.col("count") > largest).select("block"), "block", "left_semi"), threshold).drop("block")
        e = e.join(sizes.where(F.col("count") <= largest).select("block"), "block", "left_semi")
    a, b = e.select(F.col("norm").alias("norm_a"), F.col("id").alias("a")), e.select(F.col("norm").alias("norm_b"), F.col("id").alias("b"))
    same = a.join(b, F.col("norm_a") == F.col("norm_b")).where("a < b").withColumn("similarity", F.lit(1.0))
    met = similar_candidates(e.groupBy("block", "norm").agg(F.min("id").alias("rep")), threshold)
    # Which of two names is the first one can change how their letters are matched, so both orders are told.
    both = met.select("norm_a", "norm_b").unionByName(met.select(F.col("norm_b").alias("norm_a"), F.col("norm_a").alias("norm_b")))
    both = both.withColumn("similarity", F.round(S.jaro_winkler("norm_a", "norm_b"), 4)).where(F.col("similarity") >= threshold)
    pairs = same.unionByName(both.join(a, "norm_a").join(b, "norm_b").where("a < b").select("norm_a", "a", "norm_b", "b", "similarity")).select("a", "b", "norm_a", "norm_b", "similarity")
    return pairs if links is None else pairs.unionByName(links)


def pair_features(pairs: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Features, score in [0, 1], ordered risk flags and tier of each pair `a, b, strategies`."""
    cols = ["norm", "name_tokens", "address_region", "org_category", "org_type", "official_scheme", "n_aliases", "cpv2", "first_year", "last_year"]
    side = lambda s: entities.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    d = pairs.join(side("a"), "a").join(side("b"), "b")
    d = d.withColumns(
        {
            "name_similarity": F.round(S.sequence_ratio("norm_a", "norm_b"), 4), "token_jaccard": F.round(S.jaccard(F.col("name_tokens_a"), F.col("name_tokens_b")), 4),
            "region_relation": S.region_relation(F.col("address_region_a"), F.col("address_region_b")),
            "shared_cpv2": F.size(F.array_intersect(S.string_list(F.col("cpv2_a")), S.string_list(F.col("cpv2_b")))),
            "shared_years": F.greatest(F.lit(0), F.least("last_year_a", "last_year_b") - F.greatest("first_year_a", "first_year_b") + 1),
            "shared_org_category": (F.col("org_category_a") == F.col("org_category_b")) & (F.col("org_category_a") != ""),
            "both_official": S.is_official(F.col("official_scheme_a")) & S.is_official(F.col("official_scheme_b")),
        }
    )
    d = d.withColumns(
        {
            "shared_region": F.col("region_relation").isin("same", "compatible_hierarchy"),
            "same_official_scheme": F.coalesce(F.col("both_official") & (F.col("official_scheme_a") == F.col("official_scheme_b")), F.lit(False)),
            "official_scheme_conflict": F.coalesce(F.col("both_official") & (F.col("official_scheme_a") != F.col("official_scheme_b")), F.lit(False)),
        }
    )
    bonus = F.least(F.lit(0.08), 0.015 * F.col("shared_cpv2") + 0.01 * F.coalesce("shared_years", F.lit(0))) + F.when(F.col("shared_region"), 0.03).otherwise(0.0)
    bonus = bonus + F.when(F.coalesce("shared_org_category", F.lit(False)), 0.02).otherwise(0.0)
    penalty = F.when(F.col("official_scheme_conflict"), 0.12).otherwise(0.0) + F.when(F.col("same_official_scheme"), 0.10).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.72 * F.col("name_similarity") + 0.14 * F.col("token_jaccard") + bonus - penalty))
    short = (F.col("norm_a") != F.col("norm_b")) & (F.greatest(F.length("norm_a"), F.length("norm_b")) <= 5)
    weak = F.exists("strategies", lambda s: s.startswith("acronym")) & (F.col("name_similarity") < 0.85)
    flags = F.array(
        F.when(F.col("official_scheme_conflict"), "official_scheme_conflict"), F.when(F.col("same_official_scheme"), "trusted_id_conflict"), F.when(short | weak, "short_name_or_acronym_ambiguous"),
        F.when(F.col("region_relation") == "conflict", "region_conflict"), F.when(weak, "insufficient_evidence"), F.when((F.greatest("n_aliases_a", "n_aliases_b") >= 50) & (F.col("name_similarity") < 0.98), "other_er_risk"),
    )
    d = d.withColumn("heuristic_score", F.round(score, 4)).withColumn("risk_flags", F.array_compact(flags))
    return d.withColumn("risk_tier", risk_tier(F.col("risk_flags"), F.col("heuristic_score"), F.col("region_relation"), F.col("norm_a") == F.col("norm_b"))).select(
        "a", "b", "strategies", "name_similarity", "token_jaccard", "region_relation", "shared_region", "shared_cpv2", "shared_years", "same_official_scheme", "official_scheme_conflict",
        "heuristic_score", "risk_flags", "risk_tier",
    )


def risk_tier(flags: Column, score: Column, region: Column, same_name: Column, auto: float = 0.88) -> Column:
    """What may be done with a pair; later rules win: candidate, automatic merge, region quality, region hierarchy, review."""
    serious = F.exists(flags, lambda f: f != "region_conflict")
    only_region = (F.size(flags) == 1) & F.array_contains(flags, "region_conflict")
    high = score >= auto
    return (
        F.when(serious, "review").when(high & (region == "compatible_hierarchy") & (F.size(flags) == 0), "region_hierarchy_candidate").when(only_region & same_name & high, "region_quality_candidate")
        .when((F.size(flags) == 0) & high, "auto_merge_candidate").otherwise("candidate_only")
    )


def name_region_merge(orgs: DataFrame, key: str = "canonical_id", name: str = "canonical_name", region: str = "address_region") -> DataFrame:
    """`canonical_id, merged_id, n`: rows of one normalised name and region share an id made of both; blank names stay single."""
    d = orgs.select(F.col(key).cast("string").alias("canonical_id"), S.norm_name(F.col(name)).alias("norm"), F.coalesce(F.upper(F.trim(F.col(region))), F.lit("")).alias("region"))
    n = d.where("norm <> ''").groupBy("norm", "region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    d = d.join(n, ["norm", "region"], "left")
    merged = F.when(F.col("n").isNotNull(), F.concat(F.lit("NR-"), S.stable_hash(12, F.col("norm"), F.col("region")))).otherwise(F.col("canonical_id"))
    return d.select("canonical_id", merged.alias("merged_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def clusters(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component` of string or long ids; the component is named by its smallest member."""
    if edges.schema[a].dataType.simpleString() in ("bigint", "int"):
        return connected_components(edges, a, b)
    ids = edges.select(F.col(a).alias("s")).union(edges.select(F.col(b))).distinct().withColumn("i", F.xxhash64("s"))
    e = edges.select(F.xxhash64(a).alias("x"), F.xxhash64(b).alias("y"))
    c = connected_components(e, "x", "y").join(ids, F.col("node") == F.col("i")).select("s", "component")
    low = c.groupBy("component").agg(F.min("s").alias("low"))
    return c.join(low, "component").select(F.col("s").alias("node"), F.col("low").alias("component"))


def merge_conflicts(members: DataFrame, ids: DataFrame, rejected: DataFrame) -> DataFrame:
    """`component, reason`: components that hold two values of one registry (`ids`: node, scheme, value) or a rejected pair (`a, b`)."""
    two = members.join(ids, "node").groupBy("component", "scheme").agg(F.count_distinct("value").alias("n")).where("n > 1").select("component", F.lit("two_official_ids").alias("reason"))
    ma, mb = members.select(F.col("node").alias("a"), "component"), members.select(F.col("node").alias("b"), F.col("component").alias("other"))
    inside = rejected.join(ma, "a").join(mb, "b").where("component = other").select("component", F.lit("rejected_pair").alias("reason"))
    return two.unionByName(inside).distinct()


def apply_merges(orgs: DataFrame, members: DataFrame, key: str, precedence: list[Column]) -> DataFrame:
    """`old_id, new_id`: each member of a component to its representative, the first by precedence and then id."""
    d = members.join(orgs, members["node"] == orgs[key])
    best = first_per_key(d.select("component", "node", *[p.alias(f"__p{i}") for i, p in enumerate(precedence)]), ["component"], [*[F.col(f"__p{i}") for i in range(len(precedence))], F.col("node")])
    return members.join(best.select("component", F.col("node").alias("new_id")), "component").select(F.col("node").alias("old_id"), "new_id")


def remap(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """`df` with a column's ids replaced by their new ones."""
    m = mapping.select(F.col("old_id").alias("__o"), F.col("new_id").alias("__n"))
    return df.join(m, F.col(column) == F.col("__o"), "left").withColumn(column, F.coalesce("__n", column)).drop("__o", "__n")


def registry_lookup(orgs: DataFrame, name: str, registries: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """`key, registry, registry_id`: the first registry in order of priority (each `norm, registry_id`) that has the normalised name."""
    d = orgs.select(F.col(key).alias("__key"), S.norm_name(F.col(name)).alias("norm"))
    found = []
    for i, (label, r) in enumerate(registries):
        one = first_per_key(r.where("norm <> ''").select("norm", F.col("registry_id").alias(f"r{i}")), ["norm"], [F.col(f"r{i}")])
        d = d.join(one, "norm", "left")
        found.append(F.when(F.col(f"r{i}").isNotNull(), F.struct(F.lit(label).alias("registry"), F.col(f"r{i}").alias("registry_id"))))
    return d.withColumn("__f", F.coalesce(*found)).where("__f is not null").select(F.col("__key").alias(key), "__f.registry", "__f.registry_id")


def role_alias(parties: DataFrame) -> DataFrame:
    """`raw_id, canonical_id` of unresolved parties (`ocid, raw_id, norm, roles, canonical_id or null`): the resolved party of the same notice,
    name and role, if there is exactly one."""
    p = parties.select("ocid", "raw_id", "norm", "canonical_id", F.explode("roles").alias("role"))
    known, open_ = p.where("canonical_id is not null"), p.where("canonical_id is null")
    hit = open_.drop("canonical_id").join(known.select("ocid", "norm", "role", "canonical_id"), ["ocid", "norm", "role"])
    return hit.groupBy("raw_id").agg(F.count_distinct("canonical_id").alias("n"), F.min("canonical_id").alias("canonical_id")).where("n = 1").drop("n")


def best_scheme(rows: DataFrame) -> DataFrame:
    """One row per raw_id, of the most trusted registry (ties: the smaller canonical id)."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("raw_id").orderBy(S.priority(F.col("scheme")), "canonical_id"))).where("__r = 1").drop("__r")


def org_metadata(obs: DataFrame, key: str) -> DataFrame:
    """Per organisation: modal name (legal names first; ties: the smaller), role type, sorted regions and aliases."""
    legal = F.mode(F.when(F.trim("identifier_legal_name") != "", F.col("identifier_legal_name")), True)
    plain = F.mode(F.when(F.trim("name") != "", F.col("name")), True)
    roles = F.array_distinct(F.flatten(F.collect_list(S.string_list(F.col("roles_json")))))
    g = obs.groupBy(key).agg(
        F.coalesce(legal, plain).alias("canonical_name"), roles.alias("roles"), F.array_sort(F.collect_set(F.when(F.trim("address_region") != "", F.col("address_region")))).alias("regions"),
        F.array_sort(F.collect_set("raw_id")).alias("raw_ids"),
    )
    buyer, supplier = F.array_contains("roles", "buyer"), F.array_contains("roles", "supplier")
    kind = F.when(buyer & supplier, "both").when(buyer, "buyer").when(supplier, "supplier").otherwise("unknown")
    return g.select(key, "canonical_name", kind.alias("org_type"), "regions", F.size("raw_ids").alias("n_aliases"))


# --- phases -----------------------------------------------------------------------------------------------------------------------------


def phase_one(parties: DataFrame) -> DataFrame:
    """`raw_id, canonical_id, status` of every raw id of the observed parties (`ocid, raw_id, norm, roles, scheme, value`).

    First by identifier: an observation with a scheme and a value names `scheme-value`; of several the most trusted registry's, then the
    smaller (`deterministic`). Else by the one resolved party of the same notice, name and role (`role_alias`). Else the raw id stands for
    itself (`singleton`). Blank raw ids are none; each raw id comes out once.
    """
    p = parties.where(F.trim("raw_id") != "")
    named = (F.trim("scheme") != "") & (F.trim("value") != "")
    ids = p.where(named).select("raw_id", F.upper(F.trim("scheme")).alias("scheme"), F.concat_ws("-", F.upper(F.trim("scheme")), F.upper(F.trim("value"))).alias("canonical_id")).distinct()
    own = best_scheme(ids).select("raw_id", "canonical_id")
    alias = role_alias(p.join(own, "raw_id", "left").select("ocid", "raw_id", "norm", "roles", "canonical_id").where("norm <> ''"))
    every = p.select("raw_id").distinct().join(own, "raw_id", "left").join(alias.withColumnRenamed("canonical_id", "by_role"), "raw_id", "left")
    status = F.when(F.col("canonical_id").isNotNull(), "deterministic").when(F.col("by_role").isNotNull(), "role_alias").otherwise("singleton")
    return every.select("raw_id", F.coalesce("canonical_id", "by_role", "raw_id").alias("canonical_id"), status.alias("status"))


def consolidate(orgs: DataFrame, key: Column, status: Column, ranks: list[str], row: str = "row_id") -> DataFrame:
    """`key, row_id, status, n_rows`: organisation rows of one key as one, the row of the most trusted status (then the smallest id) standing
    for it. Statuses outside `ranks` are least trusted; rows without key are left out. One aggregation."""
    rank = reduce(lambda x, i: F.when(F.col("__s") == ranks[i], i).otherwise(x), reversed(range(len(ranks))), F.lit(len(ranks)))
    d = orgs.select(key.alias("key"), F.col(row).alias("row_id"), F.lower(F.trim(status)).alias("__s")).where("key is not null")
    g = d.withColumn("__rank", rank).groupBy("key").agg(F.min(F.struct("__rank", "row_id", "__s")).alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return g.select("key", "b.row_id", F.col("b.__s").alias("status"), "n_rows")


def remap_audited(aliases: DataFrame, mapping: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(aliases `raw_id, canonical_id` with merged ids replaced, audit log `raw_id, old_id, new_id, reason` of those that changed).

    `mapping` is `old_id, new_id`; chains of it are followed to their end, cycles to their smallest id.
    """
    ends = clusters(mapping.where("old_id <> new_id"), "old_id", "new_id")
    targets = mapping.where("old_id <> new_id").select(F.col("new_id").alias("node")).distinct().join(mapping.where("old_id <> new_id").select(F.col("old_id").alias("node")), "node", "left_anti")
    final = ends.join(targets.withColumn("__end", F.col("node")), "node", "left").groupBy("component").agg(F.coalesce(F.min("__end"), F.min("node")).alias("new_id"))
    m = ends.join(final, "component").select(F.col("node").alias("old_id"), "new_id")
    d = aliases.select("raw_id", F.col("canonical_id").alias("old_id")).join(m, "old_id", "left").select("raw_id", "old_id", F.coalesce("new_id", "old_id").alias("new_id"))
    return d.select("raw_id", F.col("new_id").alias("canonical_id")), d.where("old_id <> new_id").withColumn("reason", F.lit(reason))


def register_metrics(orgs: DataFrame, key: str, status: str, aliases: str) -> DataFrame:
    """One row on a register: `n_rows, n_duplicate_keys, n_singletons, singleton_rate, n_merged, mean_aliases, max_aliases`."""
    per = orgs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower(F.trim(status)) == "singleton").alias("s"), F.count_if(F.col(aliases) > 1).alias("m"), F.sum(aliases).alias("a"), F.max(aliases).alias("x"))
    g = per.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicate_keys"), F.sum("s").alias("n_singletons"), F.sum("m").alias("n_merged"), F.sum("a").alias("a"), F.max("x").alias("max_aliases"))
    rate = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("n_rows")), 6)
    return g.select("n_rows", "n_duplicate_keys", "n_singletons", rate("n_singletons").alias("singleton_rate"), "n_merged", rate("a").alias("mean_aliases"), "max_aliases")
