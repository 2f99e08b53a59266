"""Matching observed parties with a register that shares no key: soft-logic rules solved by the alternating direction method of multipliers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_stand_in, loose_key
from ..session import cut, tasks
from . import names as spelling
from .orgnames import distance, parse, same_given

#: Confidence from which a pair is a match.
MATCH = 0.43
# Categories of bodies that a company or another body is not.
PUBLIC = ("education", "health", "local", "housing", "emergency", "sole trader")
#: Observations solved as one block.
BLOCK = 2_000
#: Rounds in which siblings come to agree at most, and within what.
ROUNDS, SETTLED = 10, 0.02
#: Mean confidence of a class of siblings from which an organisation is a candidate of all its members: at most three are.
CARRIED = 0.3


@dataclass(frozen=True)
class Weights:
    """Weights of the rules (squared hinge losses); larger counts more."""

    prior: float = 1.0
    name: float = 4.0
    name_place: float = 8.0
    name_codes: float = 6.0
    renamed: float = 8.0
    nothing_against: float = 3.0
    kind_conflict: float = 40.0
    elsewhere: float = 30.0
    no_reason: float = 20.0
    category_conflict: float = 6.0
    scheme_conflict: float = 0.5
    together: float = 12.0


class Ground:
    """Ground rules over the variables of one block: hinge (w * max(0, c.x + d)^2) and hard (c.x + d <= 0) ones."""

    def __init__(self) -> None:
        self.rule, self.var, self.coef, self.d, self.w = [], [], [], [], []

    def add(self, terms: list[tuple[int, float]], d: float, w: float = np.inf) -> None:
        for v, c in terms:
            self.rule.append(len(self.d))
            self.var.append(v)
            self.coef.append(c)
        self.d.append(d)
        self.w.append(w)

    def solve(self, part: np.ndarray, rho: float = 4.0, near: float = 1e-4, check: int = 10, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """The minimiser in [0, 1]^n by alternating directions, and what is left of each variable's disagreement.

        `part` numbers the independent parts (no rule joins two). Every rule moves its own copies of its variables towards its least cost,
        each variable becomes the mean of its copies, and multipliers gather their disagreement. Every `check` rounds the parts whose
        variables and copies have settled within `near` are done, each by itself, so a result does not depend on what shares the block.
        """
        n = len(part)
        rule, var, coef = np.array(self.rule, dtype=np.int64), np.array(self.var, dtype=np.int64), np.array(self.coef)
        d, w = np.array(self.d), np.array(self.w)
        square = np.bincount(rule, coef * coef, len(d))
        gain = np.where(np.isinf(w), 1 / square, 2 * w / (rho + 2 * np.where(np.isinf(w), 0, w) * square))
        copies = np.maximum(np.bincount(var, minlength=n), 1)
        z, left = np.full(n, 0.3), np.zeros(n)
        u = np.zeros(len(var))
        for k in range(1, most + 1):
            v = z[var] - u
            over = np.maximum(np.bincount(rule, coef * v, len(d)) + d, 0)
            x = v - (gain * over)[rule] * coef
            new = np.clip(np.bincount(var, x + u, n) / copies, 0, 1)
            u += x - new[var]
            if k % check and k < most:
                z[var] = new[var]
                continue
            apart = np.zeros(int(part.max()) + 1)
            np.maximum.at(apart, part[var], np.maximum(np.abs(x - new[var]) / 10, np.abs(new - z)[var]))
            left[var] = apart[part[var]]
            z[var] = new[var]
            go = apart[part[var]] >= near
            if not go.any():
                break
            if not go.all():  # the settled parts keep their values
                rule, var, coef, u = rule[go], var[go], coef[go], u[go]
                kept, rule = np.unique(rule, return_inverse=True)
                d, gain = d[kept], gain[kept]
        return z, left


def name_likeness(a: list[str], a_cut: list[str], b: list[str]) -> float:
    """1 for the same own words in any order, less for each edit, 0 beyond two edits a word; words cut off or run together count as edits."""
    if not a or not b:
        return 0.0
    if len(a) != len(b):
        x, y = ("".join(sorted(a)), "".join(sorted(b))) if min(len(a), len(b)) > 1 else ("".join(a), "".join(b))
        e = min(distance(x, y), distance("".join(reversed(a)), y), distance(x, "".join(reversed(b))))
        if e <= 2:
            return 0.9 - 0.1 * e
        inside = sum(any(distance(p, q) <= 1 for q in a) for p in b) if len(a) > len(b) else sum(any(distance(p, q) <= 1 for q in b) for p in a)
        return 0.8 if inside >= 2 else 0.0

    def word(p: str, q: str) -> float:
        if p in a_cut and len(p) > 2 and (q.startswith(p) or distance(p, q[: len(p)], 1) <= 1):
            return 0.95
        e = distance(p, q)
        return 1.0 if e == 0 else 0.93 if e == 1 else 0.85 if e == 2 and min(len(p), len(q)) > 4 else 0.0

    def pairing(p: list[str], q: list[str]) -> float:
        s = [word(x, y) for x, y in zip(p, q)]
        return min(s) * (sum(s) / len(s)) if min(s) > 0 else 0.0

    return max(pairing(a, b), pairing(a, b[::-1]) if len(a) == 2 else 0.0)


def _place(pa_: str, pb: str, ra: str, rb: str) -> tuple[float, float]:
    """How far two places agree, and how far they conflict."""
    agree = conflict = 0.0
    if pa_ and pb:
        if pa_ == pb:
            agree = 1.0
        elif len(min(pa_, pb, key=len)) < 5 and (pb.startswith(pa_) or pa_.startswith(pb)):
            agree = 0.8
        elif distance(pa_, pb, 1) <= 1:
            agree = 0.7
        else:
            conflict = 1.0
    if ra and rb:
        if ra == rb:
            agree, conflict = max(agree, 0.8), conflict * 0.5
        elif ra.startswith(rb) or rb.startswith(ra):
            agree, conflict = max(agree, 0.6), conflict * 0.7
        else:
            conflict = 1.0 if not agree else 0.0
            agree = agree if agree > 0.65 else 0.0
    return agree, conflict


def _codes(a: list[str] | None, b: list[str] | None) -> tuple[float, float]:
    if not a or not b:
        return 0.0, 0.0
    both = len(set(a) & set(b))
    part = both / min(len(set(a)), len(set(b)))
    return part, 1.0 if not both else 0.5 if part < 0.5 else 0.0


def rules_of(r: dict, weights: Weights) -> list[float]:
    """The ground rules of one candidate pair by itself: (direction, distance, weight) of each, one after the other."""
    c = parse(r["c_name"])
    likeness, kind, clash = 0.0, 0.0, 0.0
    for text in sorted({r["name"], r["legal_name"]} - {None, ""}):
        o = parse(text)
        if not o.core:
            continue
        s = name_likeness(o.core, o.cut, c.core) * (1.0 if same_given(o.given, c.given) else 0.0)
        ok, oc = set(o.kind.split()), set(c.kind.split())
        k = 1.0 if ok == oc else 0.7 if not ok or not oc or ok < oc or oc < ok else 0.0
        if o.legal and c.legal and o.legal != c.legal:
            k = min(k, 0.3)
        if (s, k) > (likeness, kind):
            likeness, kind = s, k
        clash = max(clash, 1.0 if k == 0 else 0.0)
    clash = 0.0 if kind > 0 else clash
    place, away = _place(r["pc"], r["c_pc"], r["region"], r["c_region"])
    codes, other = _codes(r["codes"], r["c_codes"])
    exact = 1.0 if r["pc"] and r["pc"] == r["c_pc"] else 0.0
    apart = bool(r["category"] and r["c_category"]) and r["category"] != r["c_category"] and (r["category"] in PUBLIC or r["c_category"] in PUBLIC)
    match = [
        (likeness + kind - 1, weights.name), (likeness + kind + place - 2, weights.name_place), (likeness + kind + codes - 2, weights.name_codes),
        (likeness + kind - 1 - max(away, other), weights.nothing_against),
        # Another name at the very same place with the same kind and no other codes: renamed.
        ((kind == 1.0 and bool(c.kind or c.given)) + exact + max(codes, 0.9 * (not other)) - 2, weights.renamed),
    ]
    no_match = [
        (1.0, weights.prior), (clash, weights.kind_conflict), (away + other - 1 if likeness or not exact else 0.0, weights.elsewhere),
        (1.0 if not likeness and not (exact and kind == 1.0) else 0.0, weights.no_reason), (1.0 if apart else 0.0, weights.category_conflict), (1.0 if r["scheme_conflict"] else 0.0, weights.scheme_conflict),
    ]
    return [x for body, w in match if body > 0 for x in (-1.0, body, w)] + [x for body, w in no_match if body > 0 for x in (1.0, body - 1, w)]


def _grounded(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rules_of(r, weights) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("obs_id", "org_no", "c_key", "sib")), pa.array(rows, pa.list_(pa.float64()))], names=["obs_id", "org_no", "c_key", "sib", "rules"])

    return run


def solve_block(rows: list[tuple[int, str, list[float], float | None]], together: float) -> tuple[np.ndarray, np.ndarray]:
    """Confidence and residual of candidate pairs (observation, organisation, rules, where its siblings want it or None)."""
    g = Ground()
    part = np.unique([r[0] for r in rows], return_inverse=True)[1]
    by_obs: dict[int, dict[str, list[int]]] = {}
    for v, (obs, org, rules, want) in enumerate(rows):
        by_obs.setdefault(obs, {}).setdefault(org, []).append(v)
        for i in range(0, len(rules), 3):
            g.add([(v, rules[i])], rules[i + 1], rules[i + 2])
        if want is not None:
            g.add([(v, 1.0)], -want, together)
            g.add([(v, -1.0)], want, together)
    for orgs in by_obs.values():
        if len(orgs) > 1:  # an observation is one organisation
            g.add([(v, 1.0 / len(vs)) for vs in orgs.values() for v in vs], -1.0)
        for vs in orgs.values():  # rows of one organisation match alike
            for a, b in zip(vs, vs[1:]):
                g.add([(a, 1.0), (b, -1.0)], 0.0)
                g.add([(a, -1.0), (b, 1.0)], 0.0)
    return g.solve(part)


def _solved(together: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            x, left = solve_block([(r[0], r[2], r[4], r[5]) for r in rows], together)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(x), pa.array(left)], names=["obs_id", "org_no", "x", "residual"])

        rows: list[tuple] = []
        n, last = 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("obs_id", "org_no", "c_key", "sib", "rules", "want"))):
                if r[0] != last:
                    last, n = r[0], n + 1
                    if n > BLOCK:
                        yield out(rows)
                        rows, n = [], 1
                rows.append(r)
        if rows:
            yield out(rows)

    return run


def _solve(ground: DataFrame, together: float) -> DataFrame:
    """`obs_id, org_no, x, residual`: every observation's own problem, observations dealt out whole."""
    d = ground.repartition(tasks(ground.sparkSession), "obs_id").sortWithinPartitions("obs_id", "org_no")
    return d.mapInArrow(_solved(together), "obs_id long, org_no long, x double, residual double")


def siblings(obs: DataFrame) -> DataFrame:
    """`obs_id, sib`: observations at one whole postcode of one kind of organisation, for these two tell the organisations of a place apart."""
    named = obs.where((F.length("pc") >= 5) & F.col("name").isNotNull()).select(F.col("obs_id").alias("id"), "name", F.lit(1).cast("long").alias("n"))
    kinds = spelling.parse_names(named).where("kind <> ''").select(F.col("id").alias("obs_id"), "kind").dropDuplicates(["obs_id"])
    d = kinds.join(obs.select("obs_id", "pc").dropDuplicates(["obs_id"]), "obs_id").select("obs_id", F.xxhash64("pc", "kind").alias("sib"))
    several = d.groupBy("sib").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("sib")
    return d.join(several, "sib", "left_semi").select("obs_id", "sib")


def agree(ground: DataFrame, first: DataFrame, weights: Weights, rounds: int = ROUNDS, near: float = SETTLED) -> DataFrame:
    """`obs_id, org_no, x, residual` of siblings whose problems are solved together.

    Each round every observation solves its own problem with its values drawn to the siblings' common ones (less its multiplier); the
    common value of a sibling class and an organisation becomes the mean of the members' values and multipliers, by one aggregation; the
    multipliers gather what is left. A class is done, by itself, when none of its values is further than `near` from the common one, or
    after `rounds`; what is left then is in `residual`.
    """
    now = first.join(ground.select("obs_id", "org_no", "sib"), ["obs_id", "org_no"]).withColumn("u", F.lit(0.0))
    done = None
    for k in range(rounds + 1):
        # Classes stand together, so the common values need no join: one shuffle a round instead of four and two broadcasts.
        state = now.repartition("sib").withColumn("z", F.avg(F.col("x") + F.col("u")).over(W.partitionBy("sib", "org_no")))
        state = state.withColumn("off", F.abs(F.col("x") - F.col("z"))).withColumn("u", F.col("u") + F.col("x") - F.col("z"))
        state = cut(state.withColumn("most", F.max("off").over(W.partitionBy("sib"))))
        settled = state if k == rounds else state.where(F.col("most") < near)
        settled = settled.select("obs_id", "org_no", F.greatest("residual", "off").alias("residual"), F.col("z").alias("x"))
        done = settled if done is None else done.unionByName(settled)
        go = state.where(F.col("most") >= near)
        if k == rounds or not go.take(1):
            break
        mine = go.select("obs_id", "org_no", (F.col("z") - F.col("u")).alias("want"), "u", "sib")
        solved = cut(_solve(ground.drop("sib").join(mine.select("obs_id", "org_no", "want", "sib"), ["obs_id", "org_no"]), weights.together))
        now = solved.join(mine.drop("want"), ["obs_id", "org_no"])
    return done.select("obs_id", "org_no", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x")).alias("x"), "residual")


def _clean(c: Column) -> Column:
    return F.when(is_stand_in(c), F.lit(None)).otherwise(c)


def _code_list(c: Column) -> Column:
    return F.array_distinct(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")))


def register_side(orgs: DataFrame) -> DataFrame:
    """`org_no, c_name, c_key, c_pc, c_region, c_codes, c_category`."""
    return orgs.where("org_no is not null").select(
        F.col("org_no").cast("long").alias("org_no"), F.coalesce(_clean(F.col("canonical_name")), _clean(F.col("norm_name"))).alias("c_name"),
        F.coalesce(loose_key(F.col("canonical_id")), F.col("org_no").cast("string")).alias("c_key"), F.coalesce(loose_key(F.col("postal_code")), F.lit("")).alias("c_pc"),
        F.coalesce(loose_key(_clean(F.col("address_region"))), F.lit("")).alias("c_region"), _code_list(F.col("cpv2")).alias("c_codes"), F.coalesce(F.lower(F.trim(_clean(F.col("org_category")))), F.lit("")).alias("c_category"),
    )


def observed_side(obs: DataFrame) -> DataFrame:
    """`obs_id, name, legal_name, pc, region, codes, category`."""
    return obs.where("obs_id is not null").select(
        F.col("obs_id").cast("long").alias("obs_id"), F.coalesce(_clean(F.col("name")), _clean(F.col("norm_name"))).alias("name"), _clean(F.col("identifier_legal_name")).alias("legal_name"),
        F.coalesce(loose_key(F.col("postal_code")), F.lit("")).alias("pc"), F.coalesce(loose_key(_clean(F.col("address_region"))), F.lit("")).alias("region"), _code_list(F.col("cpv2")).alias("codes"), F.coalesce(F.lower(F.trim(_clean(F.col("org_category")))), F.lit("")).alias("category"),
    )


def candidates(obs: DataFrame, orgs: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """`obs_id, org_no` that share their own words (any number; as spelt, misspelt, cut off or run together), a whole postcode and kind (as far as they tell one), or are given as a pair."""
    texts = obs.select("obs_id", F.explode(F.array("name", "legal_name")).alias("name")).where("name is not null").distinct()
    o = cut(spelling.parse_names(cut(texts.select(F.col("obs_id").alias("id"), "name", F.lit(1).cast("long").alias("n")))))
    c = cut(spelling.parse_names(orgs.select(F.col("org_no").alias("id"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("n")).where("name is not null")))
    known = c.select(F.explode("core").alias("word")).distinct()
    asked = o.select(F.explode("core").alias("word"), "cut").select("word", F.array_contains("cut", F.col("word")).alias("short")).groupBy("word").agg(F.max("short").alias("short"))
    roles = known.withColumn("index", F.lit(True)).join(asked.withColumn("asked", F.lit(True)), "word", "full")
    # A word that the register has may still be another one misspelt, so every word of four letters or more is looked up.
    roles = roles.select(
        "word", F.coalesce("index", F.lit(False)).alias("index"), (F.col("asked").isNotNull() & (F.length("word") > 3)).alias("query"),
        (F.coalesce("short", F.lit(False)) & (F.length("word") > 2)).alias("short"),
    )
    near = spelling.trie_join(cut(roles)).groupBy("word").agg(F.collect_list(F.struct("target", "edits")).alias("near"))
    per = o.select("id", F.explode("core").alias("word")).distinct().join(near, "word").groupBy("id").agg(F.collect_list(F.struct("word", "near")).alias("near"))
    keys = o.select("id", "core").join(per, "id", "left").select("id", "core", "near").mapInArrow(spelling._keyed, "id long, key string, edits int")
    # Two words that the register writes as one; of register names of more than two words also every two, as an observation may leave out one.
    joined = o.where(F.size("core") == 2).select("id", F.explode(F.array(F.array_join("core", ""), F.array_join(F.reverse("core"), ""))).alias("key"))
    every_two = F.flatten(F.transform("core", lambda x, i: F.transform(F.slice("core", i + 2, F.size("core")), lambda y: F.concat_ws(" ", x, y))))
    whole = c.select(F.col("id").alias("org_no"), F.explode(F.concat(F.array(F.array_join("core", " ")), F.when(F.size("core") > 2, every_two).otherwise(F.array().cast("array<string>")))).alias("key"))
    by_name = keys.select("id", "key").unionByName(joined).join(whole, "key").select(F.col("id").alias("obs_id"), "org_no")
    # At one place only a name of the same kind can be another one of the organisation; a name without kind may be any.
    place = lambda d, key, pc, kinds: d.where(F.length(pc) >= 5).select(key, F.col(pc).alias("pc")).join(kinds.select(F.col("id").alias(key), "kind").distinct(), key, "left").select(key, "pc", F.coalesce("kind", F.lit("")).alias("kind"))
    here, there = cut(place(obs, "obs_id", "pc", o)), cut(place(orgs, "org_no", "c_pc", c))
    bare = lambda d: d.where("kind = ''").drop("kind")
    kind_of = lambda d: d.where("kind <> ''")
    by_place = here.join(there, ["pc", "kind"]).select("obs_id", "org_no")
    by_place = by_place.unionByName(bare(here).join(kind_of(there), "pc").select("obs_id", "org_no")).unionByName(kind_of(here).join(bare(there), "pc").select("obs_id", "org_no"))
    out = by_name.unionByName(by_place)
    if pairs is not None:
        out = out.unionByName(pairs.select("obs_id", "org_no"))
    return out.distinct()


def link(obs: DataFrame, orgs: DataFrame, pairs: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """`obs_id, org_no, confidence, residual` of every candidate pair.

    Rules weigh likeness of names, kind of organisation, place and codes; an observation is at most one organisation (rows with one
    canonical_id are one), and rows of one organisation match alike. Observations are dealt out to tasks whole and solved there; siblings
    (one whole postcode and one kind) are drawn to common values that a shuffle a round exchanges (`agree`), and an organisation that a
    class believes in becomes a candidate of all its members. Observations without siblings are solved once. `residual` is what is left of
    the variables' disagreement. Missing attributes are no evidence either way; a row without name and postcode is in no pair unless one is
    given. Null ids are no rows, repeated rows are judged alike, empty tables give an empty result. Attributes of a given pair (scheme
    conflict) count a little; its other columns are derived from the rows.
    """
    o, c = observed_side(obs).dropDuplicates(["obs_id"]), register_side(orgs).dropDuplicates(["org_no"])
    given = None
    if pairs is not None:
        given = pairs.select(F.col("entity_a_id").cast("long").alias("obs_id"), F.col("entity_b_id").cast("long").alias("org_no"), "official_scheme_conflict")
        given = given.groupBy("obs_id", "org_no").agg(F.max(F.coalesce("official_scheme_conflict", F.lit(False))).alias("scheme_conflict"))
    sib = cut(siblings(o))

    def grounded(cand: DataFrame) -> DataFrame:
        rows = cand.join(o, "obs_id").join(c, "org_no").join(sib, "obs_id", "left")
        rows = rows.join(given, ["obs_id", "org_no"], "left") if given is not None else rows.withColumn("scheme_conflict", F.lit(False))
        return cut(rows.repartition(tasks(obs.sparkSession), "obs_id").mapInArrow(_grounded(weights), "obs_id long, org_no long, c_key string, sib long, rules array<double>"))

    cand = cut(candidates(o, c, given))
    ground = grounded(cand)
    alone = cut(_solve(ground.withColumn("want", F.lit(None).cast("double")), weights.together))
    final = lambda d: d.select("obs_id", "org_no", F.round("x", 3).alias("confidence"), "residual")
    in_class = ground.where("sib is not null")
    members = sib.groupBy("sib").agg(F.count(F.lit(1)).alias("k"))
    believed = alone.join(in_class.select("obs_id", "org_no", "sib"), ["obs_id", "org_no"]).groupBy("sib", "org_no").agg(F.sum("x").alias("x"))
    believed = believed.join(members, "sib").where(F.col("x") >= CARRIED * F.col("k")).select("sib", "org_no")
    more = cut(sib.join(believed, "sib").select("obs_id", "org_no").join(cand, ["obs_id", "org_no"], "left_anti"))
    carried = grounded(more)
    ground2 = in_class.unionByName(carried)
    # Of the new candidates the own problem is solved with those of their observation.
    start = alone.select("obs_id", "org_no", "x", "residual").unionByName(carried.select("obs_id", "org_no", F.lit(0.0).alias("x"), F.lit(0.0).alias("residual")))
    joint = agree(ground2, start, weights)
    return final(alone.join(sib, "obs_id", "left_anti")).unionByName(final(joint))


def matches(obs: DataFrame, orgs: DataFrame, pairs: DataFrame | None = None, least: float = MATCH) -> DataFrame:
    """`obs_id, org_no, confidence` of the pairs that are matches."""
    return link(obs, orgs, pairs).where(F.col("confidence") >= least).select("obs_id", "org_no", "confidence")
