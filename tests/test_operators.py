"""Components, skew-safe joins, relational helpers, quality checks and samplers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import quality as Q
from quillgraph.operators import relational as R
from quillgraph.operators import resolution as E
from quillgraph.operators.components import connected_components
from quillgraph.operators.skew import heavy_keys, lookup_join, ranked


def slow_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


@pytest.mark.parametrize("chunk", [1000, 7])
def test_components(spark, chunk):
    rng = random.Random(chunk)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None), *edges[:3]], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, chunk=chunk).collect()}
    assert got == slow_components(edges)


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_keys_are_salted(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(40)] + [(None, 1)], "k string, v long")
    right = spark.createDataFrame([("hot", "H"), ("k1", "A"), ("zzz", "Z")], "k string, x string")
    assert heavy_keys(left, "k", least=100) == ["hot"]
    for heavy in (["hot"], []):
        for how in ("left", "inner"):
            got = sorted(map(tuple, lookup_join(left, right, "k", how, heavy).select("k", "v", "x").collect()), key=str)
            assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "x").collect()), key=str)


def test_ranks_are_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, "b").alias("g"), "id")
    rows = ranked(df, ["g"], F.xxhash64("id")).collect()
    for g, n in (("hot", 900), ("b", 50), (None, 50)):
        assert sorted(r["__rank"] for r in rows if r.g == g) == list(range(1, n + 1))


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "l1"), (2, "a", "l9"), (3, "b", "l1")], "id long, o string, lot string")
    right = spark.createDataFrame([("a", "l1", "X"), ("a", "l2", "Y"), ("b", "l3", "Z")], "o string, lot string, c string")
    got = sorted((r.id, r.c, r.match_scope) for r in R.scoped_join(left, right, ["o", "lot"], ["o"]).collect())
    assert got == [(1, "X", "narrow"), (2, "X", "wide"), (2, "Y", "wide"), (3, "Z", "wide")]
    with pytest.raises(R.NotUnique):
        R.many_to_one(left, right, ["o"])
    n = R.aligned(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int"), "k", "v")
    assert sorted(map(tuple, n.collect())) == [("a", 1, 0), ("b", 0, 2)]
    assert tuple(R.set_difference_report(left, right, "o").first()) == (0, 0)


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), (None, 9, "n"), ("b", 1, "q")], "k string, t long, v string")
    assert sorted(r.v for r in R.first_per_key(df, ["k"], [F.desc("t"), F.col("v")]).collect()) == ["q", "y"]
    assert sorted(r.v for r in R.latest_per_key(df.where("k is not null"), ["k"], [F.col("t"), F.col("v")]).collect()) == ["q", "z"]


def test_divide_and_groupings(spark):
    df = spark.createDataFrame([("a", "x", True), ("a", "y", None), ("b", "x", True)], "k string, t string, ok boolean")
    assert [r.k for r in R.divide(df, "k", F.col("ok")).collect()] == ["b"]
    g = R.groupings(df, [["k"], ["t"], ["k", "t"]], [F.count(F.lit(1)).alias("n")])
    one = {(r.grouping, r.k, r.t): r.n for r in g.collect()}
    assert one == {("k", "a", None): 2, ("k", "b", None): 1, ("t", None, "x"): 2, ("t", None, "y"): 1, ("k+t", "a", "x"): 1, ("k+t", "a", "y"): 1, ("k+t", "b", "x"): 1}
    assert g.count() == 7


def test_samplers(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "big").otherwise("small").alias("s"))
    assert [r.s for r in R.round_robin(df, "s", [F.col("id")], 6).collect()].count("small") == 3
    counts = {r.s: r["count"] for r in R.stratified(df, ["s"], 0.1, R.hash_order("id")).groupBy("s").count().collect()}
    assert counts == {"big": 9, "small": 1}
    assert R.apportion({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert sum(R.apportion({"x": 0.5, "y": 0.3, "z": 0.2}, 7).values()) == 7
    assert R.mcnemar_p(0, 0) == 1.0 and abs(R.mcnemar_p(1, 9) - 0.021484375) < 1e-12
    assert R.hash_sample(df, "id", 1000).count() == 100


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "s string, n int")
    p = {r.column: (r.n_null, r.n_blank) for r in Q.profile(df).collect()}
    assert p == {"s": (1, 1), "n": (0, 0)}
    checks = Q.run_checks([Q.Check("t", "key", df, unique=("n",)), Q.Check("t", "filled", df, broken=F.col("s") == ""), Q.Check("t", "ref", df, refers=("s", df.where("n = 1"), "s"), warns=True)])
    assert {r.name: (r.status, r.n_bad) for r in checks.collect()} == {"key": ("PASS", 0), "filled": ("FAIL", 2), "ref": ("WARN", 2)}
    means = spark.createDataFrame([(f"k{i}", 10.0 + i, 1) for i in range(8)] + [("far", 1e6, 1)], "k string, total double, n int")
    assert [(r.key, r.side) for r in Q.outlier_fence(means, "k", "total", "n").collect()] == [("far", "high")]
    assert Q.outlier_fence(means.limit(3), "k", "total", "n").count() == 0
    assert sorted(r.row for r in Q.determines(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "row long, g string, v string"), ["g"], "v").collect()) == [3]


def test_large_blocks_keep_every_similar_pair(spark):
    import random

    from quillgraph.functions.strings import jaro_winkler_of
    from quillgraph.operators import resolution as E

    rng = random.Random(5)
    names = []
    for _ in range(120):
        base = rng.choice(names)[1] if names and rng.random() < 0.6 else " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 3)))
        x = list(base)
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = rng.choice("abcdeinorstz ")
        names.append((len(names), " ".join("".join(x).split()) or "a"))
    rows = spark.createDataFrame([("hot", i, n) for i, n in names], "block string, id long, norm string")
    got = {(r.a, r.b): r.similarity for r in E.similar_within(rows).collect()}
    low = {}
    for i, n in names:
        low.setdefault(n, i)
    want = {(low[n], i): 1.0 for i, n in names if low[n] != i}
    reps = sorted((i, n) for n, i in low.items())
    want |= {(i, j): round(s, 4) for i, n in reps for j, m in reps if i < j and round(s := jaro_winkler_of(n, m), 4) >= 0.92}
    assert got == want and len(want) > 20
    d = E.entity_columns(spark.createDataFrame([(i, n, "UKI") for i, n in names], "id long, name string, address_region string"), "id", "name")
    blocks = [E.Block("all", F.lit("x"), 10), E.Block("name", F.col("norm"), 10)]
    pairs = {(r.a, r.b) for r in E.block_pairs(d, "id", blocks).collect()}
    assert set(want) <= pairs
    assert E.block_pairs(d.limit(0), "id", blocks).count() == 0


def test_phases_of_resolution(spark):
    from quillgraph.operators import resolution as E

    p = [
        ("n1", "r1", "ALPHA", ["buyer"], "GB-COH", "7"), ("n1", "r2", "ALPHA", ["buyer"], "", ""), ("n2", "r3", "ALPHA", ["buyer"], None, None), ("n1", "r1", "ALPHA", ["buyer"], "XX", "9"),
        ("n3", "r4", "BETA", ["supplier"], "GB-COH", "1"), ("n3", "r5", "BETA", ["supplier"], "GB-COH", "2"), ("n3", "r6", "BETA", ["supplier"], None, "3"), ("n3", " ", "BETA", ["supplier"], None, None),
    ]
    got = {r.raw_id: (r.canonical_id, r.status) for r in E.phase_one(spark.createDataFrame(p, "ocid string, raw_id string, norm string, roles array<string>, scheme string, value string")).collect()}
    assert got == {"r1": ("GB-COH-7", "deterministic"), "r2": ("GB-COH-7", "role_alias"), "r3": ("r3", "singleton"), "r4": ("GB-COH-1", "deterministic"), "r5": ("GB-COH-2", "deterministic"), "r6": ("r6", "singleton")}
    aliases = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (5, 50)], "raw_id long, canonical_id long")
    mapping = spark.createDataFrame([(10, 20), (20, 30), (40, 50), (50, 40), (30, 30)], "old_id long, new_id long")
    now, log = E.remap_audited(aliases, mapping, "test")
    assert {tuple(r) for r in now.collect()} == {(1, 30), (2, 30), (3, 30), (4, 40), (5, 40)}
    assert {tuple(r) for r in log.collect()} == {(1, 10, 30, "test"), (2, 20, 30, "test"), (5, 50, 40, "test")}
    orgs = spark.createDataFrame([(1, "a", " Singleton "), (2, "A", "deterministic"), (3, None, "deterministic"), (4, "b", None)], "row_id long, id string, st string")
    assert {tuple(r) for r in E.consolidate(orgs, F.upper("id"), F.col("st"), ["deterministic", "singleton"]).collect()} == {("A", 2, "deterministic", 2), ("B", 4, None, 1)}


def test_contributors(spark):
    rows = [("a", 1.0), ("a", 0.5), ("b", 95.0), ("b", 5.0), ("b", None), ("c", None), ("d", 7.0), ("e", 50.0), ("e", 50.0)]
    got = {r.g: (r.n_values, r.share, r.nominal_only, r.dominated) for r in Q.contributors(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v")).collect()}
    assert got == {"a": (2, 0.6667, True, False), "b": (2, 0.95, False, True), "c": (0, None, False, False), "d": (1, 1.0, False, False), "e": (2, 0.5, False, False)}


def test_components_of_a_hub_with_the_largest_id(spark):
    edges = [(i, 10_000) for i in range(3000)] + [(20_000 + i, 20_001 + i) for i in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, chunk=400).collect()}
    assert got == slow_components(edges)


def test_tf_idf_counts_words_where_the_document_stands(spark):
    from quillgraph.operators import documents as D

    docs = spark.createDataFrame([(1, "red chairs red"), (2, "blue chairs"), (3, None), (4, "red"), (5, "tables")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Red chairs"), (2, "nothing here")], "query_id int, query string")
    d = D.tf_idf_top(docs, q, 5)
    found = [(r.query_id, r.doc_id, r["rank"]) for r in d.orderBy("rank").collect()]
    assert found == [(1, 1, 1), (1, 4, 2), (1, 2, 3)]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan  # the words of the documents are not shuffled
    twice = spark.createDataFrame([(1, "red chairs"), (1, "red"), (2, "blue chairs"), (3, None), (4, "red"), (5, "tables")], "doc_id long, text string")
    assert [r.doc_id for r in D.tf_idf_top(twice, q, 5).orderBy("rank").collect()] == [1, 4, 2]


def test_characters_of_names_are_never_broadcast(spark):
    rows = spark.createDataFrame([("nor", 1, "northern supplies"), ("nor", 2, "northern suplies"), ("nor", 3, "norfolk county")], "block string, id long, norm string")
    found = E.similar_within(rows)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and re.search(r"\bk#", x)]
    assert joins and all("strategy=merge" in x for x in joins)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]
