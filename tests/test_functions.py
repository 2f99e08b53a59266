"""Names, identifiers, similarities, dates, resolution and documents."""

from datetime import date

from pyspark.sql import functions as F

from quillgraph.functions import dates as D
from quillgraph.functions import strings as S
from quillgraph.functions.text import is_blank, is_stand_in, loose_key
from quillgraph.operators import documents as docs
from quillgraph.operators import resolution as E


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_names(spark):
    raw = ["Ábc & Sons Ltd.", "The  Co", None, " ", "x-y LIMITED LIABILITY PARTNERSHIP", "Ltd Ltd"]
    assert col(spark, raw, S.norm_name) == ["ABC AND SONS LTD", "THE", "", "", "X Y", "LTD"]
    assert col(spark, ["CITY OF LEEDS COLLEGE", "ONE", ""], S.acronym) == ["COL", "", ""]
    assert col(spark, ["GB-COH-12-3", "GB-NHS-ab", "GB-FTS-1", "x", None], S.canonical_id) == ["GB-COH-12-3", "GB-NHS-AB", None, None, None]
    assert col(spark, ["GB-COH-12-3", "x"], S.value_of) == ["12-3", ""]
    assert [round(x, 4) for x in (S.jaro_winkler_of("MARTHA", "MARHTA"), S.jaro_winkler_of("DIXON", "DICKSONX"), S.jaro_winkler_of("", "a"))] == [0.9611, 0.8133, 0.0]
    assert col(spark, ['["UKJ", " UKJ1 "]', "bad", None], lambda c: F.array_join(S.region_set(F.lit("UKJ"), c), "|")) == ["UKJ|UKJ1", "UKJ", "UKJ"]
    assert col(spark, ["HTTP://Ex.Org/A/#x", "//ex.org", "ex.org/b/", " "], S.normalise_url) == ["http://ex.org/A", "https://ex.org", "https://ex.org/b", None]


def test_keys_and_stand_ins(spark):
    assert col(spark, ["gb a/1\xa0", "--", None, "é"], loose_key) == ["GBA1", None, None, "É"]
    assert col(spark, [None, "", "\xa0\t", "​", "x"], is_blank) == [True, True, True, True, False]
    assert col(spark, ["n/a", "N/A.", "XXXX", "--", "Unknown ", "not  known", "other", "Naylor", "xx1"], is_stand_in) == [True] * 6 + [False] * 3


def test_dates_and_amounts(spark):
    raw = ["2024-05-01T10:00:00Z", "1 May 2024", "01/05/2024", "May 1st, 2024", "soon", None]
    assert col(spark, raw, D.parsed_day) == [date(2024, 5, 1)] * 3 + [None if D.written_date("May 1st, 2024") is None else date(2024, 5, 1), None, None]
    assert col(spark, ["£1,200.50", "GBP 10 million", "3k", "-5", "none", None], D.amount) == [1200.5, 1e7, 3000.0, -5.0, None, None]
    assert D.written_date("May 1st, 2024") == D.written_date("1 May 2024") == "2024-05-01" and D.written_date("May") is None
    assert D.amount_of("GBP 10 million") == 1e7 and D.amount_of("x") is None
    assert col(spark, ["in 2020, 1999 and 20201"], lambda c: D.years_in(c)) == [[2020, 1999]]


def test_region_and_sets(spark):
    df = spark.createDataFrame([("UKJ1", "UKJ"), ("UKJ", "ukj"), ("", "UKJ"), ("UKJ", "UKK"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(S.region_relation(F.col("a"), F.col("b"))).collect()] == ["compatible_hierarchy", "same", "missing", "conflict", "missing"]
    assert col(spark, ["a b c d", "a b"], lambda c: S.shingles(c, 3)) == [["a b c", "b c d"], []]


def test_blocks_and_merges(spark):
    rows = [(1, "Alpha Beta Council", "UKJ"), (2, "ALPHA BETA COUNCIL", "UKJ"), (3, "Alpha Beta Counci", "UKK"), (4, "Zeta", ""), (5, None, "UKJ"), (6, "", "UKJ")]
    e = spark.createDataFrame(rows, "id long, name string, address_region string")
    found = {(r.a, r.b) for r in E.similar_pairs(e, "id", "name").collect()}
    assert found == {(1, 2), (1, 3), (2, 3)}
    named = E.rare_tokens(E.entity_columns(e, "id", "name"), "id")
    pairs = {(r.a, r.b): r.strategies for r in E.block_pairs(named, "id", E.standard_blocks()).collect()}
    assert "exact_norm_name" in pairs[1, 2] and "name_region" in pairs[1, 2] and "prefix3" in pairs[1, 3]
    tight = [E.Block("prefix3", F.substring("norm", 1, 3), 2)]
    # A block that is too large gives the links of its similar names, each name by its first row.
    assert {(r.a, r.b) for r in E.block_pairs(named, "id", tight).collect()} == {(1, 2), (1, 3)} and E.block_metrics(named, "id", tight).first().n_large == 1
    assert {(r.a, r.b) for r in E.similar_pairs(e, "id", "name", largest=2).collect()} == {(1, 2), (1, 3)}
    merged = {r.canonical_id: r.merged_id for r in E.name_region_merge(e, "id", "name").collect()}
    assert merged["1"] == merged["2"] != merged["3"] and merged["5"] == "5" and merged["6"] == "6"
    c = E.clusters(spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "a string, b string"))
    assert {r.node: r.component for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    ids = spark.createDataFrame([("a", "GB-COH", "1"), ("c", "GB-COH", "2")], "node string, scheme string, value string")
    no = spark.createDataFrame([("x", "y")], "a string, b string")
    assert {r.reason for r in E.merge_conflicts(c, ids, no).collect()} == {"two_official_ids", "rejected_pair"}
    m = E.apply_merges(spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "id string, rank int"), c.where("component = 'a'"), "id", [F.col("rank")])
    assert {r.old_id: r.new_id for r in m.collect()} == {"a": "b", "b": "b", "c": "b"}
    assert sorted(r.id for r in E.remap(spark.createDataFrame([("a",), ("q",)], "id string"), m, "id").collect()) == ["b", "q"]


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(1500))
    text = f"Intro line.\r\n\r\n\r\n\r\n1. Award criteria\nPrice  40\n2. Payment\n{long}"
    rows = docs.chunks(spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "plain")], "doc_id long, text string")).collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.heading for r in mine] == ["", "1. Award criteria", "2. Payment", "2. Payment", "2. Payment"]
    assert [r.n_words for r in mine[2:]] == [650, 650, 362] and {r.doc_id for r in rows} == {1, 4}
    assert mine[2].text.split()[-80:] == mine[3].text.split()[:80] and len({r.chunk_id for r in rows}) == len(rows)
    tidy = docs.tidy(text)
    assert tidy[mine[1].char_start :].startswith("1. Award criteria") and tidy[mine[1].char_start : mine[1].char_end].strip() == mine[1].text
    ranked = docs.rank_chunks(spark.createDataFrame([("a", "Payment", "pay terms"), ("b", "", "payment terms here"), ("c", "", "none")], "chunk_id string, heading string, text string"), ["payment", "terms"])
    assert [r.chunk_id for r in ranked.collect()] == ["a", "b"]


def test_large_blocks_give_all_similar_pairs(spark):
    rows = [(1, "Alpha Beta Council"), (2, "ALPHA BETA COUNCIL"), (3, "Alpha Beta Counci"), (4, "Alpha Beta Counci"), *((10 + i, f"Alp{chr(97 + i % 26) * 5}{chr(97 + i // 26) * 5} Zq") for i in range(60))]
    e = spark.createDataFrame(rows, "id long, name string")
    got = {(r.a, r.b): r.similarity for r in E.similar_pairs(e, "id", "name").collect()}
    norm = {r.id: r.n for r in e.select("id", S.norm_name(F.col("name")).alias("n")).collect()}
    want = {(a, b): round(S.jaro_winkler_of(norm[a], norm[b]), 4) for a in norm for b in norm if a < b and norm[a][:3] == norm[b][:3]}
    assert got == {k: v for k, v in want.items() if v >= 0.92}
    assert {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)} <= got.keys()
