"""Releases, graph build, files, small tables and streams on authored fixtures."""

import gzip
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.sources import files, releases, tsv
from quillgraph.streaming import latest


def release(ocid="o1", date="2024-03-01T00:00:00Z", **more):
    r = {
        "ocid": ocid, "id": f"{ocid}-1", "date": date, "buyer": {"id": "GB-NIC-1", "name": "A Council"},
        "parties": [{"id": "GB-NIC-1", "name": "A Council", "roles": ["buyer"], "address": {"region": "UKI"}}, {"id": "GB-COH-7", "name": "B Ltd", "roles": ["supplier"], "identifier": {"scheme": "GB-COH", "id": "7"}}],
        "tender": {
            "title": "Chairs", "description": "Red chairs", "value": {"amount": 50, "currency": "GBP"}, "classification": {"id": "39000000", "description": "Furniture"}, "mainProcurementCategory": "goods",
            "contractPeriod": {"startDate": "2024-04-01", "endDate": "2024-05-01"},
            "lots": [{"id": "L1", "title": "Lot one", "awardCriteria": {"criteria": [{"type": "price", "name": "Price"}, {"type": "quality", "name": "Quality"}]}}, {"id": "L2", "title": "Lot two"}],
            "items": [{"id": "1", "relatedLot": "L1", "classification": {"id": "39110000"}}], "documents": [{"id": "d1", "documentType": "tenderNotice", "url": "https://x/1"}],
        },
        "awards": [{"id": "a1", "title": "Award", "value": {"amount": 0, "currency": "GBP"}, "suppliers": [{"id": "GB-COH-7", "name": "B Ltd"}, {"id": "GB-FTS-9", "name": "C"}], "relatedLots": ["L1"]}, {"id": "a2", "suppliers": [], "relatedLots": ["L7"]}],
        "contracts": [{"id": "c1", "awardID": "a2", "value": {"amountNet": 30}, "dateSigned": "2024-06-01"}], "bids": {"statistics": [{"measure": "bids", "value": 3, "relatedLot": "L1"}]},
    }
    return {**r, **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("releases")
    lines = [json.dumps(release()), "", "{broken", json.dumps(release("o2", date=None)), json.dumps(release("o3"))]
    with gzip.open(d / "2024.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    (d / "2025.jsonl").write_text(json.dumps(release(date="2025-01-01T00:00:00Z", tender={"title": "Newer", "value": {"amount": 9}})) + "\n")
    return str(d)


def test_reading_and_latest(spark, folder):
    r = releases.read_releases(spark, folder)
    assert sorted(x.ocid for x in r.collect()) == ["o1", "o1", "o3"]
    assert {x.source_file for x in releases.read_releases(spark, folder, [2025]).collect()} == {"2025"}
    last = {x.ocid: (x.tender.title, x.source_years, x.year) for x in releases.latest_releases(r).collect()}
    assert last == {"o1": ("Newer", "2024|2025", 2025), "o3": ("Chairs", "2024", 2024)}


def test_extraction(spark, folder):
    t = releases.extract(releases.latest_releases(releases.read_releases(spark, folder, [2024])).where("ocid = 'o1'"))
    awards = {a.award_id: a for a in t["awards"].collect()}
    assert awards["a1"].award_value_best_amount == 0 and awards["a1"].award_value_source == "award"  # zero is an amount
    assert awards["a2"].award_value_best_amount == 30 and awards["a2"].award_value_source == "contract" and awards["a2"].award_date_signed == "2024-06-01"
    assert [(x.lot_id, x.n_items, x.item_codes) for x in t["lots"].orderBy("lot_id").collect()] == [("L1", 1, "39110000"), ("L2", 0, "")]
    assert t["award_criteria"].count() == 2 and t["bid_stats"].first().value == 3 and t["documents"].count() == 1
    assert {x.field_path for x in t["text_evidence"].collect()} == {"tender.title", "tender.description", "tender.lots[].title", "tender.lots[].awardCriteria"}
    assert sorted(x.raw_id for x in t["party_observations"].collect()) == ["GB-COH-7", "GB-FTS-9", "GB-NIC-1"]
    assert t["tender_core"].first().buyer_name == "A Council"


def graph(spark, folder):
    t = releases.extract(releases.latest_releases(releases.read_releases(spark, folder, [2024])).where("ocid = 'o1'"))
    orgs = spark.createDataFrame([("GB-NIC-1", "A Council", "UKI", '["UKI"]', 1), ("GB-COH-7", "B Ltd", "", "[]", 2), ("GB-COH-7", "B Limited", "UKJ", "bad", 1)], "canonical_id string, canonical_name string, address_region string, address_regions string, n_aliases int")
    aliases = spark.createDataFrame([("GB-NIC-1", "GB-NIC-1"), ("GB-COH-7", "GB-COH-7"), ("GB-FTS-9", "GB-COH-7")], "raw_id string, canonical_id string")
    return G.build(t, orgs, aliases)


def test_graph(spark, folder):
    g = graph(spark, folder)
    assert {r.contract_node_id: r.value_is_additive for r in g["contract_nodes"].collect()} == {"contract:o1:a1": True, "contract:o1:a2": True}
    assert g["contract_nodes"].first().contract_duration_days == 30
    org = {r.canonical_id: r for r in g["org_nodes"].collect()}
    assert org["GB-NIC-1"].is_buyer and org["GB-NIC-1"].buyer_additive_value_sum == 30.0 and org["GB-COH-7"].canonical_name == "B Ltd"
    assert [r.raw_id for r in g["supplier_of"].collect()] == ['["GB-COH-7","GB-FTS-9"]']
    scopes = {(r.match_scope) for r in g["evidence_for"].collect()}
    assert scopes == {"lot", "ocid", "ocid_fallback"}
    assert g["cpv_nodes"].first().cpv2 == "39" and g["cpv_nodes"].first().contract_count == 2
    assert {r.status for r in G.integrity(g).collect()} <= {"PASS", "WARN"}


def in_rows(spark, folder):
    """The latest release, and the graph's aliases."""
    r = releases.latest_releases(releases.read_releases(spark, folder, [2024])).where("ocid = 'o1'")
    return r, spark.createDataFrame([("GB-NIC-1", "GB-NIC-1"), ("GB-COH-7", "GB-COH-7"), ("GB-FTS-9", "GB-COH-7")], "raw_id string, canonical_id string")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_buyer_edges_in_rows(spark, folder):
    r, aliases = in_rows(spark, folder)
    columns = ["edge_id", "canonical_id", "contract_node_id", "raw_id", "ocid"]
    made = G.buyer_edges_of(r.select("ocid", F.col("buyer.id").alias("raw_id"), G.award_ids().alias("award_ids")), aliases)
    assert rows_of(made, *columns) == rows_of(graph(spark, folder)["buyer_of"], *columns) != []


def test_supplier_edges_in_rows(spark, folder):
    r, aliases = in_rows(spark, folder)
    columns = ["edge_id", "canonical_id", "contract_node_id", "raw_id", "ocid"]
    made = G.supplier_edges_of(r.select("ocid", F.inline(G.award_suppliers())), aliases)
    assert rows_of(made, *columns) == rows_of(graph(spark, folder)["supplier_of"], *columns) != []


def test_organisations_in_rows(spark, folder):
    r, aliases = in_rows(spark, folder)
    old = graph(spark, folder)["org_nodes"]
    orgs = old.select("canonical_id", "canonical_name", "address_region", "address_regions", "n_aliases").withColumn("address_regions", F.to_json("address_regions"))
    made = G.enriched_orgs_of(r.select("ocid", "year", F.col("buyer.id").alias("buyer_raw_id"), G.award_values().alias("values")), orgs, aliases)
    columns = ["canonical_id", "is_buyer", "is_supplier", "buyer_contract_count", "supplier_contract_count", "buyer_additive_value_sum", "supplier_additive_value_sum", "first_activity_year", "last_activity_year"]
    assert rows_of(made, *columns) == rows_of(old, *columns) != []


def test_codes_in_rows(spark, folder):
    r, _ = in_rows(spark, folder)
    c = F.col("tender.classification")
    made = G.enriched_codes_of(r.select("year", c["id"].alias("tender_cpv_id"), releases.blank(c["description"]).alias("tender_cpv_description"), F.size(G.award_ids()).alias("n_contracts"), G.additive_total().alias("total")))
    columns = ["cpv_code", "description", "cpv2", "n_rows", "contract_count", "additive_value_sum", "first_year", "last_year"]
    assert rows_of(made, *columns) == rows_of(graph(spark, folder)["cpv_nodes"], *columns) != []


def test_evidence_in_rows(spark, folder):
    r, _ = in_rows(spark, folder)
    made = G.named(r.select("ocid", F.inline(G.award_evidence())))
    old = graph(spark, folder)["evidence_for"].groupBy("contract_node_id", "match_scope").agg(F.count(F.lit(1)).alias("n"))
    assert rows_of(made, "contract_node_id", "match_scope", "n") == rows_of(old, "contract_node_id", "match_scope", "n") != []


def checks_both_ways(spark, lines, aliases):
    """The graph's checks of its tables, and those told in the releases."""
    r = releases.latest_releases(releases.parse_lines(spark.createDataFrame([(json.dumps(x), "f") for x in lines], "value string, source_file string")))
    orgs = spark.createDataFrame([("GB-NIC-1", "A Council", "UKI", '["UKI"]', 1), ("GB-COH-7", "B Ltd", "", "[]", 2)], "canonical_id string, canonical_name string, address_region string, address_regions string, n_aliases int")
    aliases = spark.createDataFrame(aliases, "raw_id string, canonical_id string")
    assert G.tellable(aliases)
    asked = r.select("ocid", releases.blank(F.col("buyer.id")).alias("buyer_raw_id"), releases.blank(F.col("tender.classification.id")).alias("tender_cpv_id"), G.text_ids().alias("text_ids"), G.checked().alias("checked"))
    columns = ["area", "name", "status", "n_bad"]
    made = G.integrity_of(asked, orgs, aliases)
    return rows_of(G.integrity(G.build(releases.extract(r), orgs, aliases)), *columns), rows_of(made, *columns), made


def test_checks_are_told_in_rows(spark):
    one = lambda i, *s: {"id": i, "suppliers": [{"id": x} for x in s]}
    lines = [
        release(), release("o2", awards=[one("a1", "GB-COH-7"), one("a2", "stranger"), one("a3"), one("a4", "lost")], buyer={"id": "lost"}), release("o3", awards=None, tender=None, buyer=None),
        # Two nodes of one award, and ids that only look alike because a colon stands in them.
        release("o4", awards=[{**one("b", "GB-COH-7"), "title": "x"}, {**one("b", "GB-FTS-9"), "title": "y"}]), release("o5:x", awards=[one("a", "GB-COH-7")]), release("o5", awards=[one("x:a", "GB-COH-7")]), release("o6", awards=[one("x:a")], tender={"title": "t"}),
    ]
    old, new, _ = checks_both_ways(spark, lines, [("GB-NIC-1", "GB-NIC-1"), ("GB-COH-7", "GB-COH-7"), ("GB-FTS-9", "GB-COH-7"), ("lost", "nobody"), ("lost", "GB-COH-7"), ("lost", "GB-COH-7")])
    assert new == old
    assert {(a, n): k for a, n, _, k in new if k} == {
        ("buyer_of", "edge_id is unique"): 1, ("buyer_of", "organisation exists"): 4, ("categorized_by", "edge_id is unique"): 2, ("contract_nodes", "contract_node_id is unique"): 2, ("contract_nodes", "has a supplier"): 4,
        ("supplier_of", "edge_id is unique"): 1, ("supplier_of", "organisation exists"): 1,
    }
    ids = spark.createDataFrame([("GB-NIC:1",), ("contractor",), ("a:contract:b",), (None,)], "canonical_id string")
    assert G.tellable(ids.where("canonical_id = 'GB-NIC:1'")) and [G.tellable(ids.where(w)) for w in ("canonical_id = 'contractor'", "canonical_id like 'a:%'", "canonical_id is null")] == [False] * 3


def test_integrity_keeps_no_table_of_the_graph(spark, monkeypatch):
    from quillgraph.plans import catalogue_graph as C

    monkeypatch.setattr(C, "cut", lambda df: pytest.fail("a table is kept"))
    d = C.graph_integrity(spark, "/root/testdata/sf0.001")
    assert len(d.collect()) == 16 and {(r.status, r.n_bad) for r in d.collect()} == {("PASS", 0)}


def test_broken_ends_fail_and_stop_the_write(spark, folder, tmp_path):
    g = graph(spark, folder)
    g["supplier_of"] = g["supplier_of"].withColumn("canonical_id", F.lit("nobody"))
    bad = {r.name for r in G.integrity(g).where("status = 'FAIL'").collect()}
    assert bad == {"organisation exists"}
    with pytest.raises(files.Refused):
        files.write_checked(g, G.integrity(g), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    tender = g["contract_nodes"].withColumns({"value_source": F.lit("tender"), "value_is_additive": F.lit(True)})
    assert G.integrity({**g, "contract_nodes": tender}).where("name = 'tender values are not additive' and status = 'FAIL'").count() == 1


def test_files(spark, tmp_path):
    log = str(tmp_path / "log")
    todo = spark.range(5).select("id")
    schema = "id long, done boolean"
    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("done", F.lit(True))

    assert files.resume(todo.where("id < 3"), log, "id", work, schema).count() == 3
    assert files.resume(todo, log, "id", work, schema).count() == 5
    assert seen == [3, 2]
    assert files.output_target(spark, log, partial=True).endswith("-partial")
    with pytest.raises(files.Refused):
        files.output_target(spark, log, partial=False)
    a, b = spark.createDataFrame([(1, "old"), (2, "x")], "k int, v string"), spark.createDataFrame([(1, "new")], "k int, v string")
    assert sorted(map(tuple, files.last_writer([a, b], "k").collect())) == [(1, "new"), (2, "x")]
    files.write_csv(a, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_small_tables(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("Year\tNo.\tScore\tName\tName\n2001\t1,200\t5-14 (29)\tAda (UK)\tx\\ny\n2002\t£30\t6-7\tBob (US)\t\n2003\t5%\t7-1\tCid\ta\\\\nb\\nc\n")
    df = tsv.read_tsv(spark, str(p))
    assert df.where("row_no = 2").first().name_2 == "a\\nb\nc"
    assert df.columns == ["row_no", "year", "no", "score", "name", "name_2"] and df.where("row_no = 0").first().name_2 == "x\ny"
    t = tsv.typed(df)
    assert [r.no for r in t.orderBy("row_no").collect()] == [1200.0, 30.0, 5.0]
    assert "score__part_1" in t.columns and "name__noparen" in t.columns and t.where("row_no = 0").first().name__noparen == "Ada"
    p.write_text("a\tb\n1\n")
    with pytest.raises(ValueError):
        tsv.read_tsv(spark, str(p))


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, "a", t), (2, "a", t + timedelta(minutes=5)), (1, "a", t), (3, "b", t + timedelta(hours=2))]
    src, target = str(tmp_path / "in"), str(tmp_path / "latest")
    spark.createDataFrame(rows, "event_id long, user string, ts timestamp").coalesce(1).write.parquet(src)
    stream = lambda: latest.read_event_stream(spark, src, "event_id long, user string, ts timestamp")
    latest.run_once(latest.keep_latest(stream(), "user", "ts", target, str(tmp_path / "c1")), spark)
    spark.createDataFrame([(9, "a", t + timedelta(days=1))], "event_id long, user string, ts timestamp").write.mode("append").parquet(src)
    latest.run_once(latest.keep_latest(stream(), "user", "ts", target, str(tmp_path / "c1")), spark)
    assert sorted((r.user, r.event_id) for r in latest.latest_table(spark, target).collect()) == [("a", 9), ("b", 3)]
    d = latest.deduplicated(stream(), ["event_id"], "ts", "7 days").writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c2"))
    latest.run_once(d, spark)
    assert spark.table("dedup").count() == 4
    w = latest.windowed_counts(stream(), "ts", ["user"]).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3"))
    latest.run_once(w, spark)
    assert spark.table("win").where("user = 'a'").agg(F.sum("n")).first()[0] == 4


def test_caches_and_settings(spark, tmp_path):
    from quillgraph.config import Settings

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_cache(df, str(tmp_path / "cache"))
    assert sorted(map(tuple, files.read_cache(spark, str(tmp_path / "cache"), "k int, v string").collect())) == [(1, "a"), (2, None)]
    df.limit(1).write.mode("append").json(str(tmp_path / "cache" / "rows"))
    with pytest.raises(files.Refused):
        files.read_cache(spark, str(tmp_path / "cache"), "k int, v string")
    p = tmp_path / "s.yaml"
    p.write_text("# run\nraw_folder: here  # there\nyears: [2024, 2025]\nsimilarity: 0.9\npartial: true\n")
    assert Settings.read(str(p)) == Settings(raw_folder="here", years=(2024, 2025), similarity=0.9, partial=True)
    p.write_text("nope: 1\n")
    with pytest.raises(ValueError):
        Settings.read(str(p))
    p.write_text("paths:\n  raw_folder: here\n  graph_folder: 'there'\nyears:\n  - 2024\n  - 2025\nchunk:\n  words: 300\n  # note\n  overlap: 30\n")
    assert Settings.read(str(p)) == Settings(raw_folder="here", graph_folder="there", years=(2024, 2025), chunk_words=300, chunk_overlap=30)


def shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    return final.count("Exchange hashpartitioning"), final.count("Join")


def test_choice_is_one_shuffle_of_what_is_asked_for(spark, folder):
    r = releases.read_releases(spark, folder)
    assert shuffles(releases.latest_releases(r.select("ocid", "id", "date", "source_file"))) == (1, 0)
    rows = [("o", "b", "2024", "f2"), ("o", "a", "2024", "f2"), ("o", "c", "2024-1", "f3"), ("o", "d", "2024-1", "f2"), ("o", "z", "20", "f1")]
    last = releases.latest_releases(spark.createDataFrame(rows, "ocid string, id string, date string, source_file string")).first()
    assert (last.id, last.date, last.source_years, last.year) == ("d", "2024-1", "f1|f2|f3", 2024)


def test_awards_look_up_their_contracts_in_the_release(spark, folder):
    contracts = [{"id": "c2", "awardID": "a1", "dateSigned": "2024-02-02", "value": {"amount": 2}}, {"id": "c1", "awardID": "a1"}, {"id": "c1", "awardID": "a1"}, {"id": "c0", "awardID": " "}, {"id": "c9", "awardID": "a3", "value": {"amount": 7}}]
    lines = spark.createDataFrame([(json.dumps(release(contracts=contracts, awards=[{"id": "a1"}, {"id": "a1"}, {"id": "a3"}, {}])), "f"), (json.dumps(release("o2", awards=None)), "f")], "value string, source_file string")
    latest_ = releases.latest_releases(releases.parse_lines(lines))
    d = releases.awards(latest_)
    assert sorted((x.award_id, x.contract_id, x.award_value_best_amount, x.award_value_source, x.award_date_signed, x.n_contracts) for x in d.collect()) == [
        ("", "", 50.0, "tender", "", 0), ("a1", "c1", 2.0, "contract", "2024-02-02", 2), ("a1", "c1", 2.0, "contract", "2024-02-02", 2), ("a3", "c9", 7.0, "contract", "", 1),
    ]
    assert shuffles(d) == (1, 0)  # that of the choice


def test_parties_are_told_in_the_release(spark):
    suppliers = [{"id": "S1", "name": "B"}, {"id": "S1", "name": "B"}, {"id": "P1", "name": "other"}, {"name": "no id"}]
    lines = spark.createDataFrame([(json.dumps(release(parties=[{"id": "P1", "roles": ["buyer"]}, {"name": "x"}], awards=[{"id": "a", "suppliers": suppliers}, {"id": "b"}])), "f"), (json.dumps(release("o2", parties=None, awards=[{"suppliers": suppliers[:1]}])), "f")], "value string, source_file string")
    d = releases.party_observations(releases.latest_releases(releases.parse_lines(lines)))
    assert sorted((x.ocid, x.raw_id, x.name, tuple(x.roles)) for x in d.collect()) == [("o1", "P1", "", ("buyer",)), ("o1", "S1", "B", ("supplier",)), ("o2", "S1", "B", ("supplier",))]
    assert shuffles(d) == (1, 0)


def test_a_snapshot_shuffles_the_choice_once(spark, folder):
    r = releases.read_releases(spark, folder).select("ocid", "id", "date", "source_file")
    d = releases.aligned_snapshot(r, releases.latest_releases(r))
    assert sorted((x.ocid, x.id) for x in d.collect()) == [("o1", "o1-1"), ("o3", "o3-1")]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
