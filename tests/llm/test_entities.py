"""Spelling variants and linkage: the trie join against brute force, cases, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import linkage, names, orgnames


def test_name_parts():
    p = orgnames.parse
    full = p("Lamebeck Nenorigg College of Further Education")
    for other in ("Lamebeck Nenorigg FE College", "The Lamebeck/Nenorigg Coll. of Further Educ., Commercial Dept", "LAMEBECK NENORÏGG C0LLEGE OF FURTHER EDUCATION", "FE College of Nenorigg\xa0Lamebeck"):
        q = p(other)
        assert (q.core, q.kind) == (full.core, full.kind), other
    assert p("Magikirk Nonamarsh Furn. L.T.D.").legal == "ltd" and p("Magikirk Nonamarsh Public Limited Company").legal == "plc"
    assert p("Bill Digefirth-Calehill (sole trader)").given == "william" and p("Lameb. Nenorigg").cut == ["lameb"]
    assert p("MgaikirkNonamarsh Furniture").core == ["mgaikirk", "nonamarsh"] and p(None).core == [] == p(" ").core


def test_distance():
    assert [orgnames.distance(a, b) for a, b in (("abcd", "abdc"), ("abcd", "abc"), ("abcd", "abxcd"), ("abcd", "xbcy"), ("abcd", "wxyz"), ("", "a"))] == [1, 1, 1, 2, 3, 1]


@pytest.mark.parametrize("seed", range(2))
def test_trie_join(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abco") for _ in range(rng.randint(5, 8))) for _ in range(150)}
    for w in list(words)[:60]:
        x = list(w)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(x) - 1)
            rng.choice([lambda: x.pop(i), lambda: x.insert(i, "z"), lambda: x.__setitem__(i, "q"), lambda: x.__setitem__(slice(i, i + 2), [x[i + 1], x[i]])])()
            if len(x) < 5:
                break
        words.add("".join(x))
    words = sorted(w for w in words if len(w) > 3)
    df = spark.createDataFrame([(w, True, True, False) for w in words], "word string, index boolean, query boolean, short boolean")
    got = {(r.word, r.target): r.edits for r in names.trie_join(df).collect()}
    trie = names.Trie()
    for w in words:
        trie.add(w)
    want = {(a, b): d for a in words for b, d in trie.near(a) if a != b}
    assert want == {(a, b): orgnames.distance(a, b) for a in words for b in words if a != b and orgnames.distance(a, b) <= 2}
    assert got == want


def test_short_words_meet_their_beginnings(spark):
    rows = [("lamebeck", True, False, False), ("lamport", True, False, False), ("lameb", False, False, True)]
    got = {(r.word, r.target) for r in names.trie_join(spark.createDataFrame(rows, "word string, index boolean, query boolean, short boolean")).collect()}
    assert got == {("lameb", "lamebeck")}
    rows = [("lamebeck", True, False, False), ("lamport", True, False, False), ("lmaeb", False, False, True), ("lamxeb", False, False, True), ("alxebe", False, False, True)]
    got = {(r.word, r.target): r.edits for r in names.trie_join(spark.createDataFrame(rows, "word string, index boolean, query boolean, short boolean")).collect()}
    assert got == {("lmaeb", "lamebeck"): 2, ("lamxeb", "lamebeck"): 2}


def test_any_number_of_own_words_ties_and_frequent_misspellings(spark):
    rows = {"Serco Ltd": 3, "SERCO LTD": 1, "Serco  Ltd.": 1, "Sercco Ltd": 1, "Alpha Beta Gamma Ltd": 2, "ALPHA BETA GAMMA LTD": 1, "Alpha Beta Gama Ltd": 1, "Morgan Sindall Ltd": 4, "Morgan Sindal Ltd": 4, "BP Ltd": 2, "BT Ltd": 2, "B.P. Ltd": 1}
    fruit = ["Apple", "Banana", "Cherry", "Durian", "Elder", "Figtree"]
    rows |= {f"Brigacliff {x} Ltd": 5 for x in fruit} | {f"Brigecliff {x} Ltd": 1 for x in fruit}
    df = spark.createDataFrame([(n, None) for n, k in rows.items() for _ in range(k)], "buyer_name string, supplier_name string")
    lead = {r.name: r.leader for r in names.variant_groups(df, ["buyer_name", "supplier_name"]).collect()}
    assert {lead[n] for n in list(rows)[:4]} == {"Serco Ltd"} and {lead[n] for n in list(rows)[4:7]} == {"Alpha Beta Gamma Ltd"}
    assert lead["Morgan Sindall Ltd"] == lead["Morgan Sindal Ltd"] == "Morgan Sindal Ltd" and lead["B.P. Ltd"] == lead["BP Ltd"] == "BP Ltd" != lead["BT Ltd"]
    assert all(lead[f"Brigecliff {x} Ltd"] == f"Brigacliff {x} Ltd" for x in fruit)


def test_kinds_are_learnt(spark):
    own = [f"{a}{b}" for a in ("zor", "mek", "fal", "din", "pur", "gos") for b in ("ston", "wick", "hamm", "dell", "forth", "bury", "gate", "mere", "cott", "land", "port", "ness")]
    rows = [(i, f"{w.title()} {k} Ltd", 1) for i, (w, k) in enumerate((w, k) for w in own for k in ("Logistics", "Brewing"))]
    parsed = names.with_learnt_kinds(names.parse_names(spark.createDataFrame(rows, "id long, name string, n long")))
    assert {(tuple(r.core), r.kind) for r in parsed.collect()} == {((w,), k) for w in own for k in ("logistics", "brewing")}


def test_variants(spark):
    rows = ["Lamebeck Nenorigg Borough Council"] * 9 + ["Magikirk Nonamarsh Furniture Ltd"] * 9 + ["Magikirk Nonamarsh Housing Association"] * 9 + ["Robert Migadale-Calipool"] * 5
    rows += ["Lameb. Nenorigg BC", "lamebeck nenorigg", "LAMEEBCK NENORIGG BORO COUNCIL", "Nenorigg Lamebeck (Borough Council)", "Magikirk Nonaamrsh Furn. Limited", "Magikirk Nonamarsh Ltd", "Bob Migadale-Calipool", "R. MIGADALE CALIPOOL (SOLE TRADER)"]
    rows += ["Lamebeck Nenorigg City Council"] * 3 + [None, "", "N/A", "XXXX", "see attached", "Unknown"]
    df = spark.createDataFrame([(r, None if i % 3 else r, "clash", 1) for i, r in enumerate(rows)], "buyer_name string, supplier_name string, id string, n int")
    lead = {r.name: r.leader for r in names.variant_groups(df, ["buyer_name", "supplier_name"]).collect()}
    assert lead["Lameb. Nenorigg BC"] == lead["LAMEEBCK NENORIGG BORO COUNCIL"] == lead["Nenorigg Lamebeck (Borough Council)"] == "Lamebeck Nenorigg Borough Council"
    assert lead["Lamebeck Nenorigg City Council"] == "Lamebeck Nenorigg City Council" and lead["lamebeck nenorigg"] == "lamebeck nenorigg"  # two kinds: neither
    assert lead["Magikirk Nonaamrsh Furn. Limited"] == lead["Magikirk Nonamarsh Ltd"] == "Magikirk Nonamarsh Furniture Ltd"
    assert lead["Magikirk Nonamarsh Housing Association"] == "Magikirk Nonamarsh Housing Association"
    assert lead["Bob Migadale-Calipool"] == lead["R. MIGADALE CALIPOOL (SOLE TRADER)"] == "Robert Migadale-Calipool"
    assert not {"", "N/A", "XXXX", "see attached", "Unknown"} & set(lead)
    pairs = {tuple(r) for r in names.variant_pairs(df, ["buyer_name", "supplier_name"]).collect()}
    assert pairs == {(a, b) for a in lead for b in lead if a < b and lead[a] == lead[b]}
    assert names.variant_pairs(df.limit(0), ["buyer_name", "supplier_name"]).count() == 0


def test_names_without_two_own_words_form_groups(spark):
    rows = ["Leeds City Council"] * 9 + ["Newcastle upon Tyne City Council"] * 9 + ["Newcastle upon Tyne Housing Association"] * 5 + ["Ashford Housing Association"] * 5
    rows += ["LEEDS CITY CNCL", "Leds City Council", "newcastle upon tyne city cncl", "City Council of Newcastle upon Tyne", "Newcaslte upon Tyne City Council", "Newcastle upon Tyne H.A."]
    df = spark.createDataFrame([(r, None) for r in rows], "buyer_name string, supplier_name string")
    lead = {r.name: r.leader for r in names.variant_groups(df, ["buyer_name", "supplier_name"]).collect()}
    assert {n for n, x in lead.items() if x == rows[0]} == {rows[0], "LEEDS CITY CNCL", "Leds City Council"}
    assert {n for n, x in lead.items() if x == rows[9]} == {rows[9], "newcastle upon tyne city cncl", "City Council of Newcastle upon Tyne", "Newcaslte upon Tyne City Council"}
    assert lead["Newcastle upon Tyne H.A."] == rows[18] and lead["Ashford Housing Association"] == "Ashford Housing Association"


def test_names_run_together_and_misspelt_at_once(spark):
    rows = [("Govohurst Fatipool NHS Foundation Trust",)] * 5 + [("govohhurstfatipool nhs foundation trust",), ("FATIPOLOGOVOHURST NHS Foundation Trust",), ("Govohhurstfatipool University",)]
    df = spark.createDataFrame([(a, None) for (a,) in rows], "buyer_name string, supplier_name string")
    lead = {r.name: r.leader for r in names.variant_groups(df, ["buyer_name", "supplier_name"]).collect()}
    assert lead["govohhurstfatipool nhs foundation trust"] == lead["FATIPOLOGOVOHURST NHS Foundation Trust"] == rows[0][0]
    assert lead["Govohhurstfatipool University"] == "Govohhurstfatipool University"


def test_alternating_directions_reach_the_minimum():
    # min 2 (1 - x)^2 + (x)^2 + 4 max(0, 0.8 - y)^2 with x + y <= 1
    g = linkage.Ground()
    g.add([(0, -1.0)], 1.0, 2.0)
    g.add([(0, 1.0)], 0.0, 1.0)
    g.add([(1, -1.0)], 0.8, 4.0)
    g.add([(0, 1.0), (1, 1.0)], -1.0)
    (x, y), left = g.solve(np.zeros(2, dtype=np.int64), most=5000, near=1e-7)
    grid = min((2 * (1 - a) ** 2 + a**2 + 4 * max(0, 0.8 - b) ** 2, a, b) for a in [i / 500 for i in range(501)] for b in [j / 500 for j in range(501)] if a + b <= 1)
    assert abs(x - grid[1]) < 0.01 and abs(y - grid[2]) < 0.01 and left.max() < 1e-6


def test_parts_settle_by_themselves():
    rng = random.Random(1)
    obs = [(i, "A", [-1.0, rng.random(), 4.0, 1.0, 0.0, rng.random() * 3], None) for i in range(50)] + [(7, "B", [-1.0, 0.9, 8.0], 0.2)]
    obs.sort(key=lambda r: r[0])
    together, _ = linkage.solve_block(obs, 2.0)
    for i in range(50):
        own = [r for r in obs if r[0] == i]
        assert list(linkage.solve_block(own, 2.0)[0]) == [x for x, r in zip(together, obs) if r[0] == i]


def test_siblings_agree_and_pass_on_their_organisation(spark):
    reg = [(101, "GB-1", "Alpha Betaford Borough Council", None, "UKJ11", None, '["45"]'), (105, "GB-4", "Gamma Deltaham Furniture Ltd", None, "UKK12", "QK2 2BB", '["39"]')]
    obs = [
        (1, "Alpha Betaford Borough Council", None, None, "UKJ11", "QA1 1AA", '["45"]'), (2, "Alpha Betaford BC", None, None, "UKJ11", "qa11aa", '["45"]'),
        (3, "Zeta Etaport Borough Council", None, None, None, "QA1 1AA", None),  # another name, but kind and place of the two
        (4, "Zeta Etaport Borough Council", None, None, None, "QX9 9AA", None), (5, "Zeta Etaport Primary School", None, None, None, "QA1 1AA", None),
    ]
    o = spark.createDataFrame([(*r, 5, None) for r in obs], OBS)
    c = spark.createDataFrame([(*r, 5, None) for r in reg], REG)
    got = {(r.obs_id, r.org_no): r for r in linkage.link(o, c).collect()}
    assert {k for k, r in got.items() if r.confidence >= linkage.MATCH} >= {(1, 101), (2, 101)}
    assert (3, 101) in got and not {(4, 101), (5, 101)} & set(got)  # a candidate only through its siblings
    assert abs(got[1, 101].confidence - got[2, 101].confidence) < 0.03 and all(r.residual < 0.05 for r in got.values())


OBS = "obs_id long, name string, identifier_legal_name string, norm_name string, address_region string, postal_code string, cpv2 string, org_no long, org_category string"
REG = "org_no long, canonical_id string, canonical_name string, norm_name string, address_region string, postal_code string, cpv2 string, obs_id long, org_category string"


def test_links(spark):
    reg = [
        (101, "GB-1", "Alpha Betaford Borough Council", None, "UKJ11", "QA1 1AA", '["45"]'), (102, "gb 1", "ALPHA BETAFORD BOROUGH COUNCIL", None, None, "QA1 1AA", "[]"),  # one organisation twice
        (103, "GB-2", "Alpha Betaford Borough Council", None, "UKM22", "QZ9 9ZZ", '["90"]'), (104, "GB-3", "Alpha Betaford Primary School", None, "UKJ11", "QA1 1AA", '["45"]'),
        (105, "GB-4", "Gamma Deltaham Furniture Ltd", None, "UKK12", "QK2 2BB", '["39"]'), (106, None, None, None, None, None, None),
    ]
    obs = [
        (1, "alpha betafrod BC", None, None, "UKJ11", None, '["45"]'), (2, "Alpha Betaford Borough Council", None, None, "UKD55", "QD5 5DD", '["77"]'),  # elsewhere, other codes
        (3, "Epsilon Zetaport Furniture Ltd", None, None, "UKK12", "qk22bb", '["39"]'),  # renamed
        (4, "Gamma Deltaham Furniture Ltd", None, None, None, None, None), (5, None, None, None, None, None, None), (6, "Alpha Betaford", None, None, "UKJ", "QA1 1AA", '["45"]'),
        (7, "Gamma Deltaham Housing Association", None, None, "UKK12", "QK2 2BB", '["39"]'),  # another kind at the same place
        (8, None, "Gamma Deltaham Furniture Limited", "bad", "UKK1", "QK2", "not json"),
    ]
    o = spark.createDataFrame([(*r, 5, None) for r in obs], OBS)
    c = spark.createDataFrame([(*r, 5, None) for r in reg], REG)
    got = {(r.obs_id, r.org_no) for r in linkage.matches(o, c).collect()}
    assert {p for p in got if p[0] != 6} == {(1, 101), (1, 102), (3, 105), (4, 105), (8, 105)}
    pairs = spark.createDataFrame([(2, 103, True), (None, 1, None), (99, 101, None)], "entity_a_id long, entity_b_id long, official_scheme_conflict boolean")
    assert {(r.obs_id, r.org_no) for r in linkage.matches(o, c, pairs).collect()} == got
    assert linkage.matches(o.limit(0), c).count() == 0 and linkage.matches(o, c.where(F.lit(False))).count() == 0
    assert all(0 <= r.confidence <= 1 for r in linkage.link(o, c).collect())


def test_register_names_of_any_number_of_words_are_candidates(spark):
    from quillgraph.llm import linkage as K

    o = "obs_id long, name string, legal_name string, pc string"
    obs = spark.createDataFrame([(1, "Newcastle Upon Tyne Quayside Council", None, ""), (2, "Harbury Nesting Velvon Council", None, ""), (3, "Oakminster School", None, ""), (4, "Ashford Melbourn School", None, "")], o)
    orgs = spark.createDataFrame([(10, "Harbury Nestling Velvon Council", ""), (11, "Oakminstre School", ""), (12, "Ashfort Melbourn School", ""), (13, "Ashford Other School", "")], "org_no long, c_name string, c_pc string")
    got = {(r.obs_id, r.org_no) for r in K.candidates(obs, orgs, None).collect()}
    assert {(2, 10), (3, 11), (4, 12)} <= got


def test_siblings_common_values_need_no_join(spark, monkeypatch):
    from quillgraph.llm import linkage as L

    plans, real = [], L.cut
    monkeypatch.setattr(L, "cut", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d))
    first = spark.createDataFrame([(1, 7, 0.9, 0.0), (2, 7, 0.3, 0.0)], "obs_id long, org_no long, x double, residual double")
    ground = spark.createDataFrame([(1, 7, "k", 5, [-1.0, 1.0, 4.0]), (2, 7, "k", 5, [1.0, 0.0, 1.0])], "obs_id long, org_no long, c_key string, sib long, rules array<double>")
    got = {r.obs_id: r.x for r in L.agree(ground, first, L.Weights(), rounds=1).collect()}
    assert set(got) == {1, 2} and abs(got[1] - got[2]) < 1e-9 and plans[0].count("Join ") == 1  # that of the rounds' first values
