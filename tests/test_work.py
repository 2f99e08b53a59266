"""Plans to trees, answers, lookups and workload operators."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.answers import STRICT, same_answer
from quillgraph.operators import lookup as L
from quillgraph.operators import relational as R
from quillgraph.operators import workload as K
from quillgraph.plans.algebra import check
from quillgraph.plans.rules import how_many
from quillgraph.plans.trees import NoTree, json_schema, shape, signature, tree_of_plan


def plan(op, *constraints, **more):
    return {"answer_operation": op, "constraints": [dict(zip(("field", "op", "value"), c)) for c in constraints], **more}


def test_plans_to_trees():
    year = ("release_year", "between", [2020, 2021])
    for p, kind in (
        (plan("count", year), "NUMBER"), (plan("exists", year), "BOOL"), (plan("sum"), "NUMBER"), (plan("distinct_set", answer_field="buyer_name"), "VALUES"), (plan("select_unique", answer_field="buyer_name"), "VALUE"),
        (plan("argmax"), "VALUE"), (plan("rank_top_k"), "RANKING"), (plan("count", ("supplier_name", "in_subquery", {"resolve": "suppliers_of_buyer", "buyer": "B"})), "NUMBER"),
        (plan("compare", metadata={"template_family": "comparison", "compare_params": {"sides": ["A", "B"], "year": 2020}}), "BOOL"),
        (plan("compare", metadata={"template_family": "date_relation", "compare_params": {"pivot_date_surface": "1 May 2025"}}), "BOOL"),
        (plan("compare", metadata={"template_family": "numeric_threshold", "compare_params": {"threshold": 5}}), "BOOL"),
    ):
        assert check(tree_of_plan(p)) == kind
    assert tree_of_plan(plan("rank_top_k"), "Which two buyers lead?")["k"] == 2 and how_many("top 7") == 7 and how_many("x", 4) == 4
    assert tree_of_plan(plan("argmin", metadata={"template_family": "min_max"}))["of"]["where"][0]["op"] == "not"
    for bad in (plan("mean"), plan("count", ("a", "like", 1)), plan("distinct_set"), plan("compare"), plan("count", ("a", "in_subquery", {"resolve": "x"}))):
        with pytest.raises(NoTree):
            tree_of_plan(bad)


def test_tree_signatures_and_schema():
    a = {"node": "count", "of": {"node": "filter", "where": [{"field": "x", "op": "eq", "value": 1}, {"field": "y", "op": "exists"}]}}
    b = {"of": {"where": [{"op": "exists", "field": "y"}, {"value": 1, "op": "eq", "field": "x"}], "node": "filter"}, "node": "count"}
    assert signature(a) == signature(b) != signature({**a, "node": "exists"})
    assert shape(a) == shape({"node": "count", "of": {"node": "filter", "where": [{"field": "x", "op": "eq", "value": 2}, {"field": "y", "op": "exists"}]}})
    s = json_schema(["x"])
    assert set(s["$defs"]) == {"RECORDS", "VALUES", "GROUPS", "NUMBER", "BOOL", "VALUE", "RANKING", "PRED"}


def test_answers():
    same = [(1, 1.005), (1e9, 1e9 + 500), ("A b", "a B "), (["x", "Y"], ["y", "X"]), ({"x"}, "x"), ([["a", 1]], [("A", 1.001)]), ("2025-05-01T00:00", "2025-05-01"), (True, True), ("3", 3)]
    other = [(1, 1.02), ("a", "b"), ([1, 2], [1]), ([["a", 1], ["b", 2]], [["b", 2], ["a", 1]]), (True, 1), (None, ""), (True, False)]
    assert all(same_answer(a, b) for a, b in same) and not any(same_answer(a, b) for a, b in other)


def test_answers_of_evaluation_runs():
    assert not same_answer(0.004, 0.009, STRICT) and same_answer(1e9, 1e9 + 500, STRICT) and same_answer([["a", 1]], [["A", 7]], STRICT) and not same_answer([["a", 1]], [["b", 1]], STRICT)


def test_work_on_splits_ties_and_hidden_fields(spark):
    rows = spark.createDataFrame([(1, "p", "train"), (2, "p", "dev"), (3, "p", "train"), (4, "q", "dev"), (5, "q", "train"), (6, None, "dev"), (7, "p", None)], "i int, plan string, split string")
    got = {r.i: r.new_split for r in K.whole_splits(rows, "plan", "split", ["dev", "train"]).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "dev", 5: "dev", 6: "dev", 7: None}
    counts = spark.createDataFrame([("a", "x", 5), ("a", "y", 3), ("a", "z", 3), ("b", "x", 2), ("b", "y", 1)], "g string, n string, k long")
    assert [tuple(r) for r in K.boundary_ties(counts, "g", "n", "k", 2).collect()] == [("a", 3, 2, 1)]
    fields = spark.createDataFrame([(1, "h"), (1, "h"), (2, "ok")], "i int, field string")
    assert {r.i: r.reason for r in K.without_fields(rows.where("i < 4"), fields, ["h"], "i").collect()} == {1: "hidden:h", 2: None, 3: None}
    sizes = spark.createDataFrame([(i, 3) for i in range(50)], "i int, size int")
    assert sorted(r.i for r in K.cut_at_total(sizes, ["i"], "size", 20).collect()) == list(range(7)) and K.cut_at_total(sizes.limit(0), ["i"], "size", 20).count() == 0
    assert R.apportion_within({"a": 3.0, "b": 1.0}, {"a": 2, "b": 9}, 8) == {"a": 2, "b": 6} and R.apportion_within({"a": 1.0}, {"a": 1}, 5) == {"a": 1}


def test_lookups(spark):
    df = spark.createDataFrame([("Leeds Council", 1)] * 5 + [("LEEDS COUNCIL", 1)] * 2 + [("York Trust", 2), (None, 3), (" ", 4)], "name string, y int")
    best = {r.folded: (r.name, r.n_variants, r.n_rows) for r in L.best_variant(df, "name").collect()}
    assert best == {"leeds council": ("Leeds Council", 2, 7), "york trust": ("York Trust", 1, 1)}
    assert L.resolve_org(df, "name", "LEEDS COUNCIL") == L.Resolved(("LEEDS COUNCIL",), 1.0, True)
    near = L.resolve_org(df, "name", "leeds  council ltd")
    assert near.confident and set(near.names) == {"Leeds Council", "LEEDS COUNCIL"}
    assert not L.resolve_org(df, "name", "Quux").confident and L.resolve_org(df.limit(0), "name", "x") == L.Resolved((), 0.0, False)
    cells = L.link_cells(spark.createDataFrame([("red chair", "a"), ("blue", "b")], "n string, c string"), "a red chair")
    assert [(r.column, r.cell) for r in cells.orderBy("column").collect()] == [("c", "a"), ("n", "red chair")]
    fields = {"release_year": "int", "buyer_name": "string", "supplier_name": "string", "value_amount": "double"}
    assert L.ground_field("Year", fields) == "release_year" and L.ground_field("release years", fields) == "release_year" and L.ground_field("colour", fields) is None


def test_workload(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "", "x"), (5, None, "y")], "id long, k string, v string")
    assert {(r.anchor, r.n) for r in K.mine_groups(df, "id", [["k"], ["k", "v"]], 1, 2).collect()} == {("k=a", 2), ("k=b", 1), ("k=a|v=x", 1), ("k=a|v=y", 1), ("k=b|v=x", 1)}
    assert [(r.a, r.yes, r.no) for r in K.boolean_twins(df, "k", "v", 5).collect()] == [("b", "x", "y")]
    rows = spark.createDataFrame([("p", "q1", "train"), ("p", "q2", "dev"), ("r", "q1", "dev"), (None, None, "dev"), ("s", "q", "")], "p string, q string, split string")
    assert [(r.p, r.splits) for r in K.split_leaks(rows, "p", "split").collect()] == [("p", "dev|train")]
    assert {(r.key, r.n_rows, r.n_leaked) for r in K.seal_report(rows, ["p", "q"], "split", "train").collect()} == {("p", 2, 1), ("q", 2, 1)}
    sizes = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "g string, n int")
    assert [r.g for r in K.cut_at_total(sizes, [F.col("g")], "n", 5).collect()] == ["a", "b"]
    assert sorted(r.id for r in K.top_up(df.where("id < 3"), df, "id", 4, [F.desc("id")]).collect()) == [1, 2, 4, 5]
    v = spark.createDataFrame([(1, False, 1), (1, True, 2), (2, False, 1), (3, False, 2)], "id long, passed boolean, attempt int")
    assert {r.id: r.route for r in K.route(df, v, "id").collect()} == {1: "accepted", 2: "regenerate", 3: "rejected", 4: "pending", 5: "pending"}
    p = K.paired(v.where("attempt = 1").select("id", F.lit(True).alias("h")), v.where("attempt = 1").select("id", F.col("passed").alias("h")), "id", "h").first()
    assert (p.n, p.only_a, p.both) == (2, 2, 0)
    dec = spark.createDataFrame([("a", "b", "merge", 0.95, []), ("a", "b", "merge", 0.95, ["trusted_id_conflict"]), ("a", "a", "merge", 1.0, []), ("a", "b", "maybe", 0.5, None), ("a", "b", "reject", 0.2, None)], "a string, b string, decision string, confidence double, risk_flags array<string>")
    assert [r.gate for r in K.adjudicated(dec).collect()] == ["merge", "review", "invalid", "invalid", "reject"]
    t = K.trigram_similar(spark.createDataFrame([(1, "x", "hello world")], "i long, b string, t string"), spark.createDataFrame([(2, "x", "Hello worlds"), (3, "y", "hello world")], "i long, b string, t string"), "b", "t", "i")
    assert [(r.a, r.b) for r in t.collect()] == [(1, 2)]


def test_repairs_and_faults():
    from quillgraph.plans.repairs import Outcome, faults, variants

    tree = {"node": "filter", "where": [{"field": "year__num", "op": "gt", "value": 2019}]}
    got = dict(variants(tree, frozenset({"year", "name"}), ("name", "other")))
    fixed = {"node": "filter", "where": [{"field": "year", "op": "gte", "value": 2020}]}
    assert got == {"bounds": {"node": "filter", "where": [{"field": "year__num", "op": "gte", "value": 2020}]}, "answer:name": {"node": "values", "of": fixed, "field": "name"}}
    good = {"node": "count", "of": {"node": "filter", "where": [{"field": "year", "op": "eq", "value": 2020}]}}
    assert not list(variants(good, frozenset({"year"})))
    assert faults(good, Outcome("NUMBER", 4, (4,)), "How many contracts in 2020?", ("year",)) == {}
    assert faults(good, Outcome("NUMBER", 0, (0,)), "Which buyer?", ("name", "title", "other")) == {"nothing_matched": 3, "kind": 1, "unused_links": 2}
    assert faults(good, Outcome("VALUES", [], ()), "Is there any?") == {"empty": 3, "kind": 2}
    assert faults(good, Outcome("VALUE", "Leeds Council", (1,)), "What did Leeds Council buy?") == {"repeats_question": 2}
    assert faults(good, Outcome("NUMBER", 0, (3,)), "How many?") == {"zero": 1}
