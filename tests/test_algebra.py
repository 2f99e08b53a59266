"""The algebra's rules on small records, and random trees against an evaluator that shares no code with it."""

import random
from decimal import Decimal

import pytest

from quillgraph.plans.algebra import AlgebraError, check, run
from quillgraph.plans.universe import Universe

SCHEMA = "contract_node_id string, buyer string, suppliers array<string>, year int, amount double, title string, signed string, additive boolean"
ROWS = [
    ("c1", "B1", ["S1", "S2"], 2020, 100.0, "Red chairs", "2020-05-01", True),
    ("c2", "B1", ["S2"], 2021, 300.0, "blue Chairs", "2021-05-01", True),
    ("c3", "B2", [], 2021, None, "", "", False),
    ("c4", None, None, None, float("nan"), None, None, None),
    ("c5", "", ["S1"], 2020, 300.0, "red tables", "2020-01-02", True),
    ("c6", "B2", ["S3"], 2022, 0.1, "x", "2022-02-02", True),
]


@pytest.fixture(scope="module")
def u(spark):
    return Universe(spark.createDataFrame(ROWS, SCHEMA))


def flt(*preds):
    return {"node": "filter", "where": list(preds)}


def p(field, op, value=None):
    return {"field": field, "op": op, **({} if op == "exists" else {"value": value})}


def ids(u, *preds):
    r = run(flt(*preds), u)
    assert r["status"] == "ok", r
    return r["answer"]


def test_missing_cells_are_false_and_their_negation_true(u):
    assert ids(u, p("buyer", "eq", "B1")) == ["c1", "c2"]
    assert ids(u, {"op": "not", "pred": p("buyer", "eq", "B1")}) == ["c3", "c4", "c5", "c6"]
    assert ids(u, {"op": "not", "pred": p("amount", "lte", 200)}) == ["c2", "c3", "c4", "c5"]
    assert ids(u, p("amount", "gte", "300")) == ["c2", "c5"]  # NaN is missing, text bounds are numbers
    assert ids(u, p("title", "gte", 5)) == []


def test_lists_match_by_any_element(u):
    assert ids(u, p("suppliers", "eq", "S2")) == ["c1", "c2"]
    assert ids(u, p("suppliers", "in", ["S3", "S1"])) == ["c1", "c5", "c6"]
    assert ids(u, p("suppliers", "exists")) == ["c1", "c2", "c5", "c6"]
    assert ids(u, p("title", "contains", "CHAIR")) == ["c1", "c2"]


def test_membership_keeps_missing_rows_when_negated(u):
    inner = {"node": "values", "of": flt(p("year", "eq", 2021)), "field": "buyer"}
    assert ids(u, {"op": "in_expr", "field": "buyer", "expr": inner}) == ["c1", "c2", "c3", "c6"]
    assert ids(u, {"op": "in_expr", "field": "buyer", "expr": inner, "negate": True}) == ["c4", "c5"]
    either = {"op": "any", "preds": [{"op": "in_expr", "field": "buyer", "expr": inner, "negate": True}, p("year", "eq", 2022)]}
    assert ids(u, either) == ["c4", "c5", "c6"]
    listed = {"node": "values", "of": flt(p("year", "eq", 2021)), "field": "suppliers"}
    assert ids(u, {"op": "in_expr", "field": "suppliers", "expr": listed}) == ["c1", "c2"]


def test_scalars_and_their_failures(u):
    assert run({"node": "sum", "of": flt(p("additive", "eq", True)), "field": "amount"}, u)["answer"] == 700.1
    assert run({"node": "sum", "of": flt(), "field": "amount"}, u) == {"status": "failed", "reason": "non_finite_value_in_sum"}
    assert run({"node": "sum", "of": flt(p("year", "eq", 1)), "field": "amount"}, u)["answer"] == 0.0
    assert run({"node": "select", "of": flt(p("year", "eq", 2021)), "field": "buyer"}, u)["reason"] == "multiple_answers:2"
    assert run({"node": "select", "of": flt(p("year", "eq", 1)), "field": "buyer"}, u)["reason"] == "no_results"
    assert run({"node": "extreme", "op": "argmax", "of": flt(), "field": "amount"}, u)["answer"] == "c2"  # ties: the smaller id
    assert run({"node": "extreme_rows", "op": "argmax", "of": flt(), "field": "amount"}, u)["answer"] == ["c2", "c5"]
    assert run({"node": "extreme_rows", "op": "argmin", "of": flt(), "field": "signed"}, u)["answer"] == ["c5"]
    zero = {"node": "combine", "op": "ratio", "left": {"node": "num", "value": 1}, "right": {"node": "count", "of": flt(p("year", "eq", 1))}}
    assert run(zero, u)["reason"] == "ratio_division_by_zero"
    assert run({"node": "sum", "of": flt(), "field": "nope"}, u) == {"status": "failed", "reason": "unknown_field:nope"}


def test_groups_rank_by_value_then_key(u):
    g = {"node": "groupby", "of": flt(), "key": "buyer"}
    assert run(g, u)["answer"] == {"B1": 2.0, "B2": 2.0}
    assert run({"node": "top", "k": 1, "of": g}, u)["answer"] == [["B1", 2]]
    assert run({"node": "argext", "op": "argmin", "of": g}, u)["answer"] == "B1"
    assert run({"node": "top", "k": 1, "of": {**g, "of": flt(p("year", "eq", 1))}}, u)["reason"] == "no_groups"


@pytest.mark.parametrize(
    "tree, reason",
    [
        ({"node": "count", "of": {"node": "num", "value": 1}}, "count_expects_RECORDS_got_NUMBER"),
        ({"node": "what"}, "unknown_node:what"), ([], "node_not_object"), ({"node": "top", "k": 0, "of": {"node": "groupby", "of": flt(), "key": "b"}}, "top_k_out_of_range"),
        (flt({"op": "any", "preds": [p("a", "exists")]}), "any_needs_two_preds"), (flt({"field": "a", "op": "eq"}), "pred_needs_value"), (flt({"op": "like", "field": "a"}), "unknown_pred_op:like"),
        ({"node": "combine", "op": "mod", "left": {}, "right": {}}, "combine_op_invalid:mod"), ({"node": "values", "of": flt()}, "values_needs_field"),
        ({"node": "setop", "op": "union", "left": {"node": "num", "value": 1}, "right": {"node": "num", "value": 1}}, "setop_left_expects_VALUES_got_NUMBER"),
    ],
)
def test_ill_formed_trees(tree, reason):
    with pytest.raises(AlgebraError) as e:
        check(tree)
    assert e.value.reason == reason


def test_depth_and_size_are_bounded(u):
    t = {"node": "num", "value": 1}
    for _ in range(18):
        t = {"node": "combine", "op": "add", "left": t, "right": {"node": "num", "value": 1}}
    assert run(t, u)["reason"] == "tree_too_deep"
    wide = {"node": "num", "value": 1}
    for _ in range(7):
        wide = {"node": "combine", "op": "add", "left": wide, "right": wide}
    assert run(wide, u)["reason"] == "tree_too_large"


# --- random trees -----------------------------------------------------------------------------------------------------------------------


class Slow:
    """Evaluates trees row by row over plain dictionaries."""

    def __init__(self, rows):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        self.rows = [dict(zip(names, r)) for r in rows]

    def holds(self, r, q):
        if q["op"] == "not":
            return not self.holds(r, q["pred"])
        if q["op"] == "any":
            return any(self.holds(r, x) for x in q["preds"])
        v = r[q["field"]]
        if q["op"] == "in_expr":
            members = self.values(q["expr"])
            own = v if isinstance(v, list) else [] if v is None else [str(v)]
            return bool(set(own) & members) != bool(q.get("negate"))
        if q["op"] in ("gte", "lte"):
            if not isinstance(v, (int, float)) or v != v:
                return False
            return v >= float(q["value"]) if q["op"] == "gte" else v <= float(q["value"])
        if isinstance(v, list):
            return q["value"] in v if q["op"] == "eq" else bool(set(v) & set(q["value"])) if q["op"] == "in" else any(x.strip() for x in v)
        if v is None:
            return False
        if q["op"] == "eq":
            return v == q["value"]
        if q["op"] == "in":
            return str(v) in {str(x) for x in q["value"]}
        return str(q["value"]).lower() in str(v).lower() if q["op"] == "contains" else str(v).strip() != ""

    def records(self, t):
        return [r for r in self.rows if all(self.holds(r, q) for q in t["where"])]

    def values(self, t):
        if t["node"] == "values":
            out = set()
            for r in self.records(t["of"]):
                v = r[t["field"]]
                out |= set(v if isinstance(v, list) else [] if v is None else [str(v)])
            return {x for x in out if x and x != "nan"}
        if t["node"] == "keys_where":
            return {k for k, v in self.groups(t["of"]).items() if v >= t["value"]}
        a, b = self.values(t["left"]), self.values(t["right"])
        return a | b if t["op"] == "union" else a & b if t["op"] == "intersect" else a - b

    def groups(self, t):
        out = {}
        for r in self.records(t["of"]):
            k = r[t["key"]]
            if k is None or not str(k).strip():
                continue
            x = 1 if t.get("metric", "count") == "count" else Decimal(str(r["amount"] if r["amount"] is not None and r["amount"] == r["amount"] else 0))
            out[str(k)] = out.get(str(k), 0) + x
        return {k: float(v) for k, v in out.items()}

    def number(self, t):
        return len(self.records(t["of"])) if t["node"] == "count" else len(self.values(t["of"]))


def random_pred(rng, depth):
    kind = rng.choice(["leaf"] * 4 + ["not", "any", "in_expr"]) if depth else "leaf"
    if kind == "not":
        return {"op": "not", "pred": random_pred(rng, depth - 1)}
    if kind == "any":
        return {"op": "any", "preds": [random_pred(rng, depth - 1) for _ in range(rng.randint(2, 3))]}
    if kind == "in_expr":
        f = rng.choice(["buyer", "suppliers", "year"])
        return {"op": "in_expr", "field": f, "expr": {"node": "values", "of": random_filter(rng, depth - 1), "field": f}, "negate": rng.random() < 0.4}
    return rng.choice(
        [p("buyer", "eq", rng.choice(["B1", "B2", ""])), p("suppliers", "eq", rng.choice(["S1", "S2", "S9"])), p("suppliers", "in", ["S1", "S3"]), p("year", "in", [2020, "2021"]), p("amount", "gte", rng.choice([50, 300])),
         p("amount", "lte", 200), p("title", "contains", rng.choice(["red", "chair", "x"])), p("buyer", "exists"), p("suppliers", "exists"), p("year", "eq", 2021), p("additive", "eq", True)]
    )


def random_filter(rng, depth):
    return flt(*[random_pred(rng, depth) for _ in range(rng.randint(0, 2))])


def random_values(rng, depth):
    if depth and rng.random() < 0.4:
        return {"node": "setop", "op": rng.choice(["union", "intersect", "difference"]), "left": random_values(rng, depth - 1), "right": random_values(rng, depth - 1)}
    if rng.random() < 0.3:
        return {"node": "keys_where", "op": "ge", "value": rng.randint(1, 2), "of": {"node": "groupby", "of": random_filter(rng, 1), "key": "buyer"}}
    return {"node": "values", "of": random_filter(rng, depth), "field": rng.choice(["buyer", "suppliers", "year"])}


@pytest.mark.parametrize("seed", range(24))
def test_random_trees_agree_with_the_slow_evaluator(u, seed):
    rng, slow = random.Random(seed), Slow(ROWS)
    t = random_filter(rng, 2)
    assert run(t, u)["answer"] == sorted(r["contract_node_id"] for r in slow.records(t))
    v = random_values(rng, 1)
    assert run(v, u)["answer"] == sorted(slow.values(v))
    g = {"node": "groupby", "of": random_filter(rng, 1), "key": rng.choice(["buyer", "year"]), **rng.choice([{"metric": "count"}, {"metric": "sum", "field": "amount"}])}
    assert run(g, u)["answer"] == slow.groups(g)
    n = {"node": "size", "of": v}
    assert run(n, u)["answer"] == slow.number(n)
