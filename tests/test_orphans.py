"""Orphan references against their definition, row by row."""

import random
from datetime import datetime, timedelta

import pytest

from quillgraph.operators.orphans import STATE, Reference, apply_deltas, current_orphan_keys, orphan_keys, orphan_report, orphans, signed_counts

EDGES = "row_id long, ref string, loaded_at timestamp, delta int, k string"
TARGETS = "key string, loaded_at timestamp, deleted_at timestamp, at timestamp, existing int"
T0 = datetime(2020, 1, 1)


def refs(spark, edges, targets):
    e = spark.createDataFrame([(*r, 0, "clash") for r in edges], EDGES)
    t = spark.createDataFrame([(*r, T0, 7) for r in targets], TARGETS)
    return [Reference(e, "edges", "ref", t, "key", "thing")]


def found(spark, edges, targets):
    return sorted(r.edge_row_id for r in orphans(refs(spark, edges, targets)).collect())


def flat(x):
    return "".join(c for c in x if c.isalnum()).upper()


def slow(edges, targets):
    out = []
    for i, ref, at in edges:
        if ref is None or not ref.replace("\xa0", " ").strip():
            continue
        ok = at is not None and flat(ref) and any(k is not None and flat(k) == flat(ref) and a is not None and a <= at and (d is None or d > at) for k, a, d in targets)
        if not ok:
            out.append(i)
    return sorted(out)


def test_cases(spark):
    day = lambda n: T0 + timedelta(days=n)
    targets = [("GB-A-1", day(0), None), ("GB-A-2", day(5), day(10)), ("GB-A-2", day(10), day(12)), ("GB-A-3", None, None), ("GB-A-4", day(5), day(4)), (None, day(0), None)]
    edges = [
        (1, "gb a/1", day(0)), (2, "GB-A-1", day(-1)), (3, "GB-A-2", day(10)), (4, "GB-A-2", day(12)), (5, "GB-A-3", day(9)), (6, "GB-A-4", day(6)), (7, None, day(1)), (8, " \xa0", day(1)),
        (9, "--", day(1)), (10, "GB-A-1", None), (11, "GB-A-1\xa0", day(400)), (12, "GB-A-1\xa0", day(400)),
    ]
    assert found(spark, edges, targets) == [2, 4, 5, 6, 9, 10] == slow(edges, targets)


@pytest.mark.parametrize("seed", range(3))
def test_random_against_definition(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["A-1", "a_1", "B-2", " b2", "C3", "hot", "hot", "hot", None, ""])
    at = lambda: T0 + timedelta(days=rng.randint(0, 90))
    targets = [(key(), at(), rng.choice([None, at()])) for _ in range(60)]
    edges = [(i, key(), rng.choice([at(), at(), None])) for i in range(300)]
    assert found(spark, edges, targets) == slow(edges, targets)


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "x", T0)], []) == [1]
    assert orphan_report(refs(spark, [], [("x", T0, None)])).count() == 0


def test_reports(spark):
    targets = [("A", T0, None), ("B", T0, T0 + timedelta(days=1))]
    edges = [(1, "A", T0), (2, "B", T0 + timedelta(days=40)), (3, "b", T0), (4, "Z", None)]
    rows = {r.month: (r.n_refs, r.n_orphans) for r in orphan_report(refs(spark, edges, targets)).collect()}
    assert rows == {"2020-01": (2, 0), "2020-02": (1, 1), None: (1, 1)}
    assert {(r.k, r.n_refs) for r in current_orphan_keys(refs(spark, edges, targets)).collect()} == {("B", 2), ("Z", 1)}


@pytest.mark.parametrize("seed", range(2))
def test_the_maintained_ledger_equals_a_recomputation(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["A-1", "a_1", "B-2", " b2", "C3", "hot", "hot", None, "", "--"])
    at = lambda: T0 + timedelta(days=rng.randint(0, 90))
    all_edges = [(i, key(), at()) for i in range(200)]
    all_targets = [(key(), at(), rng.choice([None, at()])) for _ in range(40)]
    whole = refs(spark, all_edges, all_targets)
    want = sorted((r.k, r.n_refs, r.existing) for r in current_orphan_keys(whole).collect())
    by_time = spark.createDataFrame([], STATE)
    for after, upto in ((None, "2020-02-01"), ("2020-02-01", "2020-03-01"), ("2020-03-01", None)):
        by_time = apply_deltas(by_time, signed_counts(whole, after=after, upto=upto))
    assert sorted((r.k, r.n_refs, r.existing) for r in orphan_keys(by_time).collect()) == want
    # By batches of rows in any order, one of them wrong and taken back.
    wrong = signed_counts(refs(spark, [(900, "C3", T0), (901, "nowhere", T0)], [("A-1", T0, None)]))
    taken = signed_counts(refs(spark, [(900, "C3", T0), (901, "nowhere", T0)], [("A-1", T0, None)]), sign=-1)
    by_rows = apply_deltas(apply_deltas(spark.createDataFrame([], STATE), wrong), signed_counts(refs(spark, all_edges[100:], all_targets[:20])))
    by_rows = apply_deltas(apply_deltas(by_rows, signed_counts(refs(spark, all_edges[:100], all_targets[20:]))), taken)
    assert sorted((r.k, r.n_refs, r.existing) for r in orphan_keys(by_rows).collect()) == want
    assert by_rows.where("k = 'NOWHERE'").count() == 0 and orphan_keys(spark.createDataFrame([], STATE)).count() == 0
