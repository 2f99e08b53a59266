"""Splits that keep related records together: union-find groups, then largest-first assignment within each stratum."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import loose_key
from ..operators.components import connected_components
from ..operators.skew import lookup_join, ranked
from ..session import cut

SHARES = {"train": 0.8, "dev": 0.1, "final_test": 0.1}


def bound_rows(df: DataFrame, row: str = "row_id", keys: tuple[str, ...] = ("plan_id", "dedup_group")) -> DataFrame:
    """`row_id, group_row_id` of every row; the group is the smallest row id of its chain of equal keys.

    Keys are equal when their letters and digits are; a key without any binds nothing, so such rows are groups of one. Each row is linked
    to the smallest row of each of its keys (found by a pre-aggregated minimum and joined back with heavy keys salted), so a key that
    holds a third of the rows adds one link per row and no task sees the whole group. A null row id is no row.
    """
    d = df.select(F.col(row).cast("long").alias("row_id"), *[loose_key(F.col(k)).alias(k) for k in keys]).where("row_id is not null")
    links = None
    for k in keys:
        own = d.where(F.col(k).isNotNull()).select("row_id", k)
        low = own.groupBy(k).agg(F.min("row_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select(k, "low")
        e = lookup_join(own, low, k, "inner").select(F.col("row_id").alias("a"), F.col("low").alias("b")).where("a <> b")
        links = e if links is None else links.unionByName(e)
    comp = connected_components(links).withColumnRenamed("node", "row_id")
    return d.select("row_id").distinct().join(comp, "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("group_row_id"))


def hand_out(cells: list[tuple[int, int, int]], shares: dict[str, float]) -> list[tuple[int, int, int, int, str]]:
    """(stratum, size, first and last group of that size, split) for rows (stratum, size of a group, number of such groups) of one family.

    Largest groups of a stratum go first, each to the split furthest below its target there. Splits that differ by no more than the group
    itself are alike to the stratum; among them the one furthest below its share of the family takes it, so the rounding of small strata
    evens out. Many groups of one size are handed out at once.
    """
    names, want = list(shares), list(shares.values())
    m = len(names)
    all_rows = float(sum(size * n for _, size, n in cells))
    family = [0.0] * m
    strata: dict[int, list[tuple[int, int]]] = {}
    for s, size, n in cells:
        strata.setdefault(s, []).append((size, n))
    out = []
    # The largest strata first: what rounding leaves is made up for by the small ones.
    for s, groups in sorted(strata.items(), key=lambda x: (-sum(size * n for size, n in x[1]), x[0])):
        total = float(sum(size * n for size, n in groups))
        have = [0.0] * m
        for size, n in sorted(groups, reverse=True):
            start = 1
            while n:
                lack = [w * total - h for w, h in zip(want, have)]
                most = max(lack)
                near = [j for j in range(m) if lack[j] > most - size]
                i = max(near, key=lambda j: ((want[j] * all_rows - family[j]) / want[j], -j))
                rest = max((lack[j] for j in range(m) if j not in near), default=min(lack))
                take = min(n, max(1, int((most - rest) // size) if len(near) == 1 else 1))
                if len(near) == m and n >= 4 * m:  # all lack the same: equal parts of what is left
                    take = n // (2 * m)
                    for j in range(m):
                        out.append((s, size, start, start + take - 1, names[j]))
                        have[j], family[j], start = have[j] + take * size, family[j] + take * size, start + take
                    n -= m * take
                    continue
                out.append((s, size, start, start + take - 1, names[i]))
                have[i], family[i] = have[i] + take * size, family[i] + take * size
                n, start = n - take, start + take
    return out


def _by_family(shares: dict[str, float]):
    def run(family: pd.DataFrame) -> pd.DataFrame:
        rows = hand_out([tuple(map(int, r)) for r in family[["stratum_id", "size", "n"]].to_numpy()], shares)
        return pd.DataFrame(rows, columns=["stratum_id", "size", "first", "last", "split"])

    return run


def assign_splits(df: DataFrame, strata: tuple[str, ...] = ("stratum", "template_family"), shares: dict[str, float] = SHARES, row: str = "row_id") -> DataFrame:
    """`row_id, group_row_id, split`: every row in one split, groups whole, shares as near as possible in each stratum and family.

    A group belongs to the stratum (all of `strata` together) that holds most of its rows (ties: the smallest). Groups of one size in one
    stratum are alike, so the greedy step runs over (stratum, size, number of groups) of a family (the last of `strata`), few rows however
    many groups there are, and hands out ranges of group numbers; groups are numbered by hash without a task per stratum. One rule serves
    strata of any size. Blank strata are one stratum of their own.
    """
    groups = cut(bound_rows(df, row))
    name = [F.coalesce(F.upper(F.trim(F.col(c).cast("string"))), F.lit("")) for c in strata]
    rows = df.select(F.col(row).cast("long").alias("row_id"), F.struct(F.xxhash64(*name).alias("cell"), F.xxhash64(name[-1]).alias("family")).alias("at")).where("row_id is not null")
    per = rows.join(groups, "row_id").groupBy("group_row_id", "at").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("group_row_id").agg(F.max_by("at", F.struct("n", "at")).alias("at"), F.sum("n").alias("size"))
    g = cut(g.select("group_row_id", "size", F.col("at.cell").alias("stratum_id"), F.col("at.family").alias("family")))
    sizes = g.groupBy("family", "stratum_id", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.groupBy("family").applyInPandas(_by_family(shares), "stratum_id long, size long, first long, last long, split string")
    numbered = ranked(g, ["stratum_id", "size"], F.xxhash64("group_row_id"), "no")
    placed = numbered.alias("g").join(plan.alias("p"), (F.col("g.stratum_id") == F.col("p.stratum_id")) & (F.col("g.size") == F.col("p.size")) & F.col("g.no").between(F.col("p.first"), F.col("p.last")))
    return lookup_join(groups, placed.select("group_row_id", "split"), "group_row_id", "inner").select("row_id", "group_row_id", "split")
