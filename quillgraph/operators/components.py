"""Connected components: local union-find forests merged hierarchically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import heavy_keys

#: Edges one task holds at once (about 40 bytes each while it works).
CHUNK = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each is connected to."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[: len(a)], idx[len(a) :]
    parent = np.arange(len(nodes))
    while len(u):
        lo, hi = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        keep = lo != hi
        u, v, lo, hi = u[keep], v[keep], lo[keep], hi[keep]
        if not len(u):
            break
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return nodes, nodes[parent]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, roots = forest(a, b)
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK, _level: int = 0) -> DataFrame:
    """`node long, component long` for every node of the edges; the component is its smallest node.

    Each task builds the forest of its own edges, so a hub is at most one row per task afterwards. Roots that share a node are linked and
    these links, fewer each time, are merged the same way; each level takes as many tasks as its own links need, until one task holds all
    that are left. Links of a node to smaller ones meet in one task, but for hubs, whose links are spread; every other level they meet at
    their smaller ends, so links that one way leaves apart the other brings together. Labels are joined back level by level. Nulls and
    self-links: a null endpoint is no link; a self-link makes a component of one node. An empty input gives an empty result. Repeated and
    reversed edges change nothing.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    if not _level:
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parts = max(1, -(-e.count() // chunk))
    near, far = ("b", "a") if _level % 2 == 0 else ("a", "b")
    hubs = heavy_keys(e, near, share=1 / 32, least=chunk // 4) if parts > 1 else []
    salt = F.when(F.col(near).isin(*hubs), F.pmod(F.xxhash64(far), F.lit(parts))).otherwise(F.lit(0)) if hubs else F.lit(0)
    local = e.repartition(parts, F.col(near), salt).mapInArrow(_local, "node long, root long")
    if parts == 1:
        return local.select("node", F.col("root").alias("component"))
    local = cut(local)
    least = local.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("k"))
    several = least.where("low <> high").select("node", "low")
    links = local.join(several, "node").where("root <> low").select(F.col("low").alias("a"), F.col("root").alias("b")).distinct()
    upper = connected_components(cut(links), chunk=chunk, _level=_level + 1)
    up = upper.select(F.col("node").alias("low"), "component")
    return least.select("node", "low").join(up, "low", "left").select("node", F.coalesce("component", "low").alias("component"))
