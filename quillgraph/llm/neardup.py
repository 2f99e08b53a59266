"""Near-duplicate records: inverted index of positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import lookup_join
from ..session import cut, spread

SHARE = 0.75
#: Slots of the frequency table by which items are ordered: one int each, whatever the corpus.
SLOTS = 1 << 18
#: A key with more classes is refined by one more item.
HOT = 400
#: Items that two similar records are bound to share in their prefixes.
SHARED = 3
#: Classes up to which an item is an index key by itself.
RARE = 4


def words(text: str) -> list[str]:
    """White-space words in lower case without punctuation."""
    out = []
    for w in text.lower().split():
        if not w.isalnum():
            w = "".join(c for c in w if c.isalnum())
        if w:
            out.append(w)
    return out


def positional_bytes(ws: list[str]) -> list[int]:
    """One item for each word and repetition: a 56-bit position and the byte that stands there, as one long."""
    seen: dict[str, int] = {}
    out = []
    for w in ws:
        k = seen[w] = seen.get(w, 0) + 1
        out.append(_signed(xxhash.xxh3_64_intdigest(f"{k} {w}")))
    return sorted(out)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, items = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = positional_bytes(words(t)) if t else []
            if x:
                ids.append(i)
                items.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["row_id", "items"])


def needed(n: int) -> int:
    """Words that a record of n words shares at least with any record similar to it."""
    return -int(-SHARE * n // 1)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x & (SLOTS - 1)).astype(np.int64)


def _prefixes(freq: np.ndarray):
    """class_id, items → class_id and the rarest items of which similar classes share SHARED, those of at most RARE classes apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rare, often = [], [], []
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(x) < SHARED:  # only the same words are similar
                    continue
                a = np.array(x, dtype=np.int64)
                n = freq[_slot(a)]
                order = np.lexsort((a, n))[: len(a) - needed(len(a)) + SHARED]
                ids.append(c)
                rare.append(a[order][(n[order] > 1) & (n[order] <= RARE)].tolist())
                often.append(a[order][n[order] > RARE].tolist())
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rare, long), pa.array(often, long)], names=["class_id", "rare", "prefix"])

    return run


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _pair_key(p: int, q: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(np.array([p, q] if p < q else [q, p], dtype=np.int64).tobytes()))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys and what sharing one proves: a rare item by itself, a pair of frequent ones one of the pairs that SHARED items make."""
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            ids, keys, proof = [], [], []
            for c, rare, often in zip(*(part.column(j).to_pylist() for j in range(3))):
                pairs = [_pair_key(p, q) for p, q in combinations(often, 2)] if len(often) >= SHARED else []
                keys += rare + pairs
                proof += [SHARED] * len(rare) + [1] * len(pairs)
                ids += [c] * (len(rare) + len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(proof, pa.int32())], names=["k", "class_id", "proof"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = [], []
        for k, c, x in zip(*(b.column(i).to_pylist() for i in range(3))):
            own = next((pq for pq in combinations(x, 2) if _pair_key(*pq) == k), ())
            mine = [_pair_key(k, p) for p in x if p not in own]
            keys.extend(mine)
            ids.extend([c] * len(mine))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["k", "class_id"])


def _pairs(keys: DataFrame) -> DataFrame:
    a, b = keys.select("k", F.col("class_id").alias("a"), "proof"), keys.select("k", F.col("class_id").alias("b"))
    return a.join(b, "k").where("a < b").select("a", "b", "proof")


def _indexed(df: DataFrame, text: str, row: str, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members `row_id, class_id`; classes `class_id, items`; index `k, class_id, proof`) of the texts that have words."""
    rows = cut(spread(df.select(F.col(row).cast("long").alias("row_id"), F.col(text).alias("text")).where("row_id is not null and text is not null")).mapInArrow(_items, "row_id long, items array<long>"))
    same = F.unhex(F.md5(F.concat_ws(",", F.transform("items", lambda x: x.cast("string")))))
    rows = rows.withColumn("same", same)
    classes = cut(rows.groupBy("same").agg(F.min(F.struct("row_id", "items")).alias("r")).select("same", F.col("r.row_id").alias("class_id"), F.col("r.items").alias("items")))
    members = rows.select("row_id", "same").join(classes.select("same", "class_id"), "same").select("row_id", "class_id")

    freq = np.zeros(SLOTS, dtype=np.int64)
    slots = classes.select(F.explode("items").alias("i")).groupBy(F.col("i").bitwiseAND(F.lit(SLOTS - 1)).alias("s")).count()
    for s, n in slots.collect():  # at most SLOTS rows
        freq[s] = n
    prefixes = cut(spread(classes.select("class_id", "items")).mapInArrow(_prefixes(freq), "class_id long, rare array<long>, prefix array<long>"))
    keys = cut(prefixes.mapInArrow(_keys, "k long, class_id long, proof int"))
    sizes = keys.groupBy("k").count().where("count > 1")
    cold = keys.join(sizes.where(F.col("count") <= hot).select("k"), "k", "left_semi")
    warm = keys.join(sizes.where(F.col("count") > hot).select("k"), "k", "left_semi").join(prefixes, "class_id").select("k", "class_id", "prefix").mapInArrow(_refined, "k long, class_id long")
    # A refined key stands for three shared items, so it is proof enough by itself.
    return members, classes.select("class_id", "items"), cold.unionByName(warm.withColumn("proof", F.lit(SHARED)))


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """`class_a, class_b, shared, words` of the candidate pairs `a, b` that agree in SHARE of the longer one's words."""
    ia = classes.select(F.col("class_id").alias("a"), F.col("items").alias("ia"))
    ib = classes.select(F.col("class_id").alias("b"), F.col("items").alias("ib"))
    longer = F.greatest(F.size("ia"), F.size("ib"))
    shared = F.size(F.array_intersect("ia", "ib"))
    d = pairs.join(ia, "a").join(ib, "b").select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), shared.alias("shared"), longer.alias("words"))
    return d.where(F.col("shared") >= F.lit(SHARE) * F.col("words"))


def _counted(met: DataFrame) -> DataFrame:
    """The pairs that meet in as many keys as similar classes are bound to."""
    return met.groupBy("a", "b").agg(F.sum("proof").alias("proof")).where(F.col("proof") >= SHARED * (SHARED - 1) // 2).select("a", "b")


def near_duplicates(df: DataFrame, text: str, row: str = "row_id", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members `row_id, class_id`; links `class_a, class_b, shared, words`) of the rows whose `text` agrees in SHARE of the longer one's words.

    Words count in any order, with repetitions, ignoring case and punctuation. Rows with the same words are one class (named by its
    smallest row) and are not paired with each other; links join classes. Each word and repetition is a positional byte. With items in
    one global order from rare to frequent, two similar classes share at least SHARED items among their rarest (n - needed(n) + SHARED).
    An item that at most RARE classes have is an index key by itself (one of a single class is none); if all shared items are more
    frequent, their pairs are, and a pair of classes must meet in the SHARED over 2 keys these make. Pairs of classes that do are verified
    on all their items. A key with more than `hot` classes is replaced by keys with a third item, of which similar classes share one too;
    nothing is capped. Order comes from a table of SLOTS counts over all classes. Blank and null texts, and texts without letters or
    digits, are in no class; texts of one or two words are similar to the same words only.
    """
    members, classes, keys = _indexed(df, text, row, hot)
    return members, _verified(_counted(_pairs(keys)), classes)


def group_links(df: DataFrame, text: str, row: str = "row_id", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members `row_id, class_id`; links `a, b`) that join the same classes as `near_duplicates` by chains, without all pairs of a large group.

    First each class is compared with the smallest class of each of its keys only. Keys whose classes are then all joined are done; in the
    others only classes that are not joined yet are paired. So a group of one template costs a link a class, not a link a pair.
    """
    members, classes, keys = _indexed(df, text, row, hot)
    keys = cut(keys)
    low = keys.groupBy("k").agg(F.min("class_id").alias("a"))
    star = lookup_join(keys.select("k", F.col("class_id").alias("b")), low, "k", "inner").where("a <> b").select("a", "b").distinct()
    first = cut(_verified(star, classes).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    joined = connected_components(first).select(F.col("node").alias("class_id"), "component")
    k = cut(keys.join(joined, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    apart = k.groupBy("k").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("k")
    k = k.join(apart, "k", "left_semi")
    a, b = k.select("k", F.col("class_id").alias("a"), F.col("component").alias("ca"), "proof"), k.select("k", F.col("class_id").alias("b"), F.col("component").alias("cb"))
    rest = _verified(_counted(a.join(b, "k").where("a < b and ca <> cb").select("a", "b", "proof")), classes)
    return members, first.unionByName(rest.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))


def duplicate_pairs(df: DataFrame, texts: list[str], row: str = "row_id") -> DataFrame:
    """`row_id_a, row_id_b` (smaller first) of all rows that agree in one of the `texts`, copies included."""
    out = None
    for t in texts:
        members, links = near_duplicates(df, t, row)
        members = cut(members)
        links = links.select("class_a", "class_b")
        a, b = members.select(F.col("row_id").alias("x"), F.col("class_id").alias("class_a")), members.select(F.col("row_id").alias("y"), F.col("class_id").alias("class_b"))
        across = links.join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
        b2 = b.withColumnRenamed("class_b", "class_a")
        within = a.join(b2, "class_a").where("x < y").select(F.col("x").alias("row_id_a"), F.col("y").alias("row_id_b"))
        p = across.unionByName(within)
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def duplicate_groups(df: DataFrame, texts: list[str], row: str = "row_id") -> DataFrame:
    """`row_id, group_row_id` of the rows that have a near-duplicate, by chains of similar texts; copies are linked to their class only."""
    edges = None
    for t in texts:
        members, links = group_links(df, t, row)
        e = members.where("row_id <> class_id").select(F.col("row_id").alias("a"), F.col("class_id").alias("b")).unionByName(links)
        edges = e if edges is None else edges.unionByName(e)
    return connected_components(edges).select(F.col("node").alias("row_id"), F.col("component").alias("group_row_id"))
