"""Evaluation passages inside a training corpus: an FM-index per shard, backward search of the passages' phrases, alignment of what is found."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .neardup import words

#: Words of a searched phrase. Twenty words of which a tenth are altered keep several runs of this length.
PHRASE = 4
#: Running words a document must hold of an item, and the part of them that must agree.
RUN, AGREE = 20, 0.85
#: Words that may be lost at the ends of a run.
ENDS = 3
#: Words outside common phrases that a passage must share.
OWN = 12
#: Words from one phrase's beginning to the next one's within a run: two altered words may stand near one another.
GAP = 2 * PHRASE + 2
#: Words that the phrases of a passage cover at least: of RUN words, two altered ones leave so many together.
SPAN = 12
#: Words beside a run that may belong to its passage.
REACH = 12
#: A phrase is common if more different texts than this, and more than this share of them, have it outside passages.
COMMON, COMMON_SHARE = 50, 0.005
#: Words of one index.
SHARD = 400_000
#: Characters of the evaluation set that a pass searches.
BLOCK = 32_000_000


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of `t` (non-negative integers) in the order of their suffixes, by doubling."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        if k < n:
            nxt[:-k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, k = new, 2 * k


class FMIndex:
    """Counts and locates phrases of symbols 1..sigma-1 in a text where 0 ends a segment.

    The Burrows-Wheeler transform is kept as a wavelet matrix whose bit planes have prefix counts, so a rank is one look-up per plane.
    Suffix positions are sampled at every `step`th position and at each segment start; stepping back from a row never leaves its segment.
    All queries are vectors.
    """

    def __init__(self, text: np.ndarray, sigma: int, step: int = 8) -> None:
        text = np.concatenate([text, [0]])
        ends = text == 0
        m = int(ends.sum())
        # Segment ends differ from one another, in text order, so equal segments need not be compared beyond their ends.
        distinct = text + m
        distinct[ends] = np.arange(m)
        sa = suffix_array(distinct)
        bwt = text[sa - 1]
        bwt[sa == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        starts = np.concatenate([[True], ends[:-1]])
        self.sampled = starts[sa] | (sa % step == 0)
        self.sa = np.where(self.sampled, sa, 0)
        self.planes, self.zeros = [], []
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.planes.append((level, np.concatenate([[0], np.cumsum(bit)]), bit))
            self.zeros.append(len(bwt) - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol of `c` stands in the first `i` rows, less where its run begins in the matrix's last plane."""
        for (level, ones, _), zero in zip(self.planes, self.zeros):
            b = (c >> level) & 1
            o = ones[i]
            i = np.where(b == 1, zero + o, i - o)
        return i

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one row of each phrase (a row of the matrix `phrases`), read from its end to its beginning."""
        c = phrases[:, -1]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        for j in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[:, j]
            base = self.rank(c, np.zeros(len(c), dtype=np.int64))
            lo, hi = (self.first[c] + self.rank(c, x) - base for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out = np.full(len(rows), -1, dtype=np.int64)
        todo, back = np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.sa[rows[done]] + back
            todo, rows = todo[~done], rows[~done]
            if not len(todo):
                break
            i, c = rows, np.zeros(len(rows), dtype=np.int64)
            for (level, ones, bit), zero in zip(self.planes, self.zeros):
                b = bit[i]
                c |= b << level
                o = ones[i]
                i = np.where(b == 1, zero + o, i - o)
            rows = self.first[c] + i - self.rank(c, np.zeros(len(c), dtype=np.int64))
            back += 1
        return out


@dataclass
class Phrases:
    """The evaluation items as words and as phrases. Its size follows a block of the evaluation set, never the corpus."""

    items: dict[int, list[int]]
    ids: dict[str, int]
    table: np.ndarray
    places: list[list[tuple[int, int]]]
    number: dict[int, list[int]]

    @classmethod
    def of(cls, texts: list[tuple[int, str | None]]) -> Phrases:
        ids: dict[str, int] = {}
        items = {i: [ids.setdefault(x, len(ids) + 1) for x in w] for i, t in texts if t and len(w := words(t)) >= RUN}
        at: dict[tuple[int, ...], int] = {}
        places: list[list[tuple[int, int]]] = []
        number: dict[int, list[int]] = {}
        for i, x in items.items():
            number[i] = []
            for p in range(len(x) - PHRASE + 1):
                g = at.setdefault(tuple(x[p : p + PHRASE]), len(at))
                if g == len(places):
                    places.append([])
                places[g].append((i, p))
                number[i].append(g)
        return cls(items, ids, np.array(list(at), dtype=np.int64).reshape(-1, PHRASE), places, number)

    def covered(self, n: int, found: list[tuple[int, int]], common: set[int]) -> bytearray:
        """Which of `n` words stand in a common phrase, from (phrase, place) of the phrases among them."""
        out = bytearray(n)
        for g, p in found:
            if g in common:
                out[p : p + PHRASE] = b"\1" * PHRASE
        return out


class Shard:
    """Different texts of one task as a sequence of the items' words, broken where another word stands, and the documents that have each."""

    def __init__(self, phrases: Phrases) -> None:
        self.p, self.docs, self.seq, self.size = phrases, [], [], 0
        self.seen: dict[bytes, list[int]] = {}

    def add(self, doc: int, text: str | None) -> None:
        if not text:
            return
        key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        if key in self.seen:
            self.seen[key].append(doc)
            return
        self.seen[key] = copies = [doc]
        get = self.p.ids.get
        x = np.array([get(w, 0) for w in words(text)] + [0], dtype=np.int64)
        self.seq.append(x)
        self.docs.append((key, copies))
        self.size += len(x)

    def located(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, place in all words) of every phrase's occurrences in order of place, and all words, by backward search in the shard's index."""
        x = np.concatenate(self.seq)
        known = x > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long = end - start >= PHRASE  # shorter runs of known words hold no phrase
        if not long.any():
            none = np.zeros(0, dtype=np.int64)
            return none, none, x
        start, end = start[long], end[long]
        step = np.zeros(len(x) + 1, dtype=np.int64)
        step[start] += 1
        step[end + 1] -= 1  # one word beyond each run ends it
        pos = np.flatnonzero(np.cumsum(step[:-1]))
        fm = FMIndex(x[pos], len(self.p.ids) + 1)
        lo, hi = fm.search(self.p.table)
        n = np.maximum(hi - lo, 0)
        found = np.flatnonzero(n)
        which = np.repeat(found, n[found])
        rows = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[found]) - n[found], n[found])
        at = pos[fm.locate(rows)]
        order = np.argsort(at)
        return which[order], at[order], x

    def evidence(self) -> Iterator[tuple[bytes, list[int], list[int], list[tuple[int, list[int], list[int], list[int]]]]]:
        """(hash, documents, phrases that stand alone, windows) of each text; a window is (first word, words, phrases, their places in it).

        Phrases with no more than GAP words between two form a run. One shorter than a passage says that its phrases also stand
        without the rest of an item; one of SPAN words or more may be a passage.
        """
        g, at, x = self.located()
        first = np.cumsum([0, *(len(s) for s in self.seq)])
        doc = np.searchsorted(first, at, side="right") - 1
        cut_at = np.flatnonzero((np.diff(at) > GAP) | (np.diff(doc) > 0)) + 1
        a, b = np.concatenate([[0], cut_at]), np.concatenate([cut_at, [len(at)]])
        alone: dict[int, list[int]] = defaultdict(list)
        windows: dict[int, list[tuple[int, list[int], list[int], list[int]]]] = defaultdict(list)
        if len(at):
            span = at[b - 1] + PHRASE - at[a]
            for s, e, k, d in zip(a.tolist(), b.tolist(), span.tolist(), doc[a].tolist()):
                if k < RUN - ENDS:
                    alone[d] += g[s:e].tolist()
                if k >= SPAN:
                    lo, hi = max(int(first[d]), int(at[s]) - REACH), min(int(first[d + 1]) - 1, int(at[e - 1]) + PHRASE + REACH)
                    windows[d].append((lo - int(first[d]), x[lo:hi].tolist(), g[s:e].tolist(), (at[s:e] - lo).tolist()))
        for d, (key, copies) in enumerate(self.docs):
            yield key, copies, sorted(set(alone.get(d, ()))), windows.get(d, [])


Step = tuple[int, int, int]  # place in the text, place in the item, 0 other or left-out word of the item, 1 the same word, 2 a word more in the text


def path(a: list[int], b: list[int], i0: int = 0, j0: int = 0) -> list[Step]:
    """The steps of the best alignment of all of `a` and `b` (the same word +1, anything else -2), their places counted from `i0` and `j0`."""
    n = len(b)
    score = [-2 * j for j in range(n + 1)]
    back = [bytearray([2] * (n + 1))]
    for i, w in enumerate(a):
        row, way = [-2 * (i + 1)], bytearray([1] * (n + 1))
        for j, v in enumerate(b):
            s = score[j] + (1 if w == v else -2)
            up, e = score[j + 1] - 2, row[j] - 2
            way[j + 1] = 0 if s >= up and s >= e else 1 if up >= e else 2
            row.append(max(s, up, e))
        score = row
        back.append(way)
    out, i, j = [], len(a), n
    while i or j:
        way = back[i][j]
        i, j = i - (way != 2), j - (way != 1)
        out.append((i0 + i, j0 + j, 2 if way == 1 else int(way == 0 and a[i] == b[j])))
    return out[::-1]


def seeds(x: list[int], y: list[int], hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first word in `x`, end, first word in `y`) of the longest equal runs of words that hold the shared phrases `hits`."""
    out = []
    end: dict[int, int] = {}
    for w, q in sorted(hits):
        d = w - q
        if w < end.get(d, -1):
            continue
        i, j = w, q
        while i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        e, f = w + PHRASE, q + PHRASE
        while e < len(x) and f < len(y) and x[e] == y[f]:
            e, f = e + 1, f + 1
        end[d] = e
        out.append((i, e, j))
    return sorted(out)


def chains(runs: list[tuple[int, int, int]], cx: bytearray, cy: bytearray) -> list[list[tuple[int, int, int]]]:
    """Runs in line with one another, best chains first, every run in one chain; own words between runs cost 2 each, overlaps are trimmed."""
    n = len(runs)
    score, before, trim = [0] * n, [-1] * n, [0] * n
    px, py = [list(accumulate((1 - c for c in z), initial=0)) for z in (cx, cy)]
    for k, (s, e, q) in enumerate(runs):
        score[k] = e - s
        for i in range(k - 1, -1, -1):
            s1, e1, q1 = runs[i]
            if px[s] - px[s1] > 2 * len(cy):  # runs are in order of place, and no chain scores more than the item's words
                break
            f1 = q1 + e1 - s1
            over = max(0, e1 - s, f1 - q)
            if over >= e - s or s1 == s or q <= q1:
                continue
            gap = max(px[s + over] - px[e1], py[q + over] - py[f1])
            if score[i] > 2 * gap and score[i] + e - s - over - 2 * gap > score[k]:
                score[k], before[k], trim[k] = score[i] + e - s - over - 2 * gap, i, over
    used, out = [False] * n, []
    for k in sorted(range(n), key=lambda k: (-score[k], k)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            s, e, q = runs[k]
            up = before[k]
            o = trim[k] if up >= 0 and not used[up] else 0
            chain.append((s + o, e, q + o))
            k = up
        if chain:
            out.append(chain[::-1])
    return out


def steps_of(x: list[int], y: list[int], chain: list[tuple[int, int, int]]) -> list[Step]:
    """A chain's alignment: its runs, the words between them and REACH words before and after."""
    s, _, q = chain[0]
    lo = min(s, q, REACH)
    out = path(x[s - lo : s], y[q - lo : q], s - lo, q - lo) if lo else []
    at, aq = s, q
    for s, e, q in chain:
        if (s - at) * (q - aq) <= 2_500:
            out += path(x[at:s], y[aq:q], at, aq)
        else:  # far apart: the shorter gap word by word
            out += [(min(at + i, s), min(aq + i, q), 2 if aq + i >= q else 0) for i in range(max(s - at, q - aq))]
        out += [(i, q + i - s, 1) for i in range(s, e)]
        at, aq = e, q + e - s
    hi = min(len(x) - at, len(y) - aq, REACH)
    return out + (path(x[at : at + hi], y[aq : aq + hi], at, aq) if hi else [])


def stretches(steps: list[Step]) -> list[tuple[int, int]]:
    """First and end step of the longest stretches of an alignment of which AGREE agrees, apart from one another, in order.

    A stretch begins and ends with agreeing words, every beginning and end of it scores, as in a best alignment, and OWN words agree.
    """
    runs: list[list[int]] = []
    moved = [0]
    for k, (_, _, kind) in enumerate(steps):
        moved.append(moved[-1] + (kind < 2))
        if kind == 1 and runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        elif kind == 1:
            runs.append([k, k + 1])
    best, span = 0, (0, 0)
    for x, (first, _) in enumerate(runs):
        n = score = top = 0
        end = first
        for start, stop in runs[x:]:
            score -= 2 * (start - end)
            if score <= 0 and n:
                break
            n, score, end = n + stop - start, score + stop - start, stop
            if score > top:  # else an end of it scores nothing
                top = score
                if n > best and n >= AGREE * (moved[stop] - moved[first]):
                    best, span = n, (first, stop)
    if best < OWN:
        return []
    s, e = span
    return [*stretches(steps[:s]), span, *((x + e, y + e) for x, y in stretches(steps[e:]))]


def passages(p: Phrases, common: set[int], x: list[int], g: list[int], at: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(item, first word, end word, words that agree) of every stretch of an item in a window of words with the phrases `g` at the places `at`.

    Words that differ inside a common phrase of either side are passed over, so a passage may lose or gain a common sentence; of what agrees,
    OWN words must stand outside common phrases.
    """
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, w in zip(g, at):
        if n not in common:
            for item, q in p.places[n]:
                hits[item].append((w, q))
    cx = None
    for item, h in hits.items():
        if len(h) < 3:
            continue
        y = p.items[item]
        runs = seeds(x, y, h)
        if sum(e - s for s, e, _ in runs) < PHRASE + 2:
            continue
        if cx is None:
            cx = p.covered(len(x), list(zip(g, at)), common)
        cy = p.covered(len(y), list(zip(p.number[item], range(len(y)))), common)
        found = []
        for chain in chains(runs, cx, cy):
            steps = [t for t in steps_of(x, y, chain) if t[2] == 1 or not ((t[0] < len(x) and cx[t[0]]) if t[2] == 2 else cy[t[1]])]
            for k, m in stretches(steps):
                part = steps[k:m]
                same = sum(t[2] == 1 for t in part)
                own = sum(t[2] == 1 and not cx[t[0]] and not cy[t[1]] for t in part)
                # Altered words at a passage's ends cannot be told from other text, so the aligned part may be a little shorter.
                if sum(t[2] < 2 for t in part) >= RUN - ENDS and own >= OWN:
                    found.append((part[0][0], part[-1][0] + 1, same))
        reach = -1
        for first, end, same in sorted(found, key=lambda f: (f[0], -f[1], -f[2])):
            if end > reach:  # else within another one
                reach = end
                yield item, first, end, same


def _shards(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard(phrases)
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                shard.add(doc, text)
                if shard.size >= SHARD:
                    yield shard
                    shard = Shard(phrases)
    if shard.size:
        yield shard


_WINDOW = pa.struct([("first", pa.int32()), ("words", pa.list_(pa.int32())), ("g", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))])
_EVIDENCE = "h binary, docs array<long>, alone array<int>, windows array<struct<first: int, words: array<int>, g: array<int>, at: array<int>>>"
_FOUND = "doc_id long, item_id long, first_word int, end_word int, n_same int"


def _leaks_of(source: DataFrame, phrases: Phrases) -> DataFrame:
    spark = source.sparkSession
    held = spark.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(held.value, batches):
            rows = list(shard.evidence())
            cols = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))]
            shown = [[{"first": f, "words": x, "g": g, "at": at} for f, x, g, at in r[3]] for r in rows]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shown, pa.list_(_WINDOW))], names=["h", "docs", "alone", "windows"])

    seen = cut(source.mapInArrow(search, _EVIDENCE))
    # Equal texts have equal phrases, so any of them stands for its copies.
    alone = seen.where(F.size("alone") > 0).groupBy("h").agg(F.any_value("alone").alias("g")).select(F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    texts = seen.select("h").distinct().count()
    common = {r[0] for r in alone.where(F.col("n") > max(COMMON, int(COMMON_SHARE * texts))).collect()}  # at most the items' phrases
    known = spark.sparkContext.broadcast(common)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, c = held.value, known.value
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = []
                for docs, windows in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w in windows:
                        for item, first, end, same in passages(p, c, w["words"], w["g"], w["at"]):
                            rows += [(doc, item, w["first"] + first, w["first"] + end, same) for doc in docs]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "first_word", "end_word", "n_same"])

    return seen.where(F.size("windows") > 0).select("docs", "windows").mapInArrow(verify, _FOUND)


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """`doc_id, item_id, first_word, end_word, n_same` of every stretch of a document that holds RUN or more running words of an item.

    The items are a query set that is searched in all documents: each task indexes its texts, copies once, and locates every phrase of the
    items, whatever its frequency. Runs of phrases long enough to be a passage are aligned with the items, from equal runs of words chained
    in line. Words compare without case, white space and punctuation; about one in ten may be altered, added or left out. A phrase is
    common, and counts only within a passage that shares OWN words besides, if many different texts have it without the rest of a passage
    around it, so neither copies of a text nor any number of leaks of an item make its phrases common.

    The set is read in blocks of about `block` characters, each one pass, so what is broadcast is bounded; a single item is not cut.
    Nothing but hashes of texts, phrase numbers and words' numbers around passages leaves the pass. Null and empty texts and items shorter
    than RUN words leak nothing; a repeated document is reported each time; long texts are read whole.
    """
    spark = docs.sparkSession
    source = spread(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")))
    small = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    size = small.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // block))
    if parts > 1:
        small = cut(small)
    out = None
    for k in range(parts):
        mine = small if parts == 1 else small.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        phrases = Phrases.of([(r[0], r[1]) for r in mine.orderBy("item_id").collect()])
        if len(phrases.table):
            found = _leaks_of(source, phrases)
            found = cut(found) if parts > 1 else found
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def removal_spans(found: DataFrame) -> DataFrame:
    """`doc_id, first_word, end_word`: the leaked stretches of each document, overlapping ones merged."""
    from pyspark.sql import Window as W

    before = W.partitionBy("doc_id").orderBy("first_word", "end_word").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("doc_id").orderBy("first_word", "end_word").rowsBetween(W.unboundedPreceding, W.currentRow)
    fresh = F.when(F.col("first_word") <= F.max("end_word").over(before), 0).otherwise(1)
    return (
        found.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(upto))
        .groupBy("doc_id", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")).drop("span")
    )
