"""The same request in two splits: winnowing fingerprints joined across splits, chained and extended; plans compared in canonical form."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut, spread
from .neardup import SLOTS
from .orgnames import distance

TRAIN, HELD_OUT = ("train",), ("dev", "final_test", "ood")
#: Characters of a hashed gram, and grams of a window.
GRAM, WINDOW = 12, 8
#: A fingerprint of more texts than this is looked up together with a second one.
HOT = 500
#: Part of the longer text's fingerprints that candidates share, and of the shorter text that their chained seeds cover.
SKETCH, COVERED = 0.4, 0.7
#: A word of more than this share of the questions belongs to the templates, unless it is mostly a value of the plan (a name, a kind).
TEMPLATE_SHARE = 0.01
#: Words that may differ between two wordings from which is learnt what asks nothing.
DIFFERING = 4
#: A word asks nothing if it comes and goes in this many wordings of one plan, and this share of them, and hardly ever between plans.
SUPPORT, SUPPORT_SHARE, AGAINST = 3, 0.0005, 0.1

_WORD = re.compile(r"\w+")


def plan_key(plan: Column) -> Column:
    """Operation, answer field and sorted constraints of a plan in JSON, however laid out; null for a blank, broken or empty one."""
    kind = "answer_operation string, answer_field string, constraints array<struct<field: string, op: string, value: string>>"
    p = F.from_json(plan, kind, {"mode": "PERMISSIVE"})
    # A broken text may still give its first fields, so the whole must be an object that ends.
    whole = plan.rlike(r"^[\s]*\{") & plan.rlike(r"\}[\s]*$") & F.try_parse_json(plan).isNotNull()
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    each = F.array_sort(F.array_distinct(F.transform(p["constraints"], lambda x: F.concat_ws("\u0001", low(x["field"]), low(x["op"]), F.regexp_replace(low(x["value"]), r"\s+", " ")))))
    key = F.concat_ws("\u0002", low(p["answer_operation"]), low(p["answer_field"]), F.array_join(each, "\u0002"))
    return F.when(whole & (low(p["answer_operation"]) != "") & p["constraints"].isNotNull(), key)


def _one_edit(a: str, b: str) -> bool:
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def unmatched(a: list[str], b: list[str], template: frozenset[str]) -> tuple[list[str], list[str], dict[str, str]]:
    """Words of each text that the other one lacks, and the misspelt ones with what they are read as.

    A word is read as another one an edit away (letter added, left out, changed or swapped with its neighbour) if one of the two belongs to
    the templates, both are of letters and have four or more: names, years and codes are never read as others.
    """
    x, y = Counter(a), Counter(b)
    left, right = sorted((x - y).elements()), sorted((y - x).elements())
    read: dict[str, str] = {}
    for w in list(left):
        for v in right:
            if len(w) > 3 and len(v) > 3 and w.isalpha() and v.isalpha() and (w in template or v in template) and _one_edit(w, v):
                read[w] = v
                left.remove(w)
                right.remove(v)
                break
    return left, right, read


def _two_edits(a: str, b: str) -> bool:
    """Whether some word is at most one edit from both."""
    swaps = lambda w: (w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1))
    return distance(a, b) <= 2 or any(_one_edit(x, b) for x in swaps(a)) or any(_one_edit(a, x) for x in swaps(b))


def asking(template: frozenset[str], neutral: frozenset[str]) -> Callable[[list[str]], tuple[str, ...]]:
    """What a text asks, from its words: the same for any two texts that `unmatched` and the neutral words can make one request.

    Template words that one word may be read as are one class, with all words an edit away from them. Neutral words, those an edit away
    from one, and classes that such a word may belong to are left out. All others stand for themselves.
    """
    long = lambda ws: sorted(w for w in ws if len(w) > 3 and w.isalpha())
    ts, ns = long(template), long(neutral)
    of = {t: t for t in ts}
    for t, u in combinations(ts, 2):
        if of[t] != of[u] and _two_edits(t, u):
            old, new = of[u], of[t]
            of = {w: new if c == old else c for w, c in of.items()}
    left_out = {of[t] for t in ts if t in neutral or any(_two_edits(t, n) for n in ns)}
    # Words an edit apart are equal or have a word in common that lacks a letter of the longer one or of both.
    less = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
    near: dict[str, set[str]] = {}
    for w in {*ts, *ns}:
        for x in less(w):
            near.setdefault(x, set()).add(w)

    @lru_cache(500_000)
    def told(w: str) -> str:
        if w in neutral:
            return ""
        if len(w) < 4 or not w.isalpha():
            return w
        by = {x for k in less(w) for x in near.get(k, ()) if x == w or _one_edit(w, x)}
        if any(x in neutral or of[x] in left_out for x in by):
            return ""
        return min((of[x] for x in by), default=w)

    return lambda words: tuple(sorted(x for x in map(told, words) if x))


def same_order(a: list[str], b: list[str], template: frozenset[str], neutral: frozenset[str], read: dict[str, str]) -> bool:
    """Whether two texts of the same asking words say the same of the same things: in one order, or with clauses moved whole.

    In a moved clause each run of words outside the templates (a name, a year, a code) stays after or before the same template word.
    """
    # A misspelt word and what it is read as are one word wherever they stand, in both texts.
    alike = {w: min(pair) for pair in read.items() for w in pair}
    silent = neutral | {w for pair in read.items() if not neutral.isdisjoint(pair) for w in pair}
    x, y = ([alike.get(w, w) for w in ws if w not in silent] for ws in (a, b))
    if x == y:
        return True

    def runs(ws: list[str]) -> tuple[Counter, Counter]:
        after, before = Counter(), Counter()
        for content, part in groupby(enumerate(ws), key=lambda t: t[1] not in template):
            if content:
                part = list(part)
                i, j = part[0][0], part[-1][0] + 1
                run = tuple(w for _, w in part)
                after[ws[i - 1] if i else "", run] += 1
                before[run, ws[j] if j < len(ws) else ""] += 1
        return after, before

    p, q = runs(x), runs(y)
    return Counter(x) == Counter(y) and (p[0] == q[0] or p[1] == q[1])


def winnow(s: str) -> dict[int, int]:
    """Selected fingerprints of a text and where they stand: of each WINDOW grams the least hash, the last one of equals."""
    n = len(s) - GRAM + 1
    if n < 1:
        return {xxhash.xxh3_64_intdigest(s) >> 1: 0} if s else {}
    h = [xxhash.xxh3_64_intdigest(s[i : i + GRAM]) >> 1 for i in range(n)]
    out: dict[int, int] = {}
    for i in range(max(1, n - WINDOW + 1)):
        part = h[i : i + WINDOW]
        low = min(part)
        out.setdefault(low, i + len(part) - 1 - part[::-1].index(low))
    return out


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _asked(template: frozenset[str], neutral: frozenset[str]):
    """text_id, question, train, held → the same with a hash of what is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = asking(template, neutral)
        for b in batches:
            asks = [_long(xxhash.xxh3_64_intdigest(" ".join(ask(s.split())))) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(asks, pa.int64())], names=["text_id", "question", "train", "held", "asks"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # Texts that ask something else are never the same request, so what is asked is part of every fingerprint.
        prints = [sorted(xxhash.xxh3_64_intdigest(f"{h} {asks}") >> 1 for h in winnow(s)) for s, asks in zip(b.column(1).to_pylist(), b.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(prints, pa.list_(pa.int64()))], names=["text_id", "question", "train", "held", "prints"])


def lookup_keys(prints: list[int], freq: np.ndarray, hot: int) -> list[int]:
    """Keys of which texts with SKETCH of the longer one's fingerprints in common share at least one.

    With `need` fingerprints in common, the rarest common one is among the first n - need + 1 of either text in order of frequency, and the
    next one among the first n - need + 2. A fingerprint of at most `hot` texts is a key by itself; one of more is one with each that may
    come next, and also by itself in a text so short that one in common is enough.
    """
    n = len(prints)
    need = max(1, int(np.ceil(SKETCH * n - 1e-9)))
    by = sorted((int(freq[p & (SLOTS - 1)]), p) for p in prints)
    keys = []
    for i, (k, p) in enumerate(by[: n - need + 1]):
        if k < 2:
            continue  # no other text has it
        if k <= hot or need == 1:
            keys.append(p)
        if k > hot:
            keys += [xxhash.xxh3_64_intdigest(f"{p} {q}") >> 1 for _, q in by[i + 1 : n - need + 2]]
    return keys


def _lookups(freq: np.ndarray, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in lookup_keys(x, freq, hot)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["k", "text_id"])

    return run


def coverage(s: str, t: str) -> float:
    """The share of the shorter text that collinear seeds (equal fingerprints), extended as far as the texts agree, cover."""
    x, y = winnow(s), winnow(t)
    end_s = end_t = covered = 0
    for i, j in sorted((x[h], y[h]) for h in x.keys() & y.keys()):
        if i < end_s or j < end_t:
            continue  # inside what is covered, or out of line
        while i > end_s and j > end_t and s[i - 1] == t[j - 1]:
            i, j = i - 1, j - 1
        n = 0
        while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
            n += 1
        end_s, end_t, covered = i + n, j + n, covered + n
    return covered / max(min(len(s), len(t)), 1)


def _compared(template: frozenset[str], most: int):
    """Pairs of texts → the words by which they differ (pairs that differ in more than `most` words left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, t in zip(*(b.column(k).to_pylist() for k in range(2))):
                left, right, _ = unmatched(s.split(), t.split(), template)
                if len(left) + len(right) <= most:
                    rows.append(sorted({*left, *right}))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["words"])

    return run


def _decided(template: frozenset[str], neutral: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, j, s, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                x, y = s.split(), t.split()
                left, right, read = unmatched(x, y, template)
                words = {*left, *right}
                # A word an edit away from one that asks nothing is that one misspelt.
                spare = {w for w in words if w not in neutral and w not in template and w.isalpha() and any(len(w) > 3 and len(n) > 3 and _one_edit(w, n) for n in neutral)}
                if neutral.issuperset(words - spare):
                    moved = sorted(x) == sorted(y)
                    c = coverage(s, t)
                    if (c >= COVERED or moved) and same_order(x, y, template, neutral | spare, read):
                        rows.append((i, j, c))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "coverage"])

    return run


def read_rows(rows: DataFrame) -> DataFrame:
    """`row_id, train, held, question, text_id, key, plan` of rows with an id: the question as plain words, the key of the plan, and a 64-bit hash of either (null where there is none)."""
    split = F.lower(F.trim("split"))
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower("question"), "&", " and "), r"[^\p{L}\p{N}]+", " ")), r"\s+", " ")
    d = rows.select(
        F.col("row_id").cast("long").alias("row_id"), F.coalesce(split.isin(*TRAIN), F.lit(False)).alias("train"), F.coalesce(split.isin(*HELD_OUT), F.lit(False)).alias("held"),
        F.nullif(plain, F.lit("")).alias("question"), plan_key(F.col("gold_plan")).alias("key"),
    ).where("row_id is not null")
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    return d.withColumns({"text_id": hashed("question"), "plan": hashed("key")})


def template_words(every: DataFrame, n: int) -> frozenset[str]:
    """Words of more than TEMPLATE_SHARE of the `n` different texts that are not mostly values of their plans."""
    values = F.array_join(F.regexp_extract_all("key", F.lit("\u0001[^\u0001\u0002]*\u0001([^\u0002]*)"), 1), " ")
    values = F.regexp_replace(F.lower(values), r"[^\p{L}\p{N}]+", " ")
    texts = every.where("text_id is not null").select("text_id", "question", values.alias("v")).groupBy("text_id").agg(F.any_value("question").alias("question"), F.min("v").alias("v"))
    said = texts.select(F.array_distinct(F.split("question", " ")).alias("ws"), F.col("v").isNotNull().alias("told"), F.split("v", " ").alias("v"))
    said = said.select("told", "ws", F.array_intersect("ws", "v").alias("hit"))
    each = said.select("told", F.explode(F.transform("ws", lambda w: F.struct(w.alias("w"), F.coalesce(F.array_contains("hit", w), F.lit(False)).alias("value")))).alias("x"))
    often = each.groupBy("x.w").agg(F.count(F.lit(1)).alias("n"), F.count_if("told").alias("told"), F.count_if("x.value").alias("value"))
    often = often.where((F.col("n") > max(3, TEMPLATE_SHARE * n)) & (2 * F.col("value") <= F.col("told")))
    return frozenset(r[0] for r in often.select("w").collect() if not any(c.isdigit() for c in r[0]))  # fewer than words a question / TEMPLATE_SHARE


def learnt_neutral(every: DataFrame, slim: DataFrame, n: int, template: frozenset[str]) -> frozenset[str]:
    """Words that ask nothing: they come and go between wordings of one plan, and do not tell plans apart.

    `every` has `text_id, question`, `slim` the `text_id, plan` of the rows. Each text of a plan is compared with the plan's shortest one;
    words by which few-word differences are made speak for themselves. Texts of different plans that differ in one or two of these words,
    and in nothing else, speak against these; all are found, by what is left of the texts without them. What is collected is at most
    DIFFERING / SUPPORT_SHARE words.
    """
    p = slim.where("text_id is not null and plan is not null").select("plan", "text_id").distinct()
    several = p.withColumn("other", F.max("text_id").over(W.partitionBy("plan")) != F.min("text_id").over(W.partitionBy("plan"))).where("other").select("plan", "text_id")
    t = every.where("text_id is not null").select("text_id", "question")
    d = cut(several.hint("merge").join(t, "text_id").groupBy("plan", "text_id").agg(F.any_value("question").alias("question")))
    base = d.groupBy("plan").agg(F.min(F.struct(F.length("question").alias("n"), "text_id", "question")).alias("base"))
    same = lookup_join(d, base, "plan", "inner").where(F.col("text_id") != F.col("base.text_id"))
    same = same.select(F.col("question").alias("s"), F.col("base.question").alias("t"))
    for_it = same.mapInArrow(_compared(template, DIFFERING), "words array<string>").select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    support = {r[0]: r[1] for r in for_it.where(F.col("n") >= max(SUPPORT, int(SUPPORT_SHARE * n))).collect() if not any(c.isdigit() for c in r[0])}
    if not support:
        return frozenset()
    ws, spoken = F.split("question", " "), F.array(*map(F.lit, sorted(support)))
    own = every.where("text_id is not null and plan is not null").select("text_id", "plan", F.xxhash64(F.array_sort(F.filter(ws, lambda w: ~F.array_contains(spoken, w)))).alias("rest"), F.array_sort(F.filter(ws, lambda w: F.array_contains(spoken, w))).alias("words"))
    plans = W.partitionBy("rest")
    own = own.withColumn("other", F.max("plan").over(plans) != F.min("plan").over(plans)).where("other").select("rest", "plan", "text_id", "words").distinct()
    own = cut(own)
    x, y = own.select("rest", F.col("plan").alias("p"), "text_id", F.col("words").alias("x")), own.select("rest", F.col("plan").alias("q"), F.col("words").alias("y")).distinct()
    more = F.array_except("x", "y")
    met = x.join(y, "rest").where("p <> q").where((F.size(more) > 0) & (F.size(more) + F.size(F.array_except("y", "x")) <= 2) & (F.abs(F.size("x") - F.size("y")) <= 2))
    against = {r[0]: r[1] for r in met.select("text_id", F.explode(more).alias("w")).groupBy("w").agg(F.count_distinct("text_id").alias("m")).collect()}
    return frozenset(w for w, k in support.items() if against.get(w, 0) <= AGAINST * k)


def same_questions(every: DataFrame, slim: DataFrame, hot: int = HOT) -> DataFrame:
    """`a, b, coverage` (a in training, b held out) of the texts that ask the same in other words that ask nothing.

    Only texts that ask the same (`asking`) as another one across the splits are kept. Fingerprints are winnowed from each of them. All
    that share SKETCH of the longer sketch across the splits are candidates, found by prefixes of their fingerprints from rare to frequent
    (`lookup_keys`); nothing is capped. Equal fingerprints are chained in line and extended; what is left of either text are the words by
    which they differ. A pair is the same request if every such word is a misspelt template word or is learnt from the plans to ask
    nothing, its seeds cover COVERED of the shorter text or all its words are only moved, and names, years and codes stand by the same
    words. Frequencies come from a table of fixed size over all texts kept.
    """
    n = slim.where("text_id is not null").select("text_id").distinct().count()
    template = template_words(every, n)
    neutral = learnt_neutral(every, slim, n, template)
    t = every.where("text_id is not null and (train or held)").select("text_id", "question", "train", "held")
    asked = spread(t).mapInArrow(_asked(template, neutral), "text_id long, question string, train boolean, held boolean, asks long")
    alike = W.partitionBy("asks")
    asked = asked.withColumn("met", F.bool_or("train").over(alike) & F.bool_or("held").over(alike) & (F.max("text_id").over(alike) != F.min("text_id").over(alike))).where("met")
    texts = asked.groupBy("asks", "text_id").agg(F.any_value("question").alias("question"), F.bool_or("train").alias("train"), F.bool_or("held").alias("held"))
    s = cut(texts.select("text_id", "question", "train", "held", "asks").mapInArrow(_sketches, "text_id long, question string, train boolean, held boolean, prints array<long>"))
    freq = np.zeros(SLOTS, dtype=np.int64)
    for r in s.select(F.explode("prints").alias("p")).groupBy(F.col("p").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).count().collect():  # at most SLOTS rows
        freq[r[0]] = r[1]
    keys = cut(s.select("text_id", "prints").mapInArrow(_lookups(freq, hot), "k long, text_id long").join(s.select("text_id", "train", "held"), "text_id"))
    a, b = keys.where("train").select("k", F.col("text_id").alias("a")), keys.where("held").select("k", F.col("text_id").alias("b"))
    met = a.join(b, "k").where("a <> b").select("a", "b").distinct()
    sa = s.select(F.col("text_id").alias("a"), F.col("question").alias("s"), F.col("prints").alias("pa"))
    sb = s.select(F.col("text_id").alias("b"), F.col("question").alias("t"), F.col("prints").alias("pb"))
    near = F.size(F.array_intersect("pa", "pb")) >= F.lit(SKETCH) * F.greatest(F.size("pa"), F.size("pb"))
    return met.join(sa, "a").join(sb, "b").where(near).select("a", "b", "s", "t").mapInArrow(_decided(template, neutral), "a long, b long, coverage double")


def overlaps(rows: DataFrame) -> DataFrame:
    """`row_id_a, row_id_b, by, coverage` of every training row and held-out row with the same request, by `question` or `gold_plan`.

    Rows without a split (null or blank), with a blank question and a blank or broken plan take no part in the respective comparison.
    Coverage is the share of the shorter question that the other one covers; 1 for plans. All pairs come out, copies included; heavy plans
    are split by the join's skew handling. Texts and plans go by 64-bit hashes; their words are read again from the rows where they are
    needed, so no copy of the questions is kept but of those that may ask the same.
    """
    every = read_rows(rows)
    slim = cut(every.select("row_id", "train", "held", "text_id", "plan"))
    d = slim.where("train or held")
    m = d.where("text_id is not null")
    a, b = m.where("train").select(F.col("row_id").alias("x"), F.col("text_id").alias("a")), m.where("not train").select(F.col("row_id").alias("y"), F.col("text_id").alias("b"))
    links = cut(same_questions(every, slim))
    equal = a.join(b, F.col("a") == F.col("b")).select("x", "y", F.lit(1.0).alias("coverage"))
    same = equal.unionByName(links.join(a, "a").join(b, "b").select("x", "y", "coverage"))
    p = d.where("plan is not null").select("row_id", "train", F.col("plan").alias("k"))
    plans = p.where("train").select(F.col("row_id").alias("x"), "k").join(p.where("not train").select(F.col("row_id").alias("y"), "k"), "k").select("x", "y", F.lit(1.0).alias("coverage"))
    out = same.withColumn("by", F.lit("question")).unionByName(plans.withColumn("by", F.lit("gold_plan")))
    return out.groupBy(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"), "by").agg(F.max("coverage").alias("coverage"))
