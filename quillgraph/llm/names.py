"""Variant spellings of names typed by people: a trie join of their words under Levenshtein automata, then of the names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_stand_in
from ..operators.components import connected_components
from ..session import cut, spread, tasks
from .orgnames import parse, same_given

#: Edits within which two words are neighbours.
EDITS = 2
#: A word beside so many different words, and in this share of the names, says what kind of organisation it is.
LEARNT, LEARNT_SHARE = 50, 0.01
#: Letters from which one word may be two of four run together.
SPLIT = 8


class Automaton:
    """The Levenshtein automaton of EDITS edits (a swap of neighbours is one) for any word, determinised as far as searches reach.

    A state holds the edits to each place of the queried word within EDITS of the letters read, the same one letter before, and where that
    letter stands in the word. The next state follows from where the next letter stands and how far the word's end is, so what is worked
    out for one word serves all others.
    """

    WIDE = 2 * EDITS + 1
    FAR = EDITS + 1

    def __init__(self) -> None:
        first = tuple([self.FAR] * EDITS + list(range(EDITS + 1)))
        self.rows: list[tuple[int, ...]] = [first]
        self.least: list[int] = [0]
        self.states = [(first, (self.FAR,) * self.WIDE, 0)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, int] = {}

    def step(self, state: int, places: int, left: int) -> int:
        """The state after a letter that stands at `places` (a bit each, EDITS before to EDITS after), `left` letters of the word being left then."""
        key = state << 16 | places << 8 | left + self.WIDE
        found = self.steps.get(key)
        if found is None:
            row, before, last = self.states[state]
            new: list[int] = []
            for k in range(self.WIDE):  # place k - EDITS after the letters read
                if k - EDITS > left:
                    new.append(self.FAR)
                    continue
                d = row[k] + (not places >> k & 1)
                if k + 1 < self.WIDE:
                    d = min(d, row[k + 1] + 1)
                    if k and last >> (k + 1) & 1 and places >> (k - 1) & 1:
                        d = min(d, before[k] + 1)
                if k:
                    d = min(d, new[-1] + 1)
                new.append(min(d, self.FAR))
            s = (tuple(new), row, places)
            found = self.number.get(s)
            if found is None:
                found = self.number[s] = len(self.states)
                self.states.append(s)
                self.rows.append(s[0])
                self.least.append(min(new))
            self.steps[key] = found
        return found


AUTOMATON = Automaton()


class Trie:
    """Words of a shard, searched by the states that the Levenshtein automaton of the query passes through."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def _walk(self, word: str, most: int, beginning: bool) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << (i + EDITS)
        rows, least, step, steps = AUTOMATON.rows, AUTOMATON.least, AUTOMATON.step, AUTOMATON.steps
        wide = AUTOMATON.WIDE
        window = (1 << wide) - 1
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, state = stack.pop()
            end = n - depth
            if -EDITS <= end <= EDITS and rows[state][end + EDITS] <= most:
                if beginning:
                    out += [(w, most) for w in _below(node)]
                    continue
                if "" in node:
                    out.append((node[""], rows[state][end + EDITS]))
            left = max(-wide, min(end - 1, EDITS))
            for c, child in node.items():
                if c:
                    places = at.get(c, 0) >> depth & window
                    new = steps.get(state << 16 | places << 8 | left + wide)
                    if new is None:
                        new = step(state, places, left)
                    if least[new] <= most:
                        stack.append((child, depth + 1, new))
        return out

    def near(self, word: str, most: int = EDITS) -> list[tuple[str, int]]:
        """Words within `most` edits (a swap of neighbours is one) and how many; a branch ends where no state within the bound is left."""
        return self._walk(word, most, False)

    def beginning(self, prefix: str, most: int = 1) -> list[str]:
        """Words of which a beginning is within `most` edits of `prefix`."""
        return [w for w, _ in self._walk(prefix, most, True)]

    def starting(self, prefix: str) -> list[str]:
        """Words that begin with `prefix`."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return []
        return list(_below(node))


def _below(node: dict) -> Iterator[str]:
    stack = [node]
    while stack:
        for c, child in stack.pop().items():
            if c == "":
                yield child
            else:
                stack.append(child)


def _hash(*x: object) -> int:
    h = xxhash.xxh3_64_intdigest(repr(x))
    return h - (1 << 64) if h >> 63 else h


def _segments(n: int) -> list[tuple[int, int]]:
    """Start and length of the EDITS + 1 parts of a word of n letters; EDITS edits leave one of them whole (a swap can touch two: one more part)."""
    parts = EDITS + 2
    size, rest = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        k = size + (i >= parts - rest)
        out.append((at, k))
        at += k
    return out


def shards(word: str, index: bool) -> list[int]:
    """Shards in which a word is put (index) or looked up: its own segments, or what may stand in theirs within EDITS places."""
    n = len(word)
    if index:
        return [_hash(n, i, word[s : s + k]) for i, (s, k) in enumerate(_segments(n))]
    out = set()
    for m in range(max(4, n - EDITS), n + EDITS + 1):
        for i, (s, k) in enumerate(_segments(m)):
            for a in range(max(0, s - EDITS), min(n - k, s + EDITS) + 1):
                out.add(_hash(m, i, word[a : a + k]))
    return sorted(out)


def beginnings(word: str, index: bool) -> list[int]:
    """Shards of a word by pairs of letters at its beginning, or where they may stand in a misspelt beginning of it; one edit or swap leaves one."""
    at = {0: (0,), 2: (1, 2, 3), 3: (2, 3, 4)}
    return sorted({_hash("pair", i, word[a : a + 2]) for i, shifts in at.items() for a in ((i,) if index else shifts) if len(word) >= a + 2})


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, index?, query?, cut? → shard, word, role (0 index, 1 query, 2 beginning of a word, 3 the same misspelt)."""
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            k, w, r = [], [], []
            for word, index, query, short in zip(*(b.slice(i, 2000).column(j).to_pylist() for j in range(4))):
                rows = []
                if index:
                    rows += [(s, 0) for s in shards(word, True)] + [(_hash("start", word[:3]), 0)] + [(x, 0) for x in beginnings(word, True)]
                if query:
                    rows += [(s, 1) for s in shards(word, False)]
                if short:
                    rows.append((_hash("start", word[:3]), 2))
                    if len(word) > 3:
                        rows += [(x, 3) for x in beginnings(word, False)]
                k += [s for s, _ in rows]
                r += [x for _, x in rows]
                w += [word] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(w, pa.string()), pa.array(r, pa.int32())], names=["shard", "word", "role"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, words to index first → word, target, edits. One shard's trie is held at a time."""
    at, trie = None, Trie()
    for b in batches:
        w, t, d = [], [], []
        for shard, word, role in zip(*(b.column(j).to_pylist() for j in range(3))):
            if shard != at:
                at, trie = shard, Trie()
            if role == 0:
                trie.add(word)
                continue
            found = trie.near(word) if role == 1 else [(x, 1) for x in trie.starting(word)] if role == 2 else [(x, 2) for x in trie.beginning(word)]
            for x, n in found:
                if x != word:
                    w.append(word)
                    t.append(x)
                    d.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(t, pa.string()), pa.array(d, pa.int32())], names=["word", "target", "edits"])


def trie_join(words: DataFrame) -> DataFrame:
    """`word, target, edits` from `word, index, query, short`: indexed words within EDITS of the queried ones, or that begin with a short one (of four letters or more: misspelt by one edit).

    Words are put into shards by the segments of which near words share one, in place and length up to EDITS; each shard is one trie, so
    near words are found whole and a shard holds only words with one segment in common.
    """
    rows = words.mapInArrow(_sharded, "shard long, word string, role int")
    used = rows.groupBy("shard").agg(F.min("role").alias("a"), F.max("role").alias("b")).where("a = 0 and b > 0").select("shard")
    live = rows.join(used, "shard", "left_semi").repartition(tasks(words.sparkSession), "shard").sortWithinPartitions("shard", "role")
    return live.mapInArrow(_searched, "word string, target string, edits int").groupBy("word", "target").agg(F.min("edits").alias("edits"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = [parse(t) for t in b.column(1).to_pylist()]
        text = pa.string()
        cols = [pa.array([x.core for x in p], pa.list_(text)), pa.array([x.cut for x in p], pa.list_(text)), *(pa.array([getattr(x, f) for x in p], text) for f in ("kind", "legal", "given"))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["id", "n", "core", "cut", "kind", "legal", "given"])


PARSED = "id long, n long, core array<string>, cut array<string>, kind string, legal string, given string"


def parse_names(names: DataFrame) -> DataFrame:
    """`id, n` and the parts of each name, from `id, name, n`."""
    return spread(names.select("id", "name", "n")).mapInArrow(_parsed, PARSED).where(F.size("core") > 0)


def core_keys(core: list[str], near: dict[str, list[tuple[str, int]]]) -> dict[str, int]:
    """The own words a name may mean, with the edits that takes: pairs as they stand, with neighbours, or one long word in two.

    Where there are not two own words, all of them too: as they stand, or with neighbours for one or two.
    """
    out: dict[str, int] = {}
    if len(core) != 2:
        out[" ".join(core)] = 0
        options = [(k, x, i) for k, w in enumerate(core) for x, i in near.get(w, ())]
        for change in [*combinations(options, 1), *combinations(options, 2)]:
            d = sum(i for _, _, i in change)
            if len({k for k, _, _ in change}) == len(change) and d <= EDITS + 2:
                ws = list(core)
                for k, x, _ in change:
                    ws[k] = x
                whole = " ".join(sorted(ws))
                out[whole] = min(d, out.get(whole, 9))

    def put(x: str, y: str, d: int) -> None:
        k = f"{x} {y}" if x <= y else f"{y} {x}"
        if d < out.get(k, 9):
            out[k] = d

    if len(core) == 1:
        w = core[0]
        for i in range(4, len(w) - 3):
            put(w[:i], w[i:], 1)
        return out
    for a, b in combinations(core, 2):
        extra = len(core) - 2
        for x, i in [(a, 0), *near.get(a, ())]:
            for y, j in [(b, 0), *near.get(b, ())]:
                if i + j <= EDITS + 2:
                    put(x, y, i + j + extra)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys, edits = [], [], []
        for i, core, near in zip(*(b.column(j).to_pylist() for j in range(3))):
            found = core_keys(core, {x["word"]: [(t["target"], t["edits"]) for t in x["near"]] for x in near or () if x["near"]})
            ids += [i] * len(found)
            keys += found.keys()
            edits += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(edits, pa.int32())], names=["id", "key", "edits"])


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether kinds, legal forms and given names of a name and a group can be one organisation's."""
    for b in batches:
        ok = []
        for k, gk, legal, gl, v, gv, typed in zip(*(b.column(j).to_pylist() for j in range(4, 11))):
            a, c = set(k.split()), set(gk.split())
            same = a == c or (typed == 0 and not a) or (bool(a) and a < c and len(c) - len(a) < 3)
            forms = set(gl) - {""}
            legal_ok = not legal or legal in forms or (not forms and bool(a))
            if not a and not v and not legal and forms:
                legal_ok = False  # a company keeps its legal form when it leaves out its trade
            ok.append(same and legal_ok and same_given(v, gv))
        yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(4)), pa.array(ok)], names=["id", "group", "edits", "weight", "ok"])


def with_learnt_kinds(parsed: DataFrame) -> DataFrame:
    """The parsed names with words that the data show to be kinds moved from the own words to the kind, where another own word is left.

    Own words stand beside few others, kinds beside many: those of LEARNT different words and LEARNT_SHARE of the names (so at most a few
    hundred, whatever the data) are kinds, besides the fixed ones.
    """
    total = parsed.count()
    each = parsed.select("core", F.explode("core").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("names"), F.approx_count_distinct(F.array_join(F.array_except("core", F.array("word")), " ")).alias("beside"))
    learnt = [r[0] for r in counts.where((F.col("names") >= max(LEARNT, LEARNT_SHARE * total)) & (F.col("beside") >= LEARNT)).select("word").collect()]
    if not learnt:
        return parsed
    kinds = F.array(*map(F.lit, sorted(learnt)))
    own = F.array_except("core", kinds)
    move = F.size(own) > 0
    kind = F.array_join(F.array_sort(F.array_union(F.filter(F.split("kind", " "), lambda x: x != ""), F.array_intersect("core", kinds))), " ")
    return parsed.select("id", "n", F.when(move, own).otherwise(F.col("core")).alias("core"), F.when(move, F.array_except("cut", kinds)).otherwise(F.col("cut")).alias("cut"), F.when(move, kind).otherwise(F.col("kind")).alias("kind"), "legal", "given")


def run_together(parsed: DataFrame, groups: DataFrame) -> DataFrame:
    """`id, key, edits` of the names of one long word that is two own words of a group, in either order, run together and misspelt."""
    one = parsed.where((F.size("core") == 1) & (F.length(F.get("core", F.lit(0))) >= SPLIT)).select("id", F.get("core", F.lit(0)).alias("word"))
    x = F.split("key", " ")
    two = groups.select("key").distinct().where(F.size(x) == 2).select("key", F.explode(F.array(F.concat(x[0], x[1]), F.concat(x[1], x[0]))).alias("target"))
    no, yes = F.lit(False), F.lit(True)
    words = two.select(F.col("target").alias("word"), yes.alias("index"), no.alias("query"), no.alias("short"))
    near = trie_join(words.unionByName(one.select("word", no.alias("index"), yes.alias("query"), no.alias("short")).distinct()))
    return near.join(two, "target").join(one, "word").select("id", "key", (F.col("edits") + 1).alias("edits"))


def name_groups(names: DataFrame) -> DataFrame:
    """`id, component` of the names (`id, name, n`) that belong to one organisation.

    A name is read as own words, kind, legal form and given name. Names of equal own words (any number, in any order), kind and given name
    are one group. A name that is misspelt, cut off, run together (and misspelt at once) or leaves out its kind is linked to the group that it comes nearest to, of the
    same kind and given name as far as it tells them, that is met as often or more often; if two kinds come equally near it is linked to
    neither. Every word of four letters or more is looked up, whatever its frequency.
    """
    parsed = cut(with_learnt_kinds(cut(parse_names(names))))
    words = parsed.select("id", "n", "core", F.explode("core").alias("word"), F.array_contains("cut", F.col("word")).alias("short"))
    w = words.groupBy("word").agg(F.sum("n").alias("n"), F.min("short").alias("always"), F.max("short").alias("short"))
    length = F.length("word")
    whole_word = ~F.col("always") & (length > 3)  # one edit makes a shorter word another one
    roles = w.select("word", whole_word.alias("index"), whole_word.alias("query"), (F.col("short") & (length > 2)).alias("short"))
    near = trie_join(cut(roles)).join(w.select(F.col("word").alias("target"), F.col("n").alias("tn")), "target").join(w.select("word", "n"), "word")
    near = near.where("tn >= n or edits = 1").groupBy("word").agg(F.collect_list(F.struct("target", "edits")).alias("near"))
    per = words.select("id", "word").join(near, "word").groupBy("id").agg(F.collect_list(F.struct("word", "near")).alias("near"))
    keys = cut(parsed.select("id", "core").join(per, "id", "left").select("id", "core", "near").repartition(tasks(names.sparkSession), "id").mapInArrow(_keyed, "id long, key string, edits int"))

    whole = parsed.where(F.size("cut") == 0).withColumn("key", F.array_join("core", " "))
    own = whole.withColumn("group", F.xxhash64("key", "kind", "given"))
    groups = cut(own.groupBy("group", "key", "kind", "given").agg(F.sum("n").alias("weight"), F.collect_set("legal").alias("legals")))
    keys = keys.unionByName(run_together(parsed, groups))
    named = parsed.select("id", "kind", "legal", "given", (F.size("core") == 2).alias("pair")).join(own.select("id", "group"), "id", "left").join(groups.select("group", F.col("weight").alias("own")), "group", "left").withColumnRenamed("group", "mine")
    of_two = F.size(F.split("key", " ")) == 2
    g = groups.select("key", "group", of_two.alias("gpair"), F.col("kind").alias("gkind"), F.col("given").alias("ggiven"), "legals", "weight")
    met = keys.join(g, "key").join(named, "id").where(F.col("mine").isNull() | (F.col("gpair") & ~F.col("pair")) | ((F.col("group") != F.col("mine")) & ((F.col("edits") == 0) | (F.col("weight") > F.col("own")) | ((F.col("weight") == F.col("own")) & (F.col("group") < F.col("mine"))))))
    met = met.where("gkind <> '' or ggiven <> '' or kind = ''")
    typed = F.when(F.col("kind") == "", 0).otherwise(1)
    met = met.select("id", "group", "edits", "weight", "kind", "gkind", "legal", "legals", "given", "ggiven", typed.alias("typed"))
    fit = met.mapInArrow(_fits, "id long, group long, edits int, weight long, ok boolean").where("ok").drop("ok")
    tell = fit.join(groups.select("group", "kind", "given", (~of_two).alias("other")), "group").withColumn("bare", (F.col("kind") == "") & (F.col("given") == ""))
    # Words beyond two are mostly misspelt kinds, so groups of two own words come first.
    first = W.partitionBy("id").orderBy("other", "bare", "edits", F.desc("weight"), "group")
    best = tell.withColumn("r", F.row_number().over(first)).withColumn("same", F.count(F.lit(1)).over(W.partitionBy("id", "other", "bare", "edits"))).where("r = 1")
    telling = parsed.select("id", ((F.col("kind") != "") | (F.col("given") != "")).alias("telling"))
    links = best.join(telling, "id").where("telling or same = 1").select(F.col("id").alias("a"), F.col("group").alias("b"))
    edges = own.select(F.col("id").alias("a"), F.col("group").alias("b")).unionByName(links)
    return connected_components(edges).join(parsed.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("id"), "component")


def distinct_names(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`id, name, n` of the different strings of the columns, placeholders left out. The id is a 64-bit hash of the name."""
    every = rows.select(F.explode(F.array(*columns)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.any_value("name").alias("once"))
    # Judged once for each string: a filter on the key would be pushed below the aggregation.
    return every.where(~is_stand_in(F.col("once"))).select(F.xxhash64("name").alias("id"), "name", "n")


def variant_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`name_a, name_b` (smaller first) of all different strings that name one organisation. Nulls, blanks and placeholders name none."""
    names = cut(distinct_names(rows, columns))
    m = cut(name_groups(names).join(names.select("id", "name"), "id"))
    a, b = m.select("component", F.col("name").alias("name_a")), m.select("component", F.col("name").alias("name_b"))
    return a.join(b, "component").where("name_a < name_b").select("name_a", "name_b")


def variant_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`name, leader`: each spelling with the most frequent spelling of its organisation (ties: the smallest)."""
    names = cut(distinct_names(rows, columns))
    m = cut(name_groups(names).join(names, "id"))
    lead = m.groupBy("component").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("leader"))
    return m.join(lead, "component").select("name", "leader")
