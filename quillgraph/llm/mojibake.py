"""Text that went through a wrong character decoding: candidates by decoding chains, the choice by description length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, spread

# Single-byte encodings as which UTF-8 or Windows text is commonly misread.
CODECS = ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "koi8-r", "iso8859-15", "cp866", "cp1253"]
SINGLE = ["cp1251", "mac_roman", "cp1250", "iso8859-2", "cp437", "cp850", "koi8-r", "cp1253"]
#: Languages that get a dictionary: those of at least this share of the documents, at most so many.
LANGUAGE_SHARE, LANGUAGES = 0.005, 8
#: Size of a language's dictionary in bytes.
DICTIONARY = 16_384
#: Level of compression.
LEVEL = 3
#: Bytes that each step of a chain costs; a single-byte exchange of what may be correct as it stands must save more.
STEP, DOUBT = 1.0, 1.0
#: Bytes that a character costs which neither clean text nor any European alphabet in a word of one script has.
UNUSUAL = 3.0
#: Part of a sentence's plain words that are frequent in a language, and the parts of its clean documents that have such a word, and a usual character.
FAMILIAR, FREQUENT, USUAL = 0.35, 0.01, 0.0075
#: Different counted texts that a task keeps before it passes them on.
KEPT = 500_000
#: Part of a sentence's other letters that UTF-8 misread as Cyrillic or Greek accounts for at least.
SPELT = 0.8
DAMAGE = re.compile("[�\u0080-\u009f]")
# Signs of damage: the characters with which misread UTF-8 begins or goes on, those that Latin text lacks.
_DAMAGED = re.compile("[\u0080-\u009f\ufffd\u2500-\u257f√∞≈Γ¬†‡]|[ÂÃÄÅÐÑâ][\u00a0-\u00bf\u2013-\u2122ƒŒœŠšŽžŸˆ˜]|[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z0-9£]")
_SENTENCE = re.compile(r"[^\n.;!?]+[.;!?]*|\n+")
_OTHER = re.compile("[^\\x00-\x7f]")
_DIGITS = re.compile("[0-9]")
_PLAIN = re.compile(r"(?<![^\W_])[a-z]{2,}(?![^\W_])")
_STUCK = re.compile(r"[£¥¢](?=[^\W\d_])")

# Small letters beyond a to z of the European alphabets in Latin script.
LATIN = frozenset("àáâãäåāăąæçćĉċčďđðèéêëēėęěĝğġģĥħìíîïīįıĵķĺļľłñńņňòóôõöøōőœŕřśŝşșšßţťțŧþùúûüūŭůűųŵýÿŷźżž")
_SCRIPT = [("latin", 0x00C0, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x04FF), ("greek", 0x1F00, 0x1FFF)]
_WORD = re.compile(r"[^\W_]+")


@lru_cache(100_000)
def odd_letters(word: str) -> int:
    """Letters of a word that no European spelling has there: other than ASCII beside a digit, of a second script, large after small, or of no alphabet."""
    scripts = [next((k for k, lo, hi in _SCRIPT if lo <= ord(c) <= hi), "" if not c.isalpha() else "latin" if c.isascii() else "other") for c in word]
    main = max((k for k in set(scripts) if k), key=lambda k: (scripts.count(k), k), default="")
    odd = 0
    for i, c in enumerate(word):
        if c.isascii():
            continue
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        second = not scripts[i] or scripts[i] != main or (main == "latin" and c.lower() not in LATIN)
        digit = (before.isascii() and before.isdigit()) or (after.isascii() and after.isdigit())
        large = c.isupper() and before.islower() and not after.isupper()
        odd += second or digit or large
    return odd


def _char(codec: str, byte: int) -> str:
    b = bytes([byte])
    try:
        return b.decode(codec)
    except UnicodeDecodeError:
        return chr(byte)  # undefined bytes come through as control characters


@lru_cache(None)
def multibyte(codec: str) -> tuple[re.Pattern, dict[str, int]]:
    """What UTF-8 sequences of two to four bytes look like in `codec`, and the byte of each character."""
    byte_of = {_char(codec, b): b for b in range(255, 127, -1)}
    if codec == "cp1252":  # no-break spaces are often turned to blanks afterwards, and undefined bytes kept
        byte_of |= {chr(b): b for b in range(0x80, 0xA0)}

    def group(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in byte_of.items() if lo <= b <= hi) + "]"

    tail = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}"), byte_of


def undo_utf8(text: str, codec: str) -> str:
    """`text` with every UTF-8 sequence that was read as `codec` decoded; everything else as it is."""
    pattern, byte_of = multibyte(codec)

    def back(m: re.Match) -> str:
        try:
            return bytes(byte_of[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return pattern.sub(back, text)


@lru_cache(None)
def _table(codec: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        a, t = _char(codec, b), _char("cp1252", b)
        if a != t and t.isprintable():
            out.setdefault(ord(a), t)
    return out


@lru_cache(None)
def _swapped(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _table(codec)))


#: Encodings whose UTF-8 sequences are spelt in letters of another script, as correct words may be.
SPELLING = ("cp1251", "koi8-r", "cp866", "cp1253")


def spelt(text: str, codec: str) -> bool:
    """Whether UTF-8 sequences are most of what of `codec` beyond ASCII stands in a text."""
    pattern, byte_of = multibyte(codec)
    inside = sum(len(m) for m in pattern.findall(text))
    return inside >= SPELT * sum(c.isalpha() and c in byte_of for c in text)


def undo_single(text: str, codec: str) -> str:
    """`text` with all characters that `codec` has for Windows bytes replaced by the Windows ones."""
    return text.translate(_table(codec))


@lru_cache(None)
def _ends(codec: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters with which UTF-8 sequences begin and go on in `codec`."""
    byte_of = multibyte(codec)[1]
    return frozenset(c for c, b in byte_of.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in byte_of.items() if 0x80 <= b <= 0xBF)


def focus(s: str) -> str:
    """The words of a sentence with other than ASCII characters and their neighbours, digits alike: all that a chain changes, and where it stands."""
    ws = s.split(" ")
    near = [i for i, w in enumerate(ws) if not w.isascii()]
    return _DIGITS.sub("0", " ".join(ws[i] for i in sorted({j for i in near for j in (i - 1, i, i + 1) if 0 <= j < len(ws)})))


class Judge:
    """Description length of what differs in a sentence: its size under the best of the languages' dictionaries."""

    def __init__(self, dictionaries: list[bytes], usual: frozenset[str], frequent: frozenset[str] = frozenset()) -> None:
        self.compress = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress for d in dictionaries]
        self.usual, self.frequent = usual, frequent
        self.known: dict[tuple[str, bool], tuple[tuple[str, str], ...]] = {}

    def familiar(self, s: str, text: str) -> bool:
        """Whether a sentence (of under three plain words: its text) is in a language of the dictionaries, by its plain words.

        In another language a letter that clean text lacks is not odd, and sizes under the dictionaries prove nothing.
        """
        ws = _PLAIN.findall(s.lower())
        if len(ws) < 3 and s is not text:
            return self.familiar(text, text)
        return bool(ws) and sum(w in self.frequent for w in ws) >= FAMILIAR * len(ws)

    def odd(self, s: str, familiar: bool) -> int:
        """Characters that neither clean text has nor a word of one script; in a familiar sentence, those clean text lacks."""
        n = 0
        for w in _WORD.findall(s):
            if not w.isascii():
                lacking = sum(c not in self.usual for c in w if c > "\x7f") if familiar else 0
                n += max(odd_letters(w), lacking)
        return n + sum(c not in self.usual and not c.isalnum() for c in s if c > "\x7f") + len(_STUCK.findall(s))

    def length(self, s: str, familiar: bool) -> float:
        b = s.encode("utf-8", "surrogatepass")
        # Frames have whole bytes, so odd characters are counted besides.
        return min((len(c(b)) for c in self.compress), default=len(b)) + UNUSUAL * self.odd(s, familiar)

    def chains(self, s: str, familiar: bool) -> dict[str, tuple[float, tuple[tuple[str, str], ...]]]:
        """Candidate originals, the cost of the chain that leads there, and the chain."""
        found: dict[str, tuple[float, tuple[tuple[str, str], ...]]] = {s: (0.0, ())}
        fresh = [s]
        for depth in range(1, 4):
            new = []
            for t in fresh:
                chars = set(_OTHER.findall(t))
                for codec in CODECS:
                    first, more = _ends(codec)
                    if chars.isdisjoint(first) or chars.isdisjoint(more):
                        continue
                    u = undo_utf8(t, codec)
                    if u not in found and (codec not in SPELLING or spelt(t, codec)):
                        found[u] = (STEP * depth, (*found[t][1], ("utf-8", codec)))
                        new.append(u)
            fresh = new
        chars = set(_OTHER.findall(s))
        odd = self.odd(s, familiar)
        doubt = 0.0 if odd else DOUBT
        for codec in SINGLE if odd or familiar else ():
            if not chars.isdisjoint(_swapped(codec)):
                u = undo_single(s, codec)
                if u not in found:  # any byte is a Windows character, so this proves less than UTF-8 does
                    found[u] = (2 * STEP + doubt, (("single", codec),))
        return found

    def chosen(self, s: str, text: str) -> tuple[tuple[str, str], ...]:
        """The chain that led to what a sentence shows; none if it is best as it stands."""
        f = focus(s), self.familiar(s, text)
        best = self.known.get(f)
        if best is None:
            options = self.chains(*f)
            best = options[min(options, key=lambda t: (self.length(t, f[1]) + options[t][0], options[t][0], t))][1] if len(options) > 1 else ()
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[f] = best
        return best

    def restored(self, s: str, text: str) -> str:
        # An odd character may still be a correct one: it costs, but excludes nothing.
        for kind, codec in self.chosen(s, text):
            s = undo_utf8(s, codec) if kind == "utf-8" else undo_single(s, codec)
        return s


def repair(text: str, judge: Judge) -> tuple[str, bool]:
    """The text, sentence by sentence in its most likely original form, and whether a wrong decoding shows (restored or not)."""
    if text.isascii():
        return text, False
    out, hit = [], False
    for m in _SENTENCE.finditer(text):
        s = m.group()
        if not s.isascii():
            r = judge.restored(s, text)
            hit = hit or r != s
            s = r
        out.append(s)
    text = "".join(out)
    return text, hit or bool(DAMAGE.search(text))


def pieces(text: str) -> Iterator[str]:
    """The words of a text with other than ASCII characters between their neighbours in the sentence, digits alike."""
    for m in _SENTENCE.finditer(text):
        if not m.group().isascii():
            ws = _DIGITS.sub("0", m.group()).split(" ")
            for i, w in enumerate(ws):
                if not w.isascii():
                    yield " ".join(ws[max(i - 1, 0) : i + 2])


@lru_cache(200_000)
def _plain_in(token: str) -> tuple[str, ...]:
    return tuple(_PLAIN.findall(token))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`code, kind, piece, n`: documents and clean ones of each language, how many of these have a character or plain word, and how often each piece stands in them."""
    count: dict[tuple[str, str], Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(code, kind, piece, n) for (code, kind), of in count.items() for piece, n in of.items()]
        count.clear()
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=["code", "kind", "piece", "n"])

    for b in batches:
        for code, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            of = lambda kind: count.setdefault((code, kind), Counter())  # noqa: B023, E731
            of("documents")[""] += 1
            if not code or t is None or len(t) <= 40 or not t.isascii() and _DAMAGED.search(t):
                continue
            of("clean")[""] += 1
            of("word").update(set(chain.from_iterable(map(_plain_in, set(t.lower().split())))))
            if not t.isascii():
                of("char").update(set(_OTHER.findall(t)))
                of("piece").update(pieces(t))
        if sum(map(len, count.values())) > KEPT:
            yield out()
    yield out()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[bytes], frozenset[str], frozenset[str]]:
    """One dictionary per language, the characters of clean text and the languages' frequent plain words, counted over all documents.

    Languages are the LANGUAGES most frequent codes with LANGUAGE_SHARE of the documents. All their documents without signs of damage are
    counted: a language's dictionary is its most frequent `pieces` as far as they fit, the most frequent last, where they are cheapest to
    refer to. A character is usual if three or more of a language's clean documents and USUAL of them have it, a plain word
    frequent if three or more and FREQUENT of them have it.
    """
    code = F.substring(F.lower(F.trim(F.col(lang))), 1, 2)
    d = docs.select(F.when(code.rlike("^[a-z]{2}$"), code).otherwise("").alias("code"), F.col(text).alias("t"))
    g = cut(spread(d).mapInArrow(_counted, "code string, kind string, piece string, n long").groupBy("code", "kind", "piece").agg(F.sum("n").alias("n")))
    size = {(r.code, r.kind): r.n for r in g.where("kind in ('documents', 'clean')").collect()}
    n_of = {c: n for (c, kind), n in size.items() if kind == "documents"}
    most = sorted((c for c in n_of if c), key=lambda c: (-n_of[c], c))[:LANGUAGES]
    clean_of = {c: size.get((c, "clean"), 0) for c in most if n_of[c] >= LANGUAGE_SHARE * sum(n_of.values())}
    if not clean_of:
        return [], frozenset(), frozenset()
    g = g.where(F.col("code").isin(*clean_of))
    share = F.create_map(*[F.lit(x) for c, n in clean_of.items() for x in (c, FREQUENT * n)])[F.col("code")]
    frequent = frozenset(r.piece for r in g.where((F.col("kind") == "word") & (F.col("n") >= 3) & (F.col("n") >= share)).select("piece").collect())
    usual = frozenset(r.piece for r in g.where("kind = 'char' and n >= 3").collect() if r.n >= USUAL * clean_of[r.code])
    # No more pieces than half the bytes go to the driver, as no more fit.
    order = W.partitionBy("code").orderBy(F.desc("n"), "piece")
    top = g.where("kind = 'piece'").withColumn("r", F.row_number().over(order)).where(F.col("r") <= DICTIONARY // 2).collect()
    dictionaries = []
    for language in sorted(clean_of):
        raw = b""
        for r in sorted((r for r in top if r.code == language), key=lambda r: r.r):
            if len(more := f"{r.piece} ".encode() + raw) > DICTIONARY:
                break
            raw = more
        if len(raw) >= 8:  # a shorter one is none to zstandard
            dictionaries.append(raw)
    return dictionaries, usual, frequent


def repair_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`key, text, garbled`: every document with its text restored where possible, and whether a wrong decoding shows in it.

    Each sentence is tried under the chains of wrong decodings; the form with the least description length (compressed size under the best
    language dictionary, plus the chain's cost) is kept, the sentence itself if none is shorter. Replacement characters and C1 controls
    that stay show a decoding that cannot be undone. Null and empty texts come back as they are, not garbled. One pass, no shuffle of texts;
    only counted words and what fits into the dictionaries go to the driver.
    """
    model = train(docs, text, lang)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*model)
        for b in batches:
            rows = [(None, False) if t is None else repair(t, judge) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=[key, "text", "garbled"])

    return spread(docs.select(key, F.col(text).alias("text"))).mapInArrow(run, f"`{key}` {kind}, text string, garbled boolean")
