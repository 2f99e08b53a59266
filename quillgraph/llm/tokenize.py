"""Encoding of a corpus with a public byte-level BPE vocabulary by a lazily determinised finite-state transducer."""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = os.environ.get("QUILLGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the vocabulary's training split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Transducer:
    """Reads the bytes of one pre-token and emits the ids of its byte-pair encoding.

    A segmentation is the encoding of its bytes exactly when each pair of neighbours is: merging the two tokens' bytes alone gives the two
    tokens back. So for every prefix the last token of its encoding is the one suffix token compatible with the last token before it. A
    state holds the open starts (places from which a token may still grow), each with its trie node, the token before it and the tokens
    not yet emitted; tokens shared by all open starts are emitted, which happens after at most the longest token's length. States and
    transitions are made when first met and dropped together when there are too many, which changes no result.
    """

    LIMIT = 400_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.root: dict = {}
        for t, i in ranks.items():
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[-1] = i
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.size = 0
        self.start = self.intern(((self.root, None, ()),))

    def intern(self, state: tuple) -> int:
        key = tuple((id(n), p, path) for n, p, path in state)
        k = self.ids.get(key)
        if k is None:
            k = self.ids[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return k

    def merge(self, b: bytes) -> list[int]:
        """The encoding of `b` by its definition: the lowest-ranked neighbouring pair first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return ok

    def move(self, k: int, c: int) -> tuple[int, tuple[int, ...]]:
        live, found = [], None
        for node, prev, path in self.states[k]:
            child = node.get(c)
            if child is None:
                continue
            token = child.get(-1)
            if found is None and token is not None and (prev is None or self.compatible(prev, token)) and (len(self.bytes_of[token]) < 3 or self.whole(token)):
                found = (self.root, token, (*path, token))
            if len(child) > (token is not None):
                live.append((child, prev, path))
        live.append(found)
        shared = 0
        first = live[0][2]
        while len(first) > shared and all(len(p) > shared and p[shared] == first[shared] for _, _, p in live):
            shared += 1
        out = first[:shared]
        step = (self.intern(tuple((n, p, path[shared:]) for n, p, path in live)), out)
        self.moves[k][c] = step
        self.size += 1
        return step

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        ok = self.pairs.get((-1, token))
        if ok is None:
            ok = self.pairs[-1, token] = self.merge(self.bytes_of[token]) == [token]
        return ok

    def encode(self, word: bytes) -> list[int]:
        if self.size > self.LIMIT:
            self.reset()
        k, out, moves = self.start, [], self.moves
        for c in word:
            step = moves[k].get(c) or self.move(k, c)
            k = step[0]
            if step[1]:
                out.extend(step[1])
        out.extend(self.states[k][-1][2])
        return out


_loaded: dict[str, Transducer] = {}


def transducer(vocabulary: str = VOCABULARY) -> Transducer:
    """The transducer of a vocabulary file, one per process."""
    if vocabulary not in _loaded:
        with open(vocabulary, "rb") as f:
            _loaded[vocabulary] = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return _loaded[vocabulary]


class Encoder:
    """Text to ids; frequent pre-tokens are remembered."""

    WORDS = 300_000

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.fst = transducer(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.fst.encode(w.encode("utf-8", "surrogatepass"))
                if len(known) >= self.WORDS:
                    known.clear()
                known[w] = ids
            out += ids
        return out


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key, ids array<int>` of every row, without special tokens; text that looks like one is ordinary text.

    A null and an empty text both give the empty list. One pass over the rows, no shuffle; a text of any length is one row of one task.
    The vocabulary file must be readable at `vocabulary` on every executor.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((x for y in ids for x in y), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return spread(df.select(key, F.col(text).cast("string").alias("text"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key, text`: ids back to text through an incremental UTF-8 state machine, token by token. A null list gives null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = transducer(vocabulary).bytes_of
        machine = codecs.getincrementaldecoder("utf-8")
        for b in batches:
            out = []
            for row in b.column(1).to_pylist():
                if row is None:
                    out.append(None)
                    continue
                m = machine("replace")
                out.append("".join(m.decode(of[i]) for i in row) + m.decode(b"", True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
