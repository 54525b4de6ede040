"""Byte-level BPE: a minimal perfect hash finds pre-tokens that are in the vocabulary, a heap over linked bytes merges
the others."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

MIX = np.uint64(0x9E3779B97F4A7C15)
#: A worker keeps between one and two times so many recent words, so its memory is bounded on any corpus.
MOST_WORDS = 150_000
#: Words that an idle worker keeps for its next task: those that came first, which are mostly the frequent ones.
IDLE_WORDS = 30_000
#: Texts are split about every so many characters, at places where the pattern always splits.
PIECE = 1 << 18
SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})")


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary file of the driver: line by line a base64 token and its rank. Item i has rank i."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """A minimal perfect hash of byte strings in levels: at each, keys alone in their slot take it; the others go to
    the next, smaller level. A key's number is the count of taken slots before its own."""

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        left, self.levels, before = np.arange(len(keys)), [], 0
        number = np.zeros(len(keys), np.int64)
        while len(left):
            if len(self.levels) > 64:
                raise ValueError("two keys have one hash")
            width = max(8, int(len(left) * spread))
            slot = self._slot(h[left], len(self.levels), width)
            alone = np.bincount(slot, minlength=width) == 1
            rank = before + np.cumsum(alone) - 1
            self.levels.append((width, np.where(alone, rank, -1).tolist()))
            placed = alone[slot]
            number[left[placed]] = rank[slot[placed]]
            before, left = before + int(alone.sum()), left[~placed]
        self.items = [0] * len(keys)  # the key's index in `keys` at each number
        for i, n in enumerate(number.tolist()):
            self.items[n] = i
        self.keys = keys

    @staticmethod
    def _slot(h: np.ndarray, level: int, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ np.uint64(level * 0x51ED2701)) * MIX
            return ((x >> np.uint64(32)) % np.uint64(width)).astype(np.int64)

    def find(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        for level, (width, ranks) in enumerate(self.levels):
            at = ranks[((((h ^ (level * 0x51ED2701)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 32) % width]
            if at >= 0:
                i = self.items[at]
                return i if self.keys[i] == key else None
        return None


class Codec:
    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.hash = PerfectHash(vocabulary)
        self.rank = {token: i for i, token in enumerate(vocabulary)}
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost on ties: a heap of the pairs of linked neighbours. pair[i] is the rank of what
        begins at byte i and its right neighbour; heap items that no longer agree with it are stale."""
        n, rank = len(word), self.rank.get
        right, left = list(range(1, n + 1)), list(range(-1, n))
        pair = [rank(word[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            gone = right[i]
            end = right[i] = right[gone]
            pair[gone] = -1
            if end < n:
                left[end] = i
                pair[i] = r = rank(word[i : right[end]], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            else:
                pair[i] = -1
            if i:
                k = left[i]
                pair[k] = r = rank(word[k:end], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + k)
        ids, i = [], 0
        while i < n:
            ids.append(rank(word[i : right[i]]))
            i = right[i]
        return tuple(ids)

    def word(self, word: str) -> tuple[tuple[int, ...], str, bytes]:
        """A pre-token's ids, those in decimals, and what they decode to."""
        found = self.older.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.hash.find(raw)
            ids = (whole,) if whole is not None else self.merge(raw)
            found = ids, " ".join(map(str, ids)), self.decode(ids)
        if len(self.known) >= MOST_WORDS:
            self.older, self.known = self.known, {}
        if len(word) <= 64:
            self.known[word] = found
        return found

    def rest(self) -> None:
        """Give most of the remembered words' memory back: other work follows in the same worker."""
        self.known, self.older = dict(islice((self.older or self.known).items(), IDLE_WORDS)), {}

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            cut = SAFE.search(text, at + PIECE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def words(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """The pre-tokens of text, a bounded piece at a time."""
        for piece in self.pieces(text):
            yield [self.known.get(w) or self.word(w) for w in self.pattern.findall(piece)]

    def encode(self, text: str) -> list[int]:
        return [i for words in self.words(text) for ids, _, _ in words for i in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """How many ids, the digest of the ids in decimals, the digest of the decoded bytes."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for words in self.words(text):
            of_ids.update((" " * (n > 0 and len(words) > 0) + " ".join([w[1] for w in words])).encode())
            of_bytes.update(b"".join([w[2] for w in words]))
            n += sum([len(w[0]) for w in words])
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(broadcast, key: tuple[str, str]) -> Codec:
    """One codec a Python worker; key: the vocabulary's digest and the pattern."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value, key[1])
    return _codecs[key]


def _sent(docs: DataFrame, path: str, pattern: str):
    tokens = read_ranks(path)
    return docs.sparkSession.sparkContext.broadcast(tokens), (hashlib.sha256(b"\n".join(tokens)).hexdigest(), pattern)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", as_col: str = "ids") -> DataFrame:
    """docs with the token ids of every whole text as an array (null and empty text: no ids)."""
    vocabulary, key = _sent(docs, vocabulary_path, pattern)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(vocabulary, key)
        for texts in batches:
            yield pd.Series([codec.encode(t or "") for t in texts], index=texts.index)

    return docs.withColumn(as_col, run(F.col(text_col)))


def decode(docs: DataFrame, vocabulary_path: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for (null: empty). An id outside the vocabulary is an error."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = vocabulary.value
        for ids in batches:
            yield pd.Series([b"".join(tokens[i] for i in x) if x is not None else b"" for x in ids], index=ids.index)

    return docs.withColumn(as_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids; per row: id_col, n_tokens, ids_sha256 (decimal ids joined by one space),
    decoded_sha256. Null text counts as empty: 0 tokens, the digest of nothing. No shuffle; a worker holds one
    vocabulary (fixed size), at most MOST_WORDS words and one piece of a text at a time."""
    vocabulary, key = _sent(docs, vocabulary_path, pattern)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")  # a text at a time leaves the Arrow batch
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(vocabulary, key)
        for texts in batches:
            n, of_ids, of_bytes = zip(*(codec.digests(t.as_py() or "") for t in texts)) if len(texts) else ((), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
        codec.rest()
        give_back()

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("r")).select(id_col, "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
