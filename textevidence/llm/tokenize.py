"""Encoding of a corpus with a public byte-level BPE (problem 6).

Two tiers: a minimal perfect hash over the vocabulary resolves whole pre-tokens; a pre-token that is no
vocabulary entry is merged with a heap over its linked bytes.  Vocabulary and hash are built once on the
driver from the vocabulary file (about 1 MB, a fixed size) and broadcast; texts never leave their partition,
so encoding needs no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import TOKENIZER_DIR, ragged, slices

#: Fixed value of the public vocabulary: the pattern that cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens a worker remembers before it starts anew.
MEMO_SIZE = 400_000

_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _slot(h: int, displacement: int, n: int) -> int:
    x = (h ^ (displacement * _MIX)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x >> 17) % n


class PerfectHash:
    """Minimal perfect hash of byte strings to their index: hash, then displace by the bucket's own number."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        self.displacement = np.zeros(self.buckets, np.int32)
        self.index = np.full(n, -1, np.int32)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        taken = bytearray(n)
        ones = []
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                ones.append((bucket, members[0][1]))
                continue
            d = 0
            while True:
                at = {_slot(h, d, n) for h, _ in members}
                if len(at) == len(members) and not any(taken[s] for s in at):
                    break
                d += 1
            self.displacement[bucket] = d
            for h, i in members:
                s = _slot(h, d, n)
                taken[s] = 1
                self.index[s] = i
        free = (s for s in range(n) if not taken[s])
        for bucket, i in ones:  # a bucket of one key names its slot directly
            s = next(free)
            self.displacement[bucket] = -s - 1
            self.index[s] = i

    def tables(self) -> tuple[list[int], list[int]]:
        return self.displacement.tolist(), self.index.tolist()


class Vocabulary:
    """Byte strings in rank order with their perfect hash; small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[token] for token in self.tokens]
        self.hash = PerfectHash(self.tokens)


class Encoder:
    """Encodes texts; remembers pre-tokens in a bounded memory in front of the two tiers."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.ids = vocabulary.tokens, vocabulary.ids
        self.displacement, self.index = vocabulary.hash.tables()
        self.n, self.buckets = vocabulary.hash.n, vocabulary.hash.buckets
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}
        self.chunks: dict[bytes, tuple[int, ...]] = {}
        self.flat, self.start = array("i"), array("q", [0])
        # Neighbouring bytes that no vocabulary entry holds can never be merged, so a pre-token may be cut there.
        joined = bytearray(65536)
        for token in self.tokens:
            for a, b in zip(token, token[1:], strict=False):
                joined[a << 8 | b] = 1
        self.joined = bytes(joined)

    def lookup(self, key: bytes) -> int:
        """Tier one: the rank of a vocabulary entry, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        i = self.index[-d - 1 if d < 0 else _slot(h, d, self.n)]
        return i if self.tokens[i] == key else -1

    def merge(self, word: bytes) -> list[int]:
        """Tier two: merge the pair of lowest rank first; the heap holds pairs of neighbours in a linked list."""
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.lookup(word[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
                continue
            parts[i] = both = left + parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.lookup(pair := both + parts[k])) >= 0:
                    heapq.heappush(heap, (r, i, len(pair)))
            if (k := before[i]) >= 0 and (r := self.lookup(pair := parts[k] + both)) >= 0:
                heapq.heappush(heap, (r, k, len(pair)))
        return [self.ids[self.lookup(p)] for p in parts if p is not None]

    def encode_pretoken(self, word: bytes) -> list[int]:
        if (i := self.lookup(word)) >= 0:
            return [self.ids[i]]
        joined, out, at = self.joined, [], 0
        for j in range(1, len(word) + 1):
            if j == len(word) or not joined[word[j - 1] << 8 | word[j]]:
                chunk, at = word[at:j], j
                ids = self.chunks.get(chunk)
                if ids is None:
                    if len(self.chunks) > MEMO_SIZE:
                        self.chunks.clear()
                    i = self.lookup(chunk)
                    ids = self.chunks[chunk] = (self.ids[i],) if i >= 0 else tuple(self.merge(chunk))
                out += ids
        return out

    def add(self, word: str) -> int:
        self.flat.extend(self.encode_pretoken(word.encode("utf-8", "replace")))
        self.memo[word] = at = len(self.start) - 1
        self.start.append(len(self.flat))
        return at

    def encode(self, texts: list[str | None], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids; a null text counts as empty."""
        if len(self.memo) > MEMO_SIZE:
            self.memo.clear()
            self.flat, self.start = array("i"), array("q", [0])
        words = [self.find(text) if text else () for text in texts]
        memo = self.memo
        for new in set(chain.from_iterable(words)).difference(memo):
            self.add(new)
        per = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(per.sum()))
        start = np.array(self.start, np.int64)
        first, lens = start[at], (start[1:] - start[:-1])[at]
        ends = np.concatenate(([0], np.cumsum(lens)))
        bounds = np.concatenate(([0], np.cumsum(per)))
        counts = ends[bounds[1:]] - ends[bounds[:-1]]
        return (np.array(self.flat, np.int32)[ragged(first, lens)] if with_ids else np.zeros(0, np.int32)), counts


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


_SHARED: dict[tuple, object] = {}


def _shared(spark, path: str):
    """The broadcast vocabulary of this application; built once per file."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(Vocabulary(path))
    return _SHARED[key]


def tokenizer_path(name: str, folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens.

    One row per input row, repeated ids included.  Null and empty texts give an empty list.  Other columns
    are dropped, so their names cannot clash.  An unpaired surrogate counts as U+FFFD.
    """
    path = tokenizer_path(tokenizer, folder)
    vocabulary = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, vocabulary)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids, counts = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[id_col, "ids"])

    kept = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of ids ``encode`` gives; null and empty texts have 0."""
    path = tokenizer_path(tokenizer, folder)
    vocabulary = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, vocabulary)
        for batch in batches:
            for part in slices(batch, "_text"):
                _, counts = encoder.encode(part.column(0).to_pylist(), with_ids=False)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts.astype(np.int32))], names=[*keep, "n_tokens"])

    kept = df.select(df[text_col].cast("string").alias("_text"), *[df[c] for c in keep])
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_tokens", T.IntegerType())])
    return kept.mapInArrow(run, schema)
