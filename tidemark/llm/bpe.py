"""Byte-level BPE, encoding and decoding, with two tiers of lookup.

A minimal perfect hash resolves pre-tokens that are whole vocabulary entries. Misses are merged over a doubly linked
list of byte pieces, with a heap of candidate merges by rank. Each worker keeps a bounded memo of pre-tokens it met.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: Pre-tokens in a worker's memo before it is emptied, and the longest that enters it.
MEMO_ENTRIES, MEMO_LENGTH = 800_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file: a base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _slots(key: bytes) -> tuple[int, int, int]:
    """Three numbers of a key, from a 128-bit hash."""
    d = xxhash.xxh3_128_intdigest(key)
    return d & 0xFFFFFFFF, d >> 32 & 0xFFFFFFFF, d >> 64 | 1


PRIME = 4294967291


class PerfectHash:
    """A minimal perfect hash by displacement: n keys to n slots, with one seed for each bucket of about 2 keys.

    Buckets are placed from the largest to the smallest; a bucket's seed is the first that sends all its keys to free
    slots. Buckets of one key come last and take the slots still free: their seed is that slot, as -1 - slot. A slot
    keeps its key's id and its token, so that a foreign key is told apart.
    """

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.n = max(1, len(ids))
        self.n_buckets = self.n // 2 + 1
        buckets: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for key in ids:
            a, b, c = _slots(key)
            buckets[a % self.n_buckets].append((b, c, key))
        self.seeds = [0] * self.n_buckets
        self.ids = [-1] * self.n
        self.keys: list[bytes | None] = [None] * self.n
        free = bytearray(b"\1") * self.n
        order = sorted(range(self.n_buckets), key=lambda k: -len(buckets[k]))
        for k in order:
            if len(buckets[k]) < 2:
                break
            seed = 0
            while True:
                at = [(b + seed * c) % PRIME % self.n for b, c, _ in buckets[k]]
                if len(set(at)) == len(at) and all(free[i] for i in at):
                    break
                seed += 1
            self.seeds[k] = seed
            for i, (_, _, key) in zip(at, buckets[k], strict=True):
                free[i], self.keys[i], self.ids[i] = 0, key, ids[key]
        left = (i for i in range(self.n) if free[i])
        for k in order:
            if len(buckets[k]) == 1:
                i, key = next(left), buckets[k][0][2]
                self.seeds[k], self.keys[i], self.ids[i] = -1 - i, key, ids[key]

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        a, b, c = _slots(key)
        seed = self.seeds[a % self.n_buckets]
        i = -1 - seed if seed < 0 else (b + seed * c) % PRIME % self.n
        return self.ids[i] if self.keys[i] == key else -1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word``: again and again the adjacent pair of least rank merges, the leftmost of equals first.

    The pieces form a linked list over the bytes (a piece is named by its first byte). The heap holds rank and place of
    each mergeable pair as one number; an entry is stale if its pair's rank has changed since.
    """
    n = len(word)
    if n == 1:
        return [ranks[word]]
    get, shift = ranks.get, n.bit_length()
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [get(word[i : i + 2], -1) for i in range(n - 1)]
    pair += (-1, -1)
    heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    push, pop, mask = heapq.heappush, heapq.heappop, (1 << shift) - 1
    while heap:
        top = pop(heap)
        i = top & mask
        if pair[i] != top >> shift:
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = -1
        if k < n:
            before[k] = i
            rank = pair[i] = get(word[i : after[k]], -1)
            if rank >= 0:
                push(heap, rank << shift | i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            rank = pair[h] = get(word[h:k], -1)
            if rank >= 0:
                push(heap, rank << shift | h)
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[word[i:k]])
        i = k
    return out


class Codec(dict):
    """Encoder and decoder of one vocabulary. As a dict it is the memo: pre-token to its ids as little-endian uint32."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.whole = PerfectHash(ranks)
        self.tokens = {i: token for token, i in ranks.items()}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        found = self.whole.get(raw)
        ids = array("I", [found] if found >= 0 else merge(raw, self.ranks)).tobytes()
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Every row's doc_id and ids (array of int), or, with ``digests``, the count and the hashes of ids and decoded bytes.

    A null text is empty and has no ids. The vocabulary (a bounded file) is read by the driver and broadcast. Rows are
    handled one by one, so that repeated rows, long texts and empty tables need no care.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    key = (ranks_path, pattern)

    def codec() -> Codec:
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(*shared.value)
        return _CODECS[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            ids = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            if digests:
                out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str = ".") -> DataFrame:
    """doc_id and the bytes that the ids (array of int) stand for; null ids give no bytes."""
    tune(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in load_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(tokens[i] for i in ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` by the multilingual byte-level vocabulary."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
