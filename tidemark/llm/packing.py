"""Best-fit packing into token sequences, in bulk-synchronous rounds.

Piece lengths and gaps are whole numbers up to the sequence length, so both are kept range-sorted as counts by length:
a state of at most 2 x 2048 classes, whatever the input. A round takes the longest class not yet placed; a sweep finds
its successor among the gaps (the least gap that holds it); where more pieces than gaps meet, rank decides: the first
pieces of the class take those gaps and the rest sweep on or open new sequences; the gaps are updated and the next
round follows. The rounds yield intervals of ranks for intervals of sequences; all pieces are ranked within
their length on the executors, and look up their place there.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, ranked, table, tune

LENGTH = 2048
MEMO_ENTRIES, MEMO_LENGTH = 800_000, 64


def rounds(counts: dict[int, int], capacity: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest class first. counts: pieces of each length (1 to capacity).

    Returns intervals (length, first rank, ranks, first sequence, offset) and the number of sequences: the pieces of
    that length and those ranks lie in consecutive sequences, each at that offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of sequences, as first and number
    sizes: list[int] = []  # gaps that have runs, ascending
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
                k = min(n, left)
                if n > k:
                    leave(gap, first + k, n - k)
            else:  # no gap holds it: open as many sequences as this class fills
                gap, first, k = capacity, opened, max(1, left // (capacity // length))
                opened += k
            out.append((length, rank, k, first, capacity - gap))
            leave(gap - length, first, k)
            rank, left = rank + k, left - k
    return out, opened


#: Byte-level spelling: visible Latin-1 characters stand for themselves, other bytes for characters from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = [chr(b) if b in _SHOWN else chr(256 + sum(c not in _SHOWN for c in range(b))) for b in range(256)]
#: End of the scripts whose letters need no look at normalising rules beyond NFC.
LATIN = "\u0530"


#: The rules under which chunks of text may be encoded one by one: lower case, words apart, no white space.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WholeIds:
    """Ids of whole texts, as little-endian uint32, by any tokenizer."""

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        self.tokenizer = tokenizer

    def text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def ids_of(tokenizer_json: str) -> WholeIds | WordIds:
    from tokenizers import Tokenizer

    rules, tokenizer = json.loads(tokenizer_json), Tokenizer.from_str(tokenizer_json)
    plain = all(rules.get(k) == v for k, v in WORD_RULES.items()) and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
    added = rules.get("added_tokens") or []
    if plain and not any(re.search(r"[\s]", t["content"]) or t["content"].isalpha() or t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in added):
        return WordIds(tokenizer)
    return WholeIds(tokenizer)


class WordIds(dict):
    """Memo of space-separated chunks of text to their ids, as little-endian uint32.

    Under WORD_RULES the tokenizer drops white space and never merges across it, so a text's ids are those of its chunks in
    turn. Where these rules allow, a chunk is looked up by its lower case and without a closing comma or full stop.
    """

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.mark = {c: self._whole(c) for c in ",."}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 1 and chunk[-1] in self.mark and chunk[-2].isalpha() and len(chunk[-2].lower()) == 1:
            ids = self[chunk[:-1]] + self.mark[chunk[-1]]
        elif chunk.isascii() and chunk.isalpha() and not chunk.islower():
            ids = self[chunk.lower()]
        elif chunk.isalpha() and max(chunk) < LATIN and chunk == chunk.lower() and unicodedata.is_normalized("NFC", chunk):
            # one pre-token that normalising leaves as it is: straight to the merges, spelled by bytes
            ids = array("I", [t.id for t in self.model.tokenize(chunk if chunk.isascii() else "".join(map(BYTES.__getitem__, chunk.encode())))]).tobytes()
        else:
            ids = self._whole(chunk)
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every row's ids, closed by ``end_id`` and cut only if longer than
    ``length``. A null text is empty, and has one piece with the closing id."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_of(shared.value)  # gone with the task: a worker's copy of a global is, too, but only after ``lean``
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.text(text or "") + end
                for k, a in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[a : a + 4 * length]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their sequence_id and offset.

    Repeated rows, and rows with a null doc_id, are packed each by itself; ties in length are broken the same way at each
    run; an empty table gives an empty result. Other columns are ignored. Any tokenizer file will do: whole texts are
    encoded, or chunks of them where the file's rules say that this is the same.
    """
    with open(tokenizer_path) as f:
        tokenizer_json = f.read()
    scratch = Scratch(docs.sparkSession)
    cut = scratch.keep(pieces(docs, tokenizer_json, end_id, length), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # `length` rows at most
    plan, _ = rounds(counts, length)
    table_ = np.array(sorted(plan), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table_)  # its size depends on lengths, not on documents
    wide = np.int64(1 << 44)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] * wide + t[:, 1]
        for batch in batches:
            n, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_rank"))
            at = np.searchsorted(keys, n * wide + rank, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])], [*names, "sequence_id", "offset"])

    return ranked(cut, "length", ["doc_id", "piece", "ids_crc32"]).mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
