"""Suffix-array dedup: every byte that a long enough string covers which also starts earlier is removed.

The strings of ``length`` bytes are dealt into shards by content: each goes by the least hash among the (length / 2)-byte
grams inside it, so that equal strings meet. Neighbouring strings of a document with the same least hash form a fragment;
fragments whose hash occurs once in the corpus, and its gram once in the fragment, hold nothing repeated and are left
out. Equal fragments enter the suffix array once: all but the first are repeated as a whole. The distinct fragments under
a shared hash are sorted by external induced sorting (see induced_sort), with common prefixes: neighbours with a common
prefix of ``length`` bytes hold equal strings, of which the first in the corpus stays. Shards are streamed to files, and
neither they nor what is found in them has to fit into memory.

A hash that very many distinct fragments share is no group for one task. Its fragments are dealt out again by the least
hash among longer grams, as often as needed, until a hash is that of whole strings; all of them still end in the sort.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import assign_seq
from .common import BYTE, Scratch, blobs, give_back, lean, mix, partitions, table, tune, utf8
from .induced_sort import Arrays, InducedSort, spill_dir
from .repeated import repeated

LENGTH = 100
#: Strings that are hashed at once; distinct fragments of a hash from which they are dealt out by longer grams; bytes of a
#: shard, about, so that its names seldom need a recursion; bytes that each part of a shard's sort keeps in memory.
STRETCH, GROUP, SHARD, MEMORY = 1 << 16, 2048, 3 << 20, 64 << 20
#: In aux, on the way to ``shared`` only: a fragment that may repeat a string by itself.
AGAIN = 1 << 19
BASE = np.uint64(0xD6E8FEB86659FD93)


def _grams(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, by doubling."""
    part, size, power = BYTE[x], 1, BASE
    out, have = None, 0
    while True:
        if k & size:
            if out is None:
                out = part
            else:  # the bits seen so far stand to the right
                out = part[: len(part) - have] * _power(have) + out[size:]
            have += size
            if have == k:
                return mix(out[: len(x) - k + 1])
        part = part[:-size] * power + part[size:]
        size *= 2
        power = _power(size)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def _slide(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        h = pick(h[:-size], h[size:])
        size *= 2
    return pick(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def fragments(x: np.ndarray, length: int = LENGTH, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first start and number of starts of each run of strings of x with the same least hash of a gram of ``k`` bytes
    (half the length, if not given), and whether the run may repeat a string by itself.

    Two equal strings of a run hold the least gram at two places of it. Grams that are least in some string stand next to
    each other there: no string has room for another one between the two places.
    """
    keys, starts, counts, agains = [], [], [], []
    n, k = len(x) - length + 1, k or length // 2
    width = length - k + 1
    for a in range(0, n, STRETCH):
        part = x[a : min(a + STRETCH, n) + length - 1]
        g = _grams(part, k)
        h = _slide(g, width, np.minimum)
        cut = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
        count = np.diff(np.append(cut, len(h)))
        # no hash is below the least one of a string around it, so a gram is least somewhere if the largest of those is its own
        edge = np.zeros(width - 1, np.uint64)
        least = np.flatnonzero(_slide(np.concatenate((edge, h, edge)), width, np.maximum) == g)
        pairs = np.concatenate(([0], np.cumsum(g[least[1:]] == g[least[:-1]])))
        first, last = np.searchsorted(least, cut), np.searchsorted(least, cut + count + width - 1) - 1
        keys.append(h[cut])
        starts.append(cut + a)
        counts.append(count)
        agains.append(pairs[last] > pairs[first])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts), np.concatenate(agains)


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 20 | count


def _lists(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The fields of each list of structs of longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fields = [column.values.field(i).to_numpy(zero_copy_only=False) for i in range(column.values.type.num_fields)]
    at = column.offsets.to_pylist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield [f[a:b] for f in fields]


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text and parts (structs of h, aux) of the documents in ``wanted`` (doc, h, aux)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "aux")).alias("parts"))
    return docs.join(lists, docs.doc_id == lists.doc).select("doc_id", "text", "parts")


def _hash_parts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """h, f1, f2 (the content's 128-bit hash), doc and aux of the fragments ``wanted`` (doc, h, aux)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, docs_, spans = [], [], [], []
            for doc, x, (h, aux) in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), _lists(batch.column(2)), strict=True):
                text, start, count = x.tobytes(), aux >> 20, aux & 0xFFFFF
                digests += [blake2b(text[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
                keys.append(h)
                docs_.append(np.full(len(h), doc, np.int64))
                spans.append(aux)
            if digests:
                f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                key, doc_, span = (np.concatenate(c) for c in (keys, docs_, spans))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, f[:, 0].copy(), f[:, 1].copy(), doc_, span)], ["h", "f1", "f2", "doc", "aux"])

    return _with_texts(docs, wanted).mapInArrow(lean(run), "h long, f1 long, f2 long, doc long, aux long")


def _refined(docs: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """h, doc, aux and again of the fragments that grams of ``k`` bytes cut the fragments ``wanted`` (doc, h, aux) into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, x, (_, aux) in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), _lists(batch.column(2)), strict=True):
                for start, n in zip((aux >> 20).tolist(), (aux & 0xFFFFF).tolist(), strict=True):
                    key, first, count, again = fragments(x[start : start + n + length - 1], length, k)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), doc, np.int64)), pa.array(_pack(first + start, count)), pa.array(again)], ["h", "doc", "aux", "again"])

    return _with_texts(docs, wanted).mapInArrow(lean(run), "h long, doc long, aux long, again boolean")


def _firsts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("h", "f1", "f2").agg(F.min(F.struct("doc", "aux")).alias("first")).select("h", "f1", "f2", "first.doc", "first.aux")


def _later(parts: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc and aux of all parts that equal an earlier one."""
    first = firsts.select("h", "f1", "f2", F.col("doc").alias("doc1"), F.col("aux").alias("aux1"))
    return parts.join(first, ["h", "f1", "f2"]).filter((F.col("doc") != F.col("doc1")) | (F.col("aux") != F.col("aux1"))).select("doc", "aux")


class Shard:
    """The fragments of a shard on disk, in order of document and start, and the strings among them that start earlier too."""

    def __init__(self, folder: str, length: int, memory: int) -> None:
        self.folder, self.length, self.memory, self.size = Path(folder), length, memory, 0
        self.text, self.parts = ((self.folder / name).open("wb") for name in ("text", "parts"))

    def add(self, doc: int, start: int, part: bytes) -> None:
        np.array([self.size, doc, start], np.int64).tofile(self.parts)
        # bytes are symbols 1 to 255 (255 itself is no part of UTF-8), 0 closes a fragment
        self.text.write((np.frombuffer(part, np.uint8) + np.uint8(1)).tobytes() + b"\0")
        self.size += len(part) + 1

    def _late(self, text: np.ndarray) -> np.ndarray:
        """Whether an equal string starts before each place. Equal ones are neighbours in the order of suffixes."""
        late = Arrays(str(self.folder), self.memory).make(len(text), np.bool_)
        low = -1  # the first place of the run of equal strings at hand
        for at, common in InducedSort(text, self.length, self.memory).sorted():
            equal = common >= self.length
            begin = np.flatnonzero(~equal)
            if len(begin) < len(at):
                late[at[equal]] = True
                late[at[begin]] = np.append(equal[1:], False)[begin]
            cut = np.unique(np.concatenate(([0], begin)))
            least = np.minimum.reduceat(at, cut)
            if equal[0]:
                late[low] = True
                least[0] = min(least[0], low)
            late[least] = False  # a run of one place, too, was never late
            low = int(least[-1])
        return late

    def strings(self) -> Iterator[pa.RecordBatch]:
        """doc and aux of the strings that start earlier too."""
        self.text.close()
        self.parts.close()
        text = np.memmap(self.folder / "text", np.uint8, "r")
        parts = np.memmap(self.folder / "parts", np.int64, "r").reshape(-1, 3)
        late = self._late(text)
        for a in range(0, len(text), STRETCH):
            p = a + np.flatnonzero(late[a : a + STRETCH])
            if len(p):
                first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1] + 1)))
                begin, doc, start = parts[np.searchsorted(parts[:, 0], p[first], "right") - 1].T
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(_pack(start + p[first] - begin, np.diff(np.append(first, len(p)))))], ["doc", "aux"])


def _sort_shards(docs: DataFrame, wanted: DataFrame, n_shards: int, length: int) -> DataFrame:
    """doc and aux of the strings inside the distinct fragments ``wanted`` (doc, h, aux) that also start earlier."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "doc", "start", "part"]
        for batch in batches:
            for doc, x, (h, aux) in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), _lists(batch.column(2)), strict=True):
                text, start, count = x.tobytes(), aux >> 20, aux & 0xFFFFF
                parts = [text[s : s + n + length - 1] for s, n in zip(start.tolist(), count.tolist(), strict=True)]
                shard = (h.view(np.uint64) % np.uint64(n_shards)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(h), doc, np.int64)), pa.array(start), pa.array(parts, pa.binary())], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards, one after the other."""
        folder, at, own = None, None, None
        try:
            for batch in batches:
                for shard, doc, start, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard != at:
                        if folder:
                            yield from own.strings()
                            folder.cleanup()
                            give_back()
                        folder, at = tempfile.TemporaryDirectory(prefix="shard-", dir=spill_dir()), shard
                        own = Shard(folder.name, length, MEMORY)
                    own.add(doc, start, part)
            if folder:
                yield from own.strings()
        finally:
            if folder:
                folder.cleanup()

    rows = _with_texts(docs, wanted).mapInArrow(lean(cut), "shard int, doc long, start long, part binary")
    return rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "doc", "start").mapInArrow(lean(sort), "doc long, aux long")


def _levels(length: int) -> list[int]:
    """Bytes of a gram: half the length at first, then half the way to the whole string each time."""
    out = [length // 2]
    while out[-1] < length:
        out.append(out[-1] + (length - out[-1] + 1) // 2)
    return out


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame | None:
    """doc and aux (first start << 20 | number of starts) of all strings of ``length`` bytes that also start earlier; None if
    a doc_id stands on different texts.

    Texts that equal an earlier document's are repeated as a whole, and are set aside first.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    told = scratch.keep(docs.select("doc_id", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("sha")), "told")
    ids = told.groupBy("doc_id").agg(F.count("*").alias("rows"), (F.min("sha") < F.max("sha")).alias("clash")).filter("rows > 1")
    clash = ids.agg(F.bool_or("clash")).first()[0]  # null: no id stands twice
    if clash:
        scratch.drop("told")
        return None
    first = scratch.keep(told.groupBy("sha").agg(F.min("doc_id").alias("first")), "first")
    copies = told.join(first, "sha").filter((F.col("doc_id") > F.col("first")) & (F.col("n") >= length))
    copies = copies.select(F.col("doc_id").alias("doc"), "n", F.explode(F.sequence(F.lit(0), F.col("n") - length, F.lit(STRETCH))).alias("s"))
    copies = copies.select("doc", F.shiftleft(F.col("s").cast("long"), 20).bitwiseOR(F.least(F.col("n") - length + 1 - F.col("s"), F.lit(STRETCH)).cast("long")).alias("aux"))
    docs = docs.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    docs = scratch.keep(docs if clash is None else docs.dropDuplicates(["doc_id"]), "distinct")

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for doc, x in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
            key, start, count, again = fragments(x, length)
            # a run that may repeat a string by itself counts as repeated
            twice = np.repeat(np.arange(len(key)), np.where(again, 2, 1))
            yield key[twice], np.full(len(twice), doc, np.int64), _pack(start, count | np.where(again, AGAIN, 0))[twice]

    shared = repeated(docs, entries).select(F.col("key").alias("h"), F.col("id").alias("doc"), F.col("aux").bitwiseAND(~AGAIN).alias("aux"), (F.col("aux").bitwiseAND(AGAIN) > 0).alias("again"))
    found, levels = [copies], _levels(length)
    for k, after in zip(levels, [*levels[1:], None], strict=True):
        # one after the other, so that the shuffles of one are gone before the next
        shared = scratch.keep(shared, f"shared-{k}")
        again = scratch.keep(shared.filter("again").select("h", "again").distinct(), f"again-{k}")
        parts = scratch.keep(_hash_parts(docs, shared, length), f"parts-{k}")
        firsts = scratch.keep(_firsts(parts), f"firsts-{k}")
        # fragments with a hash that others share, and those that may repeat a string by themselves (periodic text)
        counts = firsts.groupBy("h").agg(F.count("*").alias("n")).join(again, "h", "left").filter((F.col("n") > 1) | F.col("again")).select("h", "n")
        # written first: in one stage with the count, the join of a hash with all its fragments could not be split
        counts = scratch.keep(counts, f"counts-{k}")
        mixed = scratch.keep(firsts.join(counts, "h").select("h", "doc", "aux", "n"), f"mixed-{k}")
        plain, large = (mixed.filter(F.col("n") <= GROUP), mixed.filter(F.col("n") > GROUP)) if after else (mixed, None)
        size = plain.agg(F.sum(F.col("aux").bitwiseAND(0xFFFFF) + length)).first()[0] or 0
        found[-1:] = [scratch.keep(found[-1].unionByName(_later(parts, firsts)), f"later-{k}")]
        scratch.drop("told", "first", *(f"{name}-{k}" for name in ("shared", "again", "parts", "firsts", "counts")))
        found.append(scratch.keep(_sort_shards(docs, plain, max(partitions(spark), size // SHARD + 1), length), f"sorted-{k}"))
        if large is None or large.isEmpty():
            break
        shared = scratch.keep(_refined(docs, large, length, after), f"refined-{after}")
        several = shared.groupBy("h").agg(F.count("*").alias("n"), F.bool_or("again").alias("any")).filter("n > 1 OR any").select("h")
        shared = shared.join(several, "h", "left_semi")
    scratch.drop("distinct", *(f"{name}-{k}" for k in levels for name in ("mixed", "refined")))
    return reduce(DataFrame.unionByName, found)


def remove_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with _cut: n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left).

    A null text has no bytes. Repeated rows count as one document: none of them is later than the other. A doc_id that
    stands on different texts is several documents, in the order of a hash of the text. A null doc_id never matches. An
    empty table gives an empty result; other columns are left as they are.
    """
    tune(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).filter(F.col("doc_id").isNotNull())
    found, key = repeated_strings(plain, length), [F.col("doc_id").cast("long")]
    if found is None:
        scratch, key = Scratch(docs.sparkSession), [*key, F.sha2(utf8(), 256)]
        plain = plain.withColumn("sha", F.sha2("text", 256))
        own = scratch.keep(assign_seq(plain.select("doc_id", "sha").distinct(), ["doc_id", "sha"]), "own")
        found = repeated_strings(plain.join(own, ["doc_id", "sha"]).select(F.col("seq").alias("doc_id"), "text"), length)
        found = found.join(own.select(F.col("seq").alias("doc"), F.col("doc_id").alias("_doc"), F.col("sha").alias("_sha")), "doc")
    else:
        found = found.withColumnRenamed("doc", "_doc")
    names = ["_doc", "_sha"][: len(key)]
    spans = found.groupBy(*names).agg(F.collect_list("aux").alias("_spans"))

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out: tuple[list, ...] = ([], [], [], [])
        for x, aux in zip(blobs(text), spans.to_pylist(), strict=True):
            n = len(x)
            edge = np.zeros(n + 1, np.int64)
            if aux:
                aux = np.array(aux, np.int64)
                start = aux >> 20
                np.add.at(edge, start, 1)
                np.add.at(edge, start + (aux & 0xFFFFF) - 1 + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for to, value in zip(out, (n, int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if n else 0, x[~gone].tobytes()), strict=True):
                to.append(value)
        return pa.StructArray.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["n_bytes", "n_removed", "n_spans", "kept"])

    same = reduce(lambda a, b: a & b, (k == F.col(n) for k, n in zip(key, names, strict=True)))
    return docs.join(spans, same, "left").withColumn("_cut", cut(utf8(), F.col("_spans"))).drop(*names, "_spans")


def _text(kept: Column) -> Column:
    """Bytes to text; a character that a cut split is dropped."""

    @F.arrow_udf("string")
    def decode(kept: pa.Array) -> pa.Array:
        return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())

    return decode(kept)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the texts (null texts stay null) and n_chars, if there, renewed."""
    cut = remove_repeated(docs, length)
    out = cut.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).when(F.col("_cut.n_removed") == 0, F.col("text")).otherwise(_text(F.col("_cut.kept"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as UTF-8 bytes, strings of 100 bytes."""
    done = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256"))
