"""N-gram Jaccard join with count-vector R-trees.

A document is its set of distinct word shingles (as 64-bit hashes). Any two sets that reach the similarity share a shingle
among each one's first few under a common order (the less frequent before the more frequent), so the documents that share
such a shingle form a group, and every link lies in some group. In a group the documents' count vectors (shingles hashed
into 256 groups, counted) are points of an R-tree: the overlap of two sets is at most the sum of their coordinate minima,
and so of a point and a node's upper corner. Pairs that the bound lets through are verified on the whole texts.

Only links that matter for the classes need verifying, so the trees search twice. At first each document of a group takes
the smallest of those that its tree finds (a linear number of pairs, which settles the large groups of near copies); large
groups are dealt out for that, each part with the group's smallest document. Then the trees search for all pairs whose
documents are still apart. Texts with equal sets are one document throughout.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, blobs, lean, shingle_hashes, table, tune, utf8, word_hashes
from .components import components
from .repeated import repeated, split_heavy

#: Words of a shingle, groups of the count vectors, and entries of a leaf and of an inner node.
WORDS, GROUPS, LEAF, FAN = 5, 256, 16, 8
#: Shingles that are ordered by their frequency, behind all others.
FREQUENT = 1 << 19
#: Documents of a group's part in the first search; of a group's chunk in the second, where any two chunks meet.
PART, CHUNK = 512, 2048
#: Shingles of a run in which frequent ones are counted.
RUN = 1 << 22
#: Queries that a tree answers at once, and rows that one tree holds at most (but for a last group).
QUERIES, ROWS = 1 << 10, 20_000


def shingles(x: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a text's UTF-8 bytes."""
    return shingle_hashes(word_hashes(LOWER[x]), words)


def count_vector(s: np.ndarray) -> np.ndarray:
    """Shingles of each group, in the least width that holds them."""
    count = np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return count.astype(np.min_scalar_type(int(count.max())))


def vectors(column: pa.Array) -> np.ndarray:
    """Count vectors from their bytes."""
    out = np.empty((len(column), GROUPS), np.int32)
    for i, x in enumerate(blobs(column)):
        out[i] = x.view(f"u{len(x) // GROUPS}")
    return out


def needed(a, b, percent: int):  # noqa: ANN001, ANN201
    """The least overlap of sets of sizes a and b at a Jaccard similarity of ``percent`` / 100."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed bottom-up from the points sorted by group, size and leading counts.

    One tree holds many groups: a point's group is its first coordinate. A node keeps the range of its groups, the
    coordinates' maxima and the range of set sizes below it. Search goes down all levels for many queries at once; a node is
    left out if it has no point of the query's group or size, or if the sum of minima with its maxima can't reach the
    overlap that its least size needs.
    """

    def __init__(self, group: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*points.T[:3], sizes, group))
        self.group, self.points, self.sizes = group[self.order], points[self.order].astype(np.int32), sizes[self.order]
        self.levels = []
        first, last, high, low, top, step = self.group, self.group, self.points, self.sizes, self.sizes, LEAF
        while True:
            cut = np.arange(0, len(high), step)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            high, low, top = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)
            self.levels.append((first, last, high, low, top, step))
            if len(high) <= FAN:
                break
            step = FAN

    def search(self, percent: int, ok) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
        """(point, point) pairs of a group that the bound lets through; ``ok`` filters pairs before their bound."""
        group, points, sizes = self.group, self.points, self.sizes
        for at in range(0, len(points), QUERIES):
            q = np.arange(at, min(at + QUERIES, len(points)))
            roots = len(self.levels[-1][0])
            qs, ns = np.repeat(q, roots), np.tile(np.arange(roots), len(q))
            for level in range(len(self.levels) - 1, -1, -1):
                first, last, high, low, top, step = self.levels[level]
                fits = (first[ns] <= group[qs]) & (group[qs] <= last[ns]) & (100 * top[ns] >= percent * sizes[qs]) & (100 * sizes[qs] >= percent * low[ns])
                qs, ns = qs[fits], ns[fits]
                fits = self._bound(points, high, qs, ns) >= needed(sizes[qs], low[ns], percent)
                qs, ns = qs[fits], ns[fits]
                below = len(self.levels[level - 1][0]) if level else len(points)
                child = ns[:, None] * step + np.arange(step)
                qs, ns = np.repeat(qs, step), child.ravel()
                qs, ns = qs[ns < below], ns[ns < below]
            fits = (group[qs] == group[ns]) & (100 * np.minimum(sizes[ns], sizes[qs]) >= percent * np.maximum(sizes[ns], sizes[qs]))
            qs, ns = qs[fits], ns[fits]
            fits = ok(self.order[qs], self.order[ns])
            qs, ns = qs[fits], ns[fits]
            fits = self._bound(points, points, qs, ns) >= needed(sizes[qs], sizes[ns], percent)
            yield self.order[qs[fits]], self.order[ns[fits]]

    @staticmethod
    def _bound(points: np.ndarray, high: np.ndarray, qs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        out = np.empty(len(qs), np.int64)
        for a in range(0, len(qs), 1 << 12):
            out[a : a + (1 << 12)] = np.minimum(points[qs[a : a + (1 << 12)]], high[ns[a : a + (1 << 12)]]).sum(1)
        return out


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: doc_id, n, a digest of the set and its count vector. kind 1: a shingle (as doc_id) that several documents of
    a run of rows have, and how many (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}  # equal sets count once
        n = 0

        def frequent() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(list(held.values())), return_counts=True)
            several = count > 1
            key, count = key[several].view(np.int64), count[several]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), pa.array(key), pa.array(count), pa.nulls(len(key), pa.binary()), pa.nulls(len(key), pa.binary())], names)

        names = ["kind", "doc_id", "n", "digest", "counts"]
        for batch in batches:
            sets = [shingles(x, words) for x in blobs(batch.column(1))]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            out = [[0] * len(sets), batch.column(0).to_pylist(), [len(s) for s in sets], digests, [count_vector(s).tobytes() for s in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)
            for digest, s in zip(digests, sets, strict=True):
                n += 0 if digest in held else len(s)
                held[digest] = s
            if n > RUN:
                yield frequent()
                held, n = {}, 0
        if n:
            yield frequent()

    return docs.mapInArrow(lean(run), "kind int, doc_id long, n long, digest binary, counts binary")


def _prefixes(late: np.ndarray, level: np.ndarray, words: int, percent: int):  # noqa: ANN202
    """Entries for ``repeated``: a document's first shingles under the common order, its id and its size. late: frequent
    shingles, ascending, with their levels of frequency; all others come before them."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for doc, x in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
            s = shingles(x, words)
            n = len(s)
            if n:
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    s = s[np.argsort(np.where(late[at] == s, level[at], 0), kind="stable")]
                s = s[: n - (percent * n + 99) // 100 + 1]
                yield s, np.full(len(s), doc, np.int64), np.full(len(s), n, np.int64)

    return entries


def _verify(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b: ids) that reach the similarity on their whole texts."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(doc: int, x: np.ndarray) -> np.ndarray:
            s = recent.pop(doc, None)
            recent[doc] = s = shingles(x, words) if s is None else s
            if len(recent) > 64:
                recent.popitem(last=False)
            return s

        for batch in batches:
            ok = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), blobs(batch.column(3)), strict=True):
                s, t = of(a, x), of(b, y)
                least = needed(len(s), len(t), percent)
                ok.append(len(np.intersect1d(s, t, assume_unique=True)) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(lean(run), "a long, b long")


def _search(rows: DataFrame, key: list[str], percent: int, first: bool) -> DataFrame:
    """Pairs (a, b: ids, a > b) that the trees find in the groups of ``key``. ``first``: for each document of a group the
    smallest one only; else all pairs of different components whose chunks meet here."""
    columns = [*key, "doc", "n", "counts"] if first else [*key, "doc", "n", "counts", "component", "chunk"]
    rows = rows.select(*columns).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, in trees of about ROWS rows."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                new = np.flatnonzero(changes(rows)) + 1
                if len(new):
                    yield pairs(rows.slice(0, new[-1]))
                    rows = rows.slice(new[-1])
                held = rows.to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    def changes(rows: pa.Table) -> np.ndarray:
        return np.any([(k := rows.column(c).to_numpy())[1:] != k[:-1] for c in key], axis=0)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        doc, size = (rows.column(c).to_numpy() for c in ("doc", "n"))
        group = np.cumsum(np.concatenate(([False], changes(rows))))
        tree = CountTree(group, vectors(rows.column("counts")), size)
        if first:
            least = np.full(len(doc), np.iinfo(np.int64).max)
            for q, e in tree.search(percent, lambda q, e: doc[q] < doc[e]):
                np.minimum.at(least, e, doc[q])
            some = least < doc
            a, b = doc[some], least[some]
        else:
            i, j, chunk, component = (rows.column(c).to_numpy() for c in ("i", "j", "chunk", "component"))
            found = [(doc[e], doc[q]) for q, e in tree.search(percent, lambda q, e: (doc[q] < doc[e]) & (component[q] != component[e]) & ((chunk[q] != chunk[e]) | (i[q] == j[q])))]
            a, b = (np.concatenate([f[k] for f in found] or [doc[:0]]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """doc_id, n_shingles, component_id and digest (of the set) of every row of ``docs`` (doc_id, text: bytes); None if an
    id is null or stands on texts with different sets."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    told = scratch.keep(_describe(docs, words), "told")
    sets = told.filter("kind = 0").select("doc_id", "n", "digest", "counts")
    if not sets.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("doc_id IS NULL OR low < high").limit(1).isEmpty():
        scratch.drop("told")
        return None
    counted = scratch.keep(told.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")), "counted")
    # eight levels of counts to an octave; the highest that hold FREQUENT shingles at most together
    level = F.floor(F.log2("n") * 8).cast("int")
    taken, least = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        taken += r["count"]
        if taken > FREQUENT:
            break
        least = r["level"]
    late, of = np.zeros(0, np.uint64), np.zeros(0, np.int16)
    if least is not None:
        frequent = counted.filter(level >= least).select("doc_id", level.alias("level")).toArrow()  # FREQUENT rows at most
        late, of = frequent["doc_id"].to_numpy().view(np.uint64), frequent["level"].to_numpy().astype(np.int16)
        order = np.argsort(late)
        late, of = late[order], of[order]
    shared = _shared(docs, spark.sparkContext.broadcast((late, of)), words, percent)
    reps = scratch.keep(sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    points = sets.select(F.col("doc_id").alias("doc"), "counts")
    shared = scratch.keep(shared.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi"), "shared")
    scratch.drop("counted")

    # groups of the same documents (told by 128 bits of a hash of them, as sums: repeated rows would cancel in an xor) are searched once
    prints = [F.sum(F.shiftrightunsigned(F.xxhash64("doc", F.lit(k)), 32)).alias(f"x{k}") for k in (1, 2, 3, 4)]

    def once(groups: DataFrame, *more: str) -> DataFrame:
        return groups.groupBy("_n", "x1", "x2", "x3", "x4").agg(F.min(F.struct("h", *more)).alias("g")).select("g.*", "_n")

    groups = once(shared.groupBy("h").agg(F.count("*").alias("_n"), F.min("doc").alias("low"), *prints).filter("_n > 1"), "low")
    near = shared.join(groups, "h")
    parts = F.ceil(F.col("_n") / PART).cast("int")
    part = F.pmod(F.xxhash64("doc"), parts).cast("int")
    near = near.withColumn("i", F.explode(F.when(F.col("doc") == F.col("low"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(part))))
    pairs = scratch.keep(_search(near.drop("_n", "low").join(points, "doc"), ["h", "i"], percent, True), "pairs")
    texts = scratch.keep(docs.join(shared.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    links = scratch.keep(_verify(texts, pairs, words, percent), "links")
    apart = components(scratch, links, "first")

    # groups that still hold several classes
    owned = shared.join(apart.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    owned = scratch.keep(owned, "owned")
    several = owned.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("_n"), *prints)
    several = scratch.keep(once(several.filter("low < high")), "several")
    rest = owned.join(several.select("h"), "h", "left_semi").join(points, "doc")
    rest = split_heavy(rest, several.filter(F.col("_n") > 2 * CHUNK), ["h"], "doc", CHUNK)
    late = scratch.keep(_search(rest, ["h", "i", "j"], percent, False).join(pairs, ["a", "b"], "left_anti"), "late")
    more = scratch.keep(_verify(texts, late, words, percent), "more")
    tree = components(scratch, links.unionByName(more), "second")
    scratch.drop("shared", "pairs", "texts", "links", "owned", "several", "late", "more")  # all read by now

    classes_ = reps.join(tree.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    done = sets.drop("counts").join(classes_, "digest", "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "digest")


def _shared(docs: DataFrame, order, words: int, percent: int) -> DataFrame:  # noqa: ANN001
    """h, doc and n of the prefixes' shingles that several rows have. order: broadcast of the frequent shingles."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return _prefixes(*order.value, words, percent)(batch)

    return repeated(docs, entries).select(F.col("key").alias("h"), F.col("id").alias("doc"), F.col("aux").alias("n"))


def _numbered(docs: DataFrame) -> DataFrame:
    return Scratch(docs.sparkSession).keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def classes(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs`` (doc_id, text).

    A null, empty or blank text has an empty set and links with nothing. A text with fewer words than a shingle is one
    shingle. Rows with equal sets link. Repeated rows have the same result. Where a doc_id is null or stands on different
    texts, rows are numbered first, and each has its own text's result; component_id is the smallest id that is not null,
    or null if there is none. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    done = _classes(docs, words, percent)
    if done is None:
        rows = _numbered(docs)
        done = _classes(rows.select(F.col("_row").alias("doc_id"), "text"), words, percent)
        done = done.withColumnsRenamed({"doc_id": "_row", "component_id": "component"}).join(rows.select("_row", "doc_id"), "_row")
        least = done.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        done = done.join(least, "component")
    return done.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, with all columns. Repeated rows stay or go together.

    Where a doc_id is null or stands on different texts, a class keeps the rows with one of its texts: that of the smallest
    doc_id, null last, and the first by a hash where that has several.
    """
    tune(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    done = _classes(plain, words, percent)
    if done is not None:
        return docs.join(done.filter("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    rows = _numbered(docs)
    done = _classes(rows.select(F.col("_row").alias("doc_id"), utf8().alias("text")), words, percent).withColumnRenamed("doc_id", "_row")
    done = done.join(rows.select("_row", F.col("doc_id").cast("long").alias("_id")), "_row").withColumn("_place", F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("digest").alias("digest")))
    kept = done.join(done.groupBy("component_id").agg(F.min("_place").alias("_least")), "component_id").filter("_place = _least OR n_shingles = 0")
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: shingles of five words, a similarity of 0.8."""
    return classes(table(spark, sf_dir, "documents"))
