"""Near duplicates among embeddings: a pigeonhole join over subspaces.

Unit vectors are rotated by a fixed random orthogonal matrix, rounded to a 16-bit grid and cut into blocks of few
coordinates. A pair within the squared distance D (2 - 2 x cosine) is within D x w / n in some block of w of the n
coordinates, so each block is joined by range under that proportional budget. A block's cells are twice as wide as the
budget reaches, over as many of its coordinates as the label's rows need; a vector visits a neighbouring cell only if the
ball around it reaches into that cell, so that a block copies it a few times and not 3 ** coordinates times.

A row in a cell carries two bytes a coordinate. That is enough to decide all pairs but those within a rounding error of
the limit, right where they meet, so that links are counted and joined into trees there and no pair travels (a group of m
near copies has m squared links). Only the doubtful pairs leave the task; their original vectors are fetched and compared
in double precision. A pair that several blocks propose counts in the first of them only, which any task can tell from the
two rows at hand. Vectors equal in all components are joined once and counted with weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, tune
from .components import components
from .repeated import split_heavy

#: Coordinates of a block; rows of a chunk; steps of the integer grid that a unit is divided into.
BLOCK, CHUNK, GRID = 8, 4096, 1 << 14
#: Rows of a label from which more coordinates of each block enter the cell key: one more for each time they grow SPLIT-fold.
WIDE, SPLIT = 1 << 13, 3.7
#: Labels that get more coordinates are broadcast up to so many; beyond, they are joined by shuffle.
DEEP_LABELS = 1 << 16


def rotation(n: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def blocks(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]


def budget(a: int, b: int, n: int, min_cosine: float) -> int:
    """Squared distance on the integer grid that a block's share of the distance may reach, rounding included."""
    distance = (2 - 2 * min_cosine) * (b - a) / n
    return int((np.sqrt(distance) * GRID + np.sqrt(b - a)) ** 2) + 1


def grid(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, rotated and rounded."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return np.rint(unit @ turn * GRID).astype(np.int16)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; scaled first, so that no square overflows or vanishes."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def visits(q: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is a guest there, for the cells that rows of ``q`` visit: their own, and of each two
    opposite neighbours the lower one, if a ball of the squared radius ``reach`` around the row touches it."""
    side = 2 * (int(np.sqrt(reach)) + 1)
    home = np.floor_divide(q, side).astype(np.int64)
    into = q - home * side  # from the cell's lower face
    row, spent, moved = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    cell = np.zeros((len(q), 0), np.int64)
    for i in range(q.shape[1]):
        down, up = (into[row, i] + 1) ** 2 + spent, (side - into[row, i]) ** 2 + spent
        low, high = np.flatnonzero(down <= reach), np.flatnonzero(moved & (up <= reach))
        own = home[row, i]
        cell = np.concatenate([np.column_stack((cell[at], own[at] + step)) for at, step in ((slice(None), 0), (low, -1), (high, 1))])
        spent = np.concatenate((spent, down[low], up[high]))
        moved = np.concatenate((moved, np.ones(len(low) + len(high), bool)))
        row = np.concatenate((row, row[low], row[high]))
    return row, cell.astype(np.int16), moved


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _trees(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``own`` that each place reaches by the links (a, b: places)."""
    root = own.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def _spread(cells: DataFrame, min_cosine: float) -> DataFrame:
    """rep, label, weight, depth and x of each vector to its cells of all blocks."""
    schema = "label string, n int, block int, cell binary, rep long, weight long, guest boolean, q binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            depth, size = np.asarray(batch.column("depth")), np.diff(np.asarray(batch.column("x").offsets))
            flat, at = np.asarray(batch.column("x").flatten()), np.cumsum(size) - size
            for n, d in sorted(set(zip(size.tolist(), depth.tolist(), strict=True))):
                turn = turns[n] = turns[n] if n in turns else rotation(n)
                some = np.flatnonzero((size == n) & (depth == d))
                q = grid(flat[at[some][:, None] + np.arange(n)], turn)
                for k, (a, b) in enumerate(blocks(n)):
                    row, cell, guest = visits(q[:, a : min(b, a + d)].astype(np.int64), budget(a, b, n, min_cosine))
                    for s in range(0, len(row), 20_000):
                        part = row[s : s + 20_000]
                        from_ = pa.array(some[part])
                        m = len(part)
                        columns = [batch.column("label").take(from_), pa.array(np.full(m, n, np.int32)), pa.array(np.full(m, k, np.int32)), _bytes(cell[s : s + 20_000]), batch.column("rep").take(from_), batch.column("weight").take(from_), pa.array(guest[s : s + 20_000]), _bytes(q[part])]
                        yield pa.RecordBatch.from_arrays(columns, ["label", "n", "block", "cell", "rep", "weight", "guest", "q"])

    return cells.select("rep", "label", "weight", "depth", "x").mapInArrow(run, schema)


def _meet(cells: DataFrame, key: list[str], min_cosine: float) -> DataFrame:
    """rep, n (weight that it links with) and root of the sure links; rep and other of the doubtful pairs."""

    def join(group: pa.Table) -> pa.Table:
        n, k, i, j = (group.column(c)[0].as_py() for c in ("n", "block", "i", "j"))
        rep, weight, guest, chunk = (group.column(c).to_numpy() for c in ("rep", "weight", "guest", "chunk"))
        order = np.lexsort((rep, guest))  # those at home first
        rep, weight, guest, chunk = rep[order], weight[order], guest[order], chunk[order]
        q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int16).reshape(-1, n)[order].astype(np.float64)  # exact: far below 2^53
        spans, limit, slack = blocks(n), GRID * np.sqrt(2 - 2 * min_cosine), np.sqrt(n) + 1
        sure: list[tuple[np.ndarray, np.ndarray]] = []
        doubtful: list[tuple[np.ndarray, np.ndarray]] = []
        a, b = spans[k]
        own, square = q[:, a:b], (q[:, a:b] ** 2).sum(1)
        homes = int((~guest).sum())
        for at in range(0, homes, 256):
            end = min(at + 256, homes)
            # all but guest with guest: a home row with later home rows and with the guests
            d = square[at:end, None] + square[None, at:] - 2 * own[at:end] @ own[at:].T
            s, t = np.nonzero(d <= budget(a, b, n, min_cosine))
            s, t = s + at, t + at
            ok = (t > s) & ((chunk[s] != chunk[t]) | (i == j))
            s, t = s[ok], t[ok]
            for c, e in spans[:k]:
                ok = ((q[s, c:e] - q[t, c:e]) ** 2).sum(1) > budget(c, e, n, min_cosine)
                s, t = s[ok], t[ok]
            for u in range(0, len(s), 1 << 16):
                e, f = s[u : u + (1 << 16)], t[u : u + (1 << 16)]
                far = np.sqrt(((q[e] - q[f]) ** 2).sum(1))  # off by less than the slack
                yes, maybe = far < limit - slack, np.abs(far - limit) <= slack
                sure.append((e[yes], f[yes]))
                doubtful.append((rep[e[maybe]], rep[f[maybe]]))
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([x[i] for x in sure] or [none]) for i in (0, 1))
        c, d = (np.concatenate([x[i] for x in doubtful] or [none]) for i in (0, 1))
        count = np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
        at, root = np.flatnonzero(count), _trees(rep, a, b)
        blank = pa.nulls(len(c), pa.int64())
        return pa.table({"rep": pa.array(np.concatenate((rep[at], c)), pa.int64()), "n": pa.concat_arrays([pa.array(count[at].astype(np.int64)), blank]), "root": pa.concat_arrays([pa.array(root[at], pa.int64()), blank]), "other": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(d, pa.int64())])})

    return cells.groupBy(*key, "i", "j").applyInArrow(join, "rep long, n long, root long, other long")


def _verify(pairs: DataFrame, same: DataFrame, min_cosine: float) -> DataFrame:
    """rep, n and root of the doubtful pairs (rep, other) that reach the cosine, from either side."""
    left, right = (same.select(F.col("rep").alias(r), F.col("x").alias(x), F.col("weight").alias(w)) for r, x, w in (("rep", "x", "v"), ("other", "y", "w")))
    both = pairs.join(left, "rep").join(right, "other").select("rep", "other", "v", "w", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                ok.append(cosines(np.asarray(x.values)[None], np.asarray(y.values)[None])[0] >= min_cosine)
            a, b, v, w = (c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:4])
            least = pa.array(np.minimum(np.asarray(a), np.asarray(b)), pa.int64())
            for own, n in ((a, w), (b, v)):
                yield pa.RecordBatch.from_arrays([own, n, least], ["rep", "n", "root"])

    return both.mapInArrow(run, "rep long, n long, root long")


def _label(column: Column, kind: T.DataType) -> Column:
    """Text that is equal if and only if the labels are."""
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(F.struct(column))
    return (column + F.lit(0.0) if isinstance(kind, T.FloatType | T.DoubleType) else column).cast("string")


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Vectors link if their labels (of any type) are equal and not null, they have as many components, and their cosine in
    double precision is at least ``min_cosine`` (over 0). A null or zero vector, or one with a null or non-finite component,
    links with nothing and is its own component. Repeated vectors link with each other, whatever their ids. Inside, vectors
    have keys of their own, so that a vec_id on several vectors mixes nothing up: each row has its own vector's result. A
    null vec_id links as any other; component_id is the smallest id that is not null, or null if there is none; kept is
    whether vec_id equals it, null with null included. An empty table gives an empty result.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    tune(spark)
    x = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", _label(F.col("label"), vectors.schema["label"].dataType).alias("label"), x.alias("x"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # of -0.0 and 0.0 the hash is one; equal vectors are told by all their components
    same = rows.filter("sound").groupBy("label", "x").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    same = scratch.keep(same.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    deep = same.groupBy("label").agg(F.count("*").alias("_n")).filter(F.col("_n") > WIDE)
    deep = scratch.keep(deep.select("label", F.least(1 + F.ceil(F.log(F.col("_n") / WIDE) / float(np.log(SPLIT))), F.lit(BLOCK)).cast("int").alias("depth")), "deep")
    deep = F.broadcast(deep) if deep.count() <= DEEP_LABELS else deep
    leveled = same.join(deep, "label", "left").withColumn("depth", F.coalesce("depth", F.lit(1)))
    cells = scratch.keep(_spread(leveled, min_cosine), "cells")
    key = ["label", "n", "block", "cell"]
    heavy = cells.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * CHUNK)
    met = scratch.keep(_meet(split_heavy(cells, heavy, key, "rep", CHUNK), key, min_cosine), "met")
    scratch.drop("cells", "deep")
    sure = met.filter("other IS NULL").select("rep", "n", "root")
    found = scratch.keep(sure.unionByName(_verify(met.filter("other IS NOT NULL").select("rep", "other"), same, min_cosine)), "found")
    scratch.drop("met")
    tree = components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "components")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    told = same.join(counts, "rep", "left").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
    told = scratch.keep(told.select("label", "x", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "told")
    scratch.drop("distinct", "found")
    least = told.groupBy("component").agg(F.min("low").alias("component_id"))
    done = told.drop("low").join(least, "component").drop("component").withColumn("sound", F.lit(True))
    done = rows.join(done, ["label", "x", "sound"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` at a cosine of 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
