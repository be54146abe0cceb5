"""Language identification by nearest centroid over TF-IDF vectors of hashed character n-grams.

A document is a unit vector of TF-IDF weights over hashed 1- to 3-grams of its lower-cased letters; each language
has several centroids, from a spherical k-means of its training vectors. The nearest centroid by cosine gives the
language; a document farther from it than nearly all of that centroid's own training documents is flagged as
rejected. Fitting uses a bounded sample of labelled rows; prediction covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FAR, STEP, mix, table, tune

#: Hash buckets of the n-grams; labelled rows a language that training may use; languages beyond which that share
#: shrinks; centroids each.
DIMS, SAMPLE, LANGUAGES, CENTROIDS = 1 << 13, 1500, 64, 4
#: The share of a centroid's training documents that its rejection distance leaves outside.
OUTSIDE = 0.002
SALT = np.arange(8, dtype=np.uint64) * FAR


def grams(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the letters, runs of anything else read as one space; empty without a letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters(x)
    if not letter.any():
        return np.zeros(0, np.float32)
    keep = letter | np.concatenate(([True], letter[:-1]))
    x = np.where(letter, x, 32)[keep].astype(np.uint64)
    x = np.concatenate(([np.uint64(32)], x, [np.uint64(32)]))
    out = np.bincount((mix(x * STEP[0] + FAR) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)
    for n in (2, 3):
        h = x[n - 1 :] * STEP[0]
        for k in range(1, n):
            h = h + x[n - 1 - k : len(x) - k] * STEP[k]
        out += np.bincount((mix(h + SALT[n]) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)
    return out.astype(np.float32)


_LETTER: list[np.ndarray] = []


def _letters(x: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0][x]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    least: np.ndarray  # the cosine below which a centroid rejects

    def vector(self, text: str) -> np.ndarray | None:
        counts = grams(text)
        return None if not len(counts) else _unit(counts, self.idf)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid, and whether that is too far; "und" without a letter."""
        v = self.vector(text)
        if v is None or not self.languages:
            return "und", 0.0, True
        cos = self.centroids @ v
        k = int(cos.argmax())
        return self.languages[k], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < self.least[k])


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / max(float(np.linalg.norm(v)), 1e-12)


def fit(rows: list[tuple[str, bytes, bytes]]) -> Model:
    """rows: language, and a document's non-zero buckets (uint16) with their counts (uint32)."""
    rows = sorted(rows)
    counts = np.zeros((len(rows), DIMS), np.float32)
    for i, (_, at, n) in enumerate(rows):
        counts[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    names, centers, least = [], [], []
    np.log1p(counts, out=counts)
    counts *= idf
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    of = np.array([r[0] for r in rows])
    for lang in sorted(set(of.tolist())):
        own = counts[of == lang]
        k = min(CENTROIDS, len(own))
        c = own[np.linspace(0, len(own) - 1, k).astype(int)]
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        cos = own @ c.T
        near = cos.argmax(1)
        for j in range(k):
            mine = cos[near == j, j]
            names.append(lang)
            centers.append(c[j])
            least.append(float(np.quantile(mine, OUTSIDE)) if len(mine) else 0.0)
    return Model(names, np.array(centers, np.float32).reshape(-1, DIMS), idf, np.array(least))


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows (doc_id, text, lang) of each language, picked by a hash of doc_id; beyond
    ``LANGUAGES`` languages the share of each shrinks, so that all together stay as many. Executors count the n-grams; the driver gets a bounded number of bounded vectors."""
    from pyspark.sql.window import Window

    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(0))
    # twice the share wanted, by hash and without a shuffle of the rest; then the first of each language
    sample = max(CENTROIDS, sample * LANGUAGES // max(LANGUAGES, len(sizes)))
    chances = rows.sparkSession.createDataFrame([(r["lang"], (2.0 * sample + 20) / r["count"]) for r in sizes], "lang string, _chance double")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(chances), "lang").withColumn("_place", place).filter(F.col("_place") < F.col("_chance"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))
    picked = picked.withColumn("_n", first).filter(F.col("_n") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = grams(text)
                if len(c):
                    at = np.flatnonzero(c)
                    out.append((lang, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "at", "n"])

    return fit([tuple(r) for r in picked.mapInArrow(count, "lang string, at binary, n binary").collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected for every row; a null text has no letter, hence "und"."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by DIMS, CENTROIDS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [own.predict(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``; learned from rows whose fold of 3 is not 1.

    No document is left without a language for its distance: ``rejected`` stands beside the nearest one.
    """
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(3) != 1).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
