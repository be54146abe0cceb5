"""Toxicity: a bag of subword embeddings, averaged, under a linear softmax; both are trained jointly in numpy.

A word's features are hashes of its character 3-, 4- and 5-grams (with word edges) and of the whole word, so that an
unseen misspelling shares most vectors with the word it comes from. Training takes whole texts of a bounded sample of
labelled rows; scoring covers every whole text, and needs one number a bucket, since average and layer are linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, FAR, LOWER, PLACE, SPACE, STEP, blobs, mix, table, tune, utf8, word_hashes
from .langid import fold

#: Hash buckets, embedding size, and labelled rows of each class that training may use.
BUCKETS, SIZE, SAMPLE = 1 << 15, 12, 3000
EPOCHS, STEPS, BATCH, RATE = 14, 600, 64, 0.05
SHARPNESS = 100.0
SALT = np.arange(8, dtype=np.uint64) * FAR


def features(x: np.ndarray) -> np.ndarray:
    """Hash buckets of all n-grams inside words of UTF-8 bytes, with repeats."""
    x = LOWER[x]
    padded = np.concatenate(([np.uint8(32)], x, [np.uint8(32)]))
    blank = SPACE[padded]
    code = BYTE[np.where(blank, np.uint8(32), padded)]
    out = [word_hashes(x)]
    inner = np.cumsum(blank)
    h = code[:-1] * PLACE[0] + code[1:] * PLACE[1]
    for n in (3, 4, 5):
        if len(padded) < n:
            break
        h = h[: len(padded) - n + 1] + code[n - 1 :] * PLACE[n - 1]
        # no blank strictly inside, and not blanks alone
        whole = inner[n - 2 : len(padded) - 1] == inner[: len(padded) - n + 1]
        out.append(mix(h[whole] + SALT[n]))
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: embedding times the difference of the softmax's two rows
    bias: float

    def score(self, x: np.ndarray) -> float:
        """Probability of label 1, of a text's UTF-8 bytes."""
        f = features(x)
        z = self.bias + (float(self.weight[f].mean()) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[tuple[int, bytes, bytes]], seed: int = 7) -> Model:
    """rows: label, and a text's distinct buckets (uint16) with their shares (float32). Adagrad on the log loss."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    labels = np.array([r[0] for r in rows])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(4 * (labels.mean() - 0.5)) if len(rows) else 0.0)
    table_, layer, bias = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_t, seen_l, seen_b = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    dense = np.zeros((BATCH, BUCKETS), np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(rows)))  # few rows: at least STEPS steps
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            dense[:] = 0
            for i, k in enumerate(some):
                dense[i, np.frombuffer(rows[k][1], np.uint16)] = np.frombuffer(rows[k][2], np.float32)
            # mean of the embeddings; SHARPNESS lets few telling words show among many plain ones
            bag = dense[: len(some)] * np.float32(SHARPNESS)
            hidden = bag @ table_
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            g_layer, g_bias, g_hidden = hidden.T @ p, p.sum(0), p @ layer.T
            g_table = bag.T @ g_hidden
            seen_t += (g_table**2).mean(1, keepdims=True)
            seen_l += g_layer**2
            seen_b += g_bias**2
            table_ -= rate * g_table / np.sqrt(seen_t)
            layer -= rate * g_layer / np.sqrt(seen_l)
            bias -= rate * g_bias / np.sqrt(seen_b)
    return Model((table_ @ (layer[:, 1] - layer[:, 0]) * SHARPNESS).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents a class, those with the least hashes of doc_id. docs: doc_id, text; labels:
    doc_id, toxic.

    Of labels that differ for one doc_id the toxic one holds; a doc_id on several texts counts as one document, by the least
    of them. Executors reduce whole texts to counts of buckets; the driver gets a bounded number of bounded vectors.
    """
    labels = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit"))
    # each task sends its least ones only
    least = [labels.filter(F.col("toxic") == k).orderBy(place, "doc_id").limit(sample) for k in (0, 1)]
    picked = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(least[0].unionByName(least[1])), "doc_id")  # 2 x sample rows at most
    picked = picked.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, x in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                at, n = np.unique(features(x), return_counts=True)
                out.append((label, at.astype(np.uint16).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["label", "at", "share"])

    return fit([tuple(r) for r in picked.select("toxic", "text").mapInArrow(count, "label int, at binary, share binary").collect()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id (null ones too) and score (0 to 1) of every row; null and empty texts score by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(x) for x in blobs(batch.column(1))], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row of ``documents``; learned from rows whose fold of 5 is not 0."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(5) != 0), table(spark, sf_dir, "labels").filter(fold(5) != 0))
    return score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
