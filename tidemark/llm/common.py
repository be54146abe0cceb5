"""Helpers shared by the training-data operators: tables, lineage cuts, Arrow access and hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import shared_dir, ship

#: Rows and bytes of an Arrow batch; texts can be long, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name``; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Send the package to the executors and bound the Arrow batches that Python workers hold."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written to the shared folder, to cut lineage; a lost executor costs no more than a re-read.

    ``keep`` writes a frame as Parquet and reads it back. ``drop`` deletes such a table once nothing reads it any
    more. Shuffle files of the finished jobs are released at each write.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        made(spark).append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        release(self.spark)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


    def clear(self) -> None:
        """Deletes all tables."""
        self.drop("")


def made(spark: SparkSession) -> list[Scratch]:
    """All scratch folders of this Spark context, in the order they were made."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_scratch"):
        context._tidemark_scratch = []
    return context._tidemark_scratch


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


#: Equal rows that one step of ``ranked`` spells out.
COPIES = 1 << 16


def ranked(df: DataFrame, key: str, order: list[str], unique: bool = False) -> DataFrame:
    """Adds _rank: a number of each row among those with the same ``key``, from 0 and without gaps, the same at each run.
    ``order`` holds all other columns that differ (``unique``: it tells all rows of a key apart).

    A key may hold any share of the rows: its rows are ranked in as many parts as there are shuffle partitions, and the
    parts' offsets are sums over their counts. So may equal rows: they are counted on the way, ranked as one row, and
    spelled out in the end.
    """
    columns = df.columns
    if unique:
        df = df.withColumn("_same", F.lit(1).cast("long"))
    else:
        df = df.groupBy(*columns).agg(F.count("*").alias("_same"))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(partitions(df.sparkSession))))
    counts = df.groupBy(key, "_part").agg(F.sum("_same").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1 if unique else F.coalesce(F.sum("_same").over(inside), F.lit(0))
    joined = df.withColumn("_rank", ahead).join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    joined = joined.select(*columns, (F.col("_before") + F.col("_rank")).alias("_rank"), "_same")
    if unique:
        return joined.drop("_same")
    steps = joined.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1, F.lit(COPIES).cast("long"))))
    copies = F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_same")) - 1)
    return steps.withColumn("_copy", F.explode(copies)).select(*columns, (F.col("_rank") + F.col("_copy")).alias("_rank"))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hands memory that this process has freed back to the system; the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Run) -> Run:
    """``run``, a partition's function, which hands its memory back when it is through. Spark keeps idle workers for the tasks
    to come, and what each of them once took would count beside the executor's heap from then on."""

    @wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def utf8(text: str = "text") -> F.Column:
    """The text's UTF-8 bytes; a null text has none."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def blobs(column: pa.Array) -> Iterator[np.ndarray]:
    """Each value of a binary column as bytes in numpy, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield whole[a:b]


_random = np.random.default_rng(20240607)
#: Codes of byte values, of places in a word and of words in a shingle: random odd 64-bit numbers from a fixed seed.
BYTE = _random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
PLACE = _random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
STEP = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
FAR = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: White space of all word rules: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not white space."""
    edge = np.zeros(len(x) + 2, np.int8)
    edge[1:-1] = ~SPACE[x]
    turn = np.diff(edge)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    start, end = word_spans(x)
    if not len(start):
        return np.zeros(0, np.uint64)
    inside = np.flatnonzero(~SPACE[x])
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    code = BYTE[x[inside]] * (PLACE[place & 255] + FAR * (place >> 8).astype(np.uint64))
    return mix(np.add.reduceat(code, first) + length.astype(np.uint64) * FAR)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of ``size`` words; of the whole sequence if it is shorter."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - size + 1, np.uint64(size * int(FAR) % (1 << 64)))
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * STEP[k]
    return np.unique(mix(total))
