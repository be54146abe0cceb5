"""Operators over the change log: put and erase, lookups, merge, compaction's relational part, history.

The log is a DataFrame of (key, seq, op, value); its state is, for each key, the version with the largest sequence
number, if that is a put. Filters on the key reach the scan through all of these; filters on operation or value never go
below the resolution, since a deletion has to hide what is older.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut
from ..schema import DELETE, DELETED, LOG, MISSING, PUT, SEQ_MASK, VALUE


def as_log(df: DataFrame) -> DataFrame:
    """The four columns with their types."""
    return df.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("tinyint").alias("op"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def assign_seq(df: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """Adds seq: ``base`` and on, without gaps, in the total order of ``order``; only the low 56 bits count.

    Rows are range-partitioned and sorted; a partition's first number is the count of all before it. No task sees all
    rows, and the counts are one row a partition.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # kept, since range bounds are sampled: a second computation might cut the ranges elsewhere
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))  # one row a partition
    return numbered.withColumn("seq", (F.col("_before") + F.col("_row") + base).bitwiseAND(SEQ_MASK)).drop("_at", "_part", "_row", "_p", "_before")


def puts(rows: DataFrame) -> DataFrame:
    """Log rows that write a value. rows: key, seq, value."""
    return as_log(rows.withColumn("op", F.lit(PUT)))


def erasures(keys: DataFrame) -> DataFrame:
    """Log rows that delete, blindly: also keys that never were. keys: key, seq."""
    return as_log(keys.withColumns({"op": F.lit(DELETE), "value": F.lit(b"")}))


def append(log: DataFrame, *more: DataFrame) -> DataFrame:
    for m in more:
        log = log.unionByName(m)
    return log


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key, deletions included. Versions with one (key, seq) are the same write twice."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("_v")).select("key", "seq", "_v.op", "_v.value")


def latest_by_rank(log: DataFrame) -> DataFrame:
    """The same through a window; Spark prunes to one row a key before the shuffle."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return log.withColumn("_r", newest).filter("_r = 1").drop("_r")


def snapshot(log: DataFrame) -> DataFrame:
    """key, seq and value of all live keys."""
    return latest(log).filter(F.col("op") == PUT).select("key", "seq", "value")


def deleted(log: DataFrame) -> DataFrame:
    return latest(log).filter(F.col("op") == DELETE).select("key", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state after the write with number ``seq``."""
    return snapshot(log.filter(F.col("seq") <= seq))


def key_range(log: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Live keys from ``low`` (included) to ``high`` (not included), as unsigned bytes."""
    if low is not None:
        log = log.filter(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.filter(F.col("key") < F.lit(high))
    return snapshot(log)


def history(log: DataFrame) -> DataFrame:
    """All versions with version (1: oldest), newest (whether it is) and until (the next one's seq, or null)."""
    by_seq = Window.partitionBy("key").orderBy("seq")
    after = F.lead("seq").over(by_seq)
    return log.select("*", F.row_number().over(by_seq).alias("version"), after.alias("until"), after.isNull().alias("newest"))


def status(op: Column) -> Column:
    return F.when(op.isNull(), MISSING).when(op == PUT, VALUE).otherwise(DELETED).cast("tinyint")


def get(log: DataFrame, key: bytes) -> DataFrame:
    """One row: status and value of a key; a missing or deleted key has the empty value, as a stored empty one has."""
    found = log.filter(F.col("key") == F.lit(key)).agg(F.max_by(F.struct("op", "value"), "seq").alias("v"))
    return found.select(status(F.col("v.op")).alias("status"), F.when(F.col("v.op") == PUT, F.col("v.value")).otherwise(F.lit(b"")).alias("value"))


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """status and value for each row of ``probes`` (key and any other columns). The log is cut to the probed keys first."""
    keys = probes.select("key").distinct()
    newest = latest(log.join(keys, "key", "left_semi")).select(F.col("key").alias("_key"), "op", F.col("value").alias("_value"))
    joined = probes.join(newest, F.col("key") == F.col("_key"), "left")
    return joined.select(*probes.columns, status(F.col("op")).alias("status"), F.when(F.col("op") == PUT, F.col("_value")).otherwise(F.lit(b"")).alias("value"))


def merge(*runs: DataFrame) -> DataFrame:
    """All runs in one order: key upwards, within a key the newest first."""
    return append(*runs).orderBy("key", F.desc("seq"))


def overlay(tiers: list[DataFrame]) -> DataFrame:
    """The newest version by tier first (the first tier wins), then by seq. On valid input it equals ``latest``."""
    ranked = append(*(t.withColumn("_tier", F.lit(-i)) for i, t in enumerate(tiers)))
    pick = F.struct("_tier", "seq")
    return ranked.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), pick).alias("_v")).select("key", "_v.seq", "_v.op", "_v.value")


def dedupe_replay(log: DataFrame) -> DataFrame:
    """A write that stands in a run and in the replayed log counts once."""
    return log.dropDuplicates(["key", "seq"])


def next_seq(log: DataFrame) -> DataFrame:
    """One row: the number that the next write gets."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


def statistics(log: DataFrame) -> DataFrame:
    """One row: keys, live, deleted, shadowed versions, largest seq, bytes as log and as table records."""
    from ..functions.codec import log_size, table_size

    key, value = F.col("key"), F.col("value")
    by_key = log.groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.sum(log_size(key, value)).alias("log"), F.sum(table_size(key, value)).alias("table"))
    return by_key.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("op") == PUT).alias("live"),
        F.count_if(F.col("op") == DELETE).alias("deleted"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("shadowed"),
        F.max("seq").alias("max_seq"),
        F.coalesce(F.sum("log"), F.lit(0)).alias("log_bytes"),
        F.coalesce(F.sum("table"), F.lit(0)).alias("table_bytes"),
    )
