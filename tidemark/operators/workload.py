"""Generated workloads, their expected state, and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DELETE, PUT

#: Share of reads and deletions in per cent of each scenario.
SCENARIOS = {"write_heavy": (10, 0), "mixed": (60, 10), "read_heavy": (90, 0), "mixed_with_delete": (50, 20)}


def operations(spark: SparkSession, scenario: str, n: int = 8000, n_keys: int = 1000, value_size: int = 64, seed: int = 42) -> DataFrame:
    """i, action, key and value of n operations, from whole-number arithmetic on i (the same in any SQL engine).

    A roll of 1 to 100 decides: a read up to the reads' share, then a deletion up to both shares, else a write.
    """
    read, erase = SCENARIOS[scenario]
    i = F.col("id")
    roll = (i * 7919 + seed) % 100 + 1
    action = F.when(roll <= read, "get").when(roll <= read + erase, "erase").otherwise("put")
    key = F.concat(F.lit("bench_key_"), ((i * 104729 + seed * 31) % n_keys).cast("string"))
    value = F.repeat(F.char(F.lit(97) + i % 26), value_size)
    return spark.range(n).select(i.alias("i"), action.alias("action"), key.alias("key"), F.when(action == "put", value).otherwise("").alias("value"))


def expected(ops: DataFrame) -> DataFrame:
    """Each read with what it has to return: the last write of its key before it; "" after a deletion or without one."""
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("action") == "put", F.col("value")).when(F.col("action") == "erase", F.lit("")), ignorenulls=True).over(before)
    return ops.withColumn("expected", F.coalesce(last, F.lit(""))).filter("action = 'get'").select("i", "key", "expected")


def to_log(ops: DataFrame) -> DataFrame:
    op = F.when(F.col("action") == "put", PUT).otherwise(DELETE)
    return ops.filter("action != 'get'").select(F.col("key").cast("binary").alias("key"), F.col("i").alias("seq"), op.cast("tinyint").alias("op"), F.col("value").cast("binary").alias("value"))


def hits(reads: DataFrame) -> DataFrame:
    """One row: reads, hits and misses; an empty value is a miss."""
    return reads.agg(F.count("*").alias("reads"), F.count_if(F.col("expected") != "").alias("hits"), F.count_if(F.col("expected") == "").alias("misses"))


def percentiles(df: DataFrame, column: str, points: list[int]) -> DataFrame:
    """One row a point: the element at floor(p / 100 * (n - 1)) of the sorted values, without interpolation; 0.0 if empty.

    Ranks come from range partitions and their counts; no task sorts all values.
    """
    from .log import assign_seq

    numbered = assign_seq(df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), ["v"])
    wanted = numbered.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*map(F.lit, points))).alias("p")).select("p", F.floor(F.col("p") / 100 * (F.col("n") - 1)).alias("rank"))
    found = wanted.join(numbered, F.col("rank") == F.col("seq"), "left")
    return found.select("p", F.coalesce("v", F.lit(0.0)).alias("value"))


def correctness_cycle(spark: SparkSession, n: int = 200) -> DataFrame:
    """The log of a write to each of n keys and a deletion of the even ones."""
    i = F.col("id")
    key = F.concat(F.lit("ckey_"), i.cast("string")).cast("binary")
    writes = spark.range(n).select(key.alias("key"), i.alias("seq"), F.lit(PUT).cast("tinyint").alias("op"), F.concat(F.lit("cval_"), i.cast("string")).cast("binary").alias("value"))
    erased = spark.range(n).filter("id % 2 = 0").select(key.alias("key"), (i / 2 + n).cast("long").alias("seq"), F.lit(DELETE).cast("tinyint").alias("op"), F.lit(b"").alias("value"))
    return writes.unionByName(erased)
