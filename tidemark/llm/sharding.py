"""Sharding by longest-processing-time scheduling: groups stay together, largest first, to the least-loaded shard.

The law kept is ``bytes``: the shards' sizes are as near equal as whole groups allow. Rows with equal texts form a
group. Groups of one size are alike to the schedule, so that it works on counts by size: largest size first, the heap
deals its groups out one by one; where they are many, the same result comes from one sweep over the shards, since equal
steps from the shards' loads are taken in order. Sizes that differ are at most sqrt(2 x all bytes), as they add up to no
more than everything, so that the driver holds few numbers whatever the number of groups. Groups are then ranked within
their size on the executors and look their shard up by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ranked, table, utf8

#: Sizes up to which the schedule is broadcast; beyond, it is joined by shuffle.
BROADCAST = 1 << 16


def _one_by_one(loads: list[int], size: int, n: int) -> list[int]:
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    out = [0] * len(loads)
    for _ in range(n):
        load, shard = heap[0]
        out[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return out


def _sweep(loads: list[int], size: int, n: int) -> list[int]:
    """What the heap does with ``n`` equal groups: it takes the loads at which a shard gets one, ``load + k x size``, in
    order (ties by shard), and stops after n. So all up to some load are taken, and the first few right above it."""

    def below(level: int) -> list[int]:
        return [max(0, (level - load) // size + 1) for load in loads]

    low, high = min(loads) - 1, min(loads) + n * size
    while high - low > 1:  # at `low` at most n are taken, at `high` more
        level = (low + high) // 2
        low, high = (level, high) if sum(below(level)) <= n else (low, level)
    out = below(low)
    left = n - sum(out)
    for shard, load in enumerate(loads):
        if left and high >= load and (high - load) % size == 0:
            out[shard] += 1
            left -= 1
    return out


def schedule(counts: Iterable[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """counts: size (over 0) and number of the groups of each size. Returns each size, largest first, with the number of
    its groups that each shard gets: always the least-loaded one, ties by number."""
    loads, out = [0] * n_shards, []
    for size, n in sorted(counts, reverse=True):
        got = (_one_by_one if n <= 8 * n_shards else _sweep)(loads, size, n)
        loads = [load + k * size for load, k in zip(loads, got, strict=True)]
        out.append((size, got))
    return out


def _places(spark: SparkSession, plan: list[tuple[int, list[int]]]) -> DataFrame:
    """load, and of the shards that get groups of it the numbers (shards) and the ranks where they end (ends)."""
    ends, shards = [], []
    for _, got in plan:
        got = np.array(got, np.int64)
        some = np.flatnonzero(got)
        ends.append(np.cumsum(got[some]))
        shards.append(some.astype(np.int32))
    columns = pa.array([size for size, _ in plan], pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(shards, pa.list_(pa.int32()))
    schema = T.StructType([T.StructField("load", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("shards", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame(pa.table(dict(zip(("load", "ends", "shards"), columns, strict=True))), schema)


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text; other columns are ignored).

    Size: UTF-8 bytes of the text plus 8. A null text counts as an empty one, also for grouping. Slots run gapless
    from 0 in each shard. Repeated rows, and rows with a null doc_id, each get a slot; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select("doc_id", utf8().alias("_t")).select("doc_id", (F.octet_length("_t") + 8).cast("long").alias("size"), F.crc32("_t").alias("text_crc32"), F.xxhash64("_t").alias("_group"))
    rows = scratch.keep(rows, "rows")
    groups = scratch.keep(rows.groupBy("_group").agg(F.sum("size").alias("load")), "groups")
    counts = groups.groupBy("load").count().toArrow()  # sizes that differ: sqrt(2 x all bytes) at most
    plan = schedule(zip(counts["load"].to_pylist(), counts["count"].to_pylist(), strict=True), n_shards)
    places = _places(spark, plan)
    placed = ranked(groups, "load", ["_group"], unique=True).join(F.broadcast(places) if len(plan) <= BROADCAST else places, "load")
    placed = placed.select("_group", F.element_at("shards", F.array_position(F.transform("ends", lambda e: e > F.col("_rank")), F.lit(True)).cast("int")).alias("shard"))
    done = rows.join(placed, "_group").select("doc_id", "size", "text_crc32", "shard")
    return ranked(done, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "shard", F.col("_rank").cast("long").alias("slot"))


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` into 24 shards by the law ``bytes``."""
    done = shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
