"""Structured Streaming into a table, and the state of a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..store import Table


def ingest(stream: DataFrame, table: Table, checkpoint: str, order: list[str], name: str = "ingest") -> DataStreamWriter:
    """Each micro-batch of (key, op, value) becomes a level-0 run; compaction follows when enough have gathered.

    The manifest remembers the last batch of ``name``, so a batch that is replayed after a failure changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table.ingest(batch, batch_id, name, order)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def current(stream: DataFrame) -> DataFrame:
    """The newest version of each key of a stream of log rows, in update or complete mode; arrival order is no matter."""
    return stream.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "seq", "v.op", "v.value")
