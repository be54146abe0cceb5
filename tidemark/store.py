"""A table: a write-ahead log, sorted runs on two levels and a manifest, in one folder of any file system Spark reads.

    path/MANIFEST           JSON, replaced atomically: levels of runs with their key ranges, next ids, batches seen
    path/wal/<n>            Parquet, one folder a write that no run holds yet
    path/runs/<id>          Parquet, range-partitioned and sorted by key, the newest version of a key first

A write is durable once its log folder is there, and visible at the same moment. ``flush`` turns the log into a
level-0 run; four level-0 runs trigger ``compact``, which merges them with the level-1 runs whose key ranges they touch
into new level-1 runs without deletions. Level-1 runs never overlap; those not touched stay as they are.

One writer a table; readers are free. A table opened ``read_only`` never writes or deletes anything, and looks at the
manifest anew for each read; a writer, too, cleans up after a crash only when it first writes. Log folders that are in
runs and runs that were replaced stay until ``vacuum``, so that a reader keeps what its DataFrame was planned with.
"""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import log as ops
from .schema import LEVELS, LOG, MANIFEST

SLICED = T.StructType([*LOG, T.StructField("slice", T.IntegerType())])
#: Level-0 runs that trigger compaction, and rows of a level-1 run, about.
COMPACT_AT, RUN_ROWS = 4, 50_000_000


class Files:
    """The folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.jvm, self.base = spark._jvm, base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over."""
        temporary = self._path(f"{name}.tmp")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self._gateway().new_array(option, 1)
        array[0] = option.OVERWRITE
        context.rename(self.fs.makeQualified(temporary), self.fs.makeQualified(self._path(name)), array)

    def _gateway(self):  # noqa: ANN202
        from pyspark import SparkContext

        return SparkContext._gateway

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"can't move {name} to {to}")


@dataclass
class Run:
    sst_id: int
    rows: int
    low: str  # first and last key, as hexadecimal digits
    high: str
    max_seq: int


@dataclass
class Manifest:
    next_id: int = 1
    next_seq: int = 0
    levels: list[list[Run]] = field(default_factory=lambda: [[] for _ in range(LEVELS)])
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each stream
    flushed: int = 0  # log folders below this number are in runs

    @staticmethod
    def parse(text: str) -> Manifest:
        d = json.loads(text)
        if len(d["levels"]) != LEVELS:
            raise ValueError(f"manifest with {len(d['levels'])} levels")
        return Manifest(d["next_id"], d["next_seq"], [[Run(**r) for r in level] for level in d["levels"]], d["batches"], d["flushed"])


class Closed(RuntimeError):
    pass


class ReadOnly(RuntimeError):
    pass


class Table:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.files, self.path, self.closed = spark, Files(spark, path), path.rstrip("/"), False
        self.read_only, self.writing = read_only, False
        self.manifest = self._load()

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> Table:
        return cls(spark, path, read_only)

    def _load(self) -> Manifest:
        manifest = Manifest.parse(self.files.read("MANIFEST")) if self.files.exists("MANIFEST") else Manifest()
        if not self.read_only and (names := self._log_names(manifest)):
            manifest.next_seq = max(manifest.next_seq, ops.next_seq(self._read_log(names)).first()[0])
        return manifest

    def _log_names(self, manifest: Manifest | None = None) -> list[str]:
        """Log folders that no run holds yet; those without a mark of success are still being written, or never will be."""
        flushed = (manifest or self.manifest).flushed
        return [n for n in self.files.names("wal") if int(n) >= flushed and self.files.exists(f"wal/{n}/_SUCCESS")]

    def _begin(self) -> None:
        """Before a write. The first one clears away what a writer that died has left unfinished."""
        self._check()
        if self.read_only:
            raise ReadOnly(f"{self.path} is open for reading")
        if not self.writing:
            for name in self.files.names("wal"):
                if not self.files.exists(f"wal/{name}/_SUCCESS"):
                    self.files.delete(f"wal/{name}")
            self.writing = True

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def _check(self) -> None:
        if self.closed:
            raise Closed(f"{self.path} is closed")

    # writes

    def put(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Write rows (key, value) in the given order (of ``order``, or of key and value)."""
        self._write(rows.select("*", F.lit(1).cast("tinyint").alias("op")), order or ["key", "value"])

    def erase(self, keys: DataFrame, order: list[str] | None = None) -> None:
        """Delete keys, blindly."""
        self._write(keys.select("*", F.lit(0).cast("tinyint").alias("op"), F.lit(b"").alias("value")), order or ["key"])

    def write(self, rows: DataFrame, order: list[str]) -> None:
        """Write rows (key, op, value) in the total order of ``order``."""
        self._write(rows.withColumn("value", F.when(F.col("op") == 0, F.lit(b"")).otherwise(F.col("value"))), order)

    def _write(self, rows: DataFrame, order: list[str]) -> None:
        self._begin()
        numbered = ops.as_log(ops.assign_seq(rows, order, self.manifest.next_seq))
        name = max([self.manifest.flushed - 1, *map(int, self.files.names("wal"))]) + 1
        path = f"{self.path}/wal/{name:012d}"
        numbered.write.parquet(path)
        last = self.spark.read.schema(LOG).parquet(path).agg(F.max("seq")).first()[0]  # answered from the file just written
        if last is None:
            self.files.delete(f"wal/{name:012d}")
        else:
            self.manifest.next_seq = last + 1

    def flush(self) -> None:
        """The log becomes a level-0 run, with all its versions."""
        self._begin()
        names = self._log_names()
        if names:
            runs, new = self._publish(ops.dedupe_replay(self._read_log(names))), deepcopy(self.manifest)
            new.levels[0] += runs
            new.flushed = int(names[-1]) + 1
            self._save(new)
            if len(self.manifest.levels[0]) >= COMPACT_AT:
                self.compact()

    def load(self, log: DataFrame) -> None:
        """Log rows (key, seq, op, value) that have their numbers already, as a level-0 run."""
        self._begin()
        self.flush()
        runs, new = self._publish(ops.as_log(log)), deepcopy(self.manifest)
        new.levels[0] += runs
        new.next_seq = max([new.next_seq, *(r.max_seq + 1 for r in runs)])
        self._save(new)
        if len(self.manifest.levels[0]) >= COMPACT_AT:
            self.compact()

    def ingest(self, batch: DataFrame, batch_id: int, stream: str, order: list[str]) -> None:
        """One micro-batch (key, op, value) as a level-0 run; a batch that was seen before changes nothing."""
        self._begin()
        if batch_id <= self.manifest.batches.get(stream, -1):
            return
        self.flush()
        rows = batch.withColumn("value", F.when(F.col("op") == 0, F.lit(b"")).otherwise(F.col("value")))
        runs = self._publish(ops.as_log(ops.assign_seq(rows, order, self.manifest.next_seq)))
        new = deepcopy(self.manifest)
        new.levels[0] += runs
        new.next_seq = max([new.next_seq, *(r.max_seq + 1 for r in runs)])
        new.batches[stream] = batch_id
        self._save(new)
        if len(self.manifest.levels[0]) >= COMPACT_AT:
            self.compact()

    def compact(self) -> None:
        """Level 0 and the level-1 runs whose key ranges it touches into level 1: the newest version of each key, without
        deletions, since nothing older lies below. No live key: no run."""
        self._begin()
        upper = self.manifest.levels[0]
        if upper:
            low, high = min(r.low for r in upper), max(r.high for r in upper)
            touched = [r for r in self.manifest.levels[1] if r.low <= high and r.high >= low]
            rows = sum(r.rows for r in [*upper, *touched])
            live = ops.latest(self._read([*upper, *touched])).filter("op = 1")
            runs, new = self._publish(live, max(1, round(rows / RUN_ROWS))), deepcopy(self.manifest)
            kept = [r for r in self.manifest.levels[1] if r not in touched]
            new.levels = [[], sorted([*kept, *runs], key=lambda r: r.low), *([] for _ in range(LEVELS - 2))]
            self._save(new)

    def _publish(self, rows: DataFrame, slices: int = 1) -> list[Run]:
        """Writes rows as runs: as many ``slices`` of the key range, but for empty ones."""
        # a run that was written but never named by a manifest keeps its folder until vacuum
        sst_id = max([self.manifest.next_id, *(int(n) + 1 for n in self.files.names("runs"))])
        path, name = f"{self.path}/runs/{sst_id:06d}", f"runs/{sst_id:06d}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(n * slices, "key").sortWithinPartitions("key", F.desc("seq"))
        writer = ranged.withColumn("slice", F.floor(F.spark_partition_id() / n).cast("int")).write.partitionBy("slice")
        writer.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        if not any(n.startswith("slice=") for n in self.files.names(name)):
            self.files.delete(name)
            return []
        written = self.spark.read.schema(SLICED).parquet(path)
        about = written.groupBy("slice").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("seq")).orderBy("slice").collect()
        runs = [Run(sst_id + 1 + k, r.n, bytes(r.low).hex(), bytes(r.high).hex(), r.seq) for k, r in enumerate(about)]
        for run, r in zip(runs, about, strict=True):
            self.files.move(f"{name}/slice={r.slice}", f"runs/{run.sst_id:06d}")
        self.files.delete(name)
        self.manifest.next_id = runs[-1].sst_id + 1
        return runs

    def _save(self, new: Manifest) -> None:
        """The new manifest counts once it has replaced the old one on disk."""
        self.files.replace("MANIFEST", json.dumps(asdict(new)))
        self.manifest = new

    def vacuum(self) -> list[str]:
        """Delete runs that the manifest no longer names, and log folders that are in runs; the names of the runs. Only for
        when no reader still holds an older DataFrame."""
        self._begin()
        live = {f"{r.sst_id:06d}" for r in self._runs()}
        gone = [name for name in self.files.names("runs") if name not in live]
        for name in gone:
            self.files.delete(f"runs/{name}")
        for name in self.files.names("wal"):
            if int(name) < self.manifest.flushed:
                self.files.delete(f"wal/{name}")
        return gone

    def close(self) -> None:
        """Flush and refuse everything after; again: nothing. A close that fails leaves the log and can be retried."""
        if not self.closed:
            if not self.read_only:
                self.flush()
                self._save(self.manifest)
            self.closed = True

    # reads

    def _runs(self) -> list[Run]:
        return [r for level in self.manifest.levels for r in level]

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return ops.empty(self.spark)
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/runs/{r.sst_id:06d}" for r in runs))

    def _read_log(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/wal/{n}" for n in names)) if names else ops.empty(self.spark)

    def log(self, key: bytes | None = None) -> DataFrame:
        """All versions that are still stored; with ``key``, of the runs whose key range holds it."""
        self._check()
        if self.read_only:
            self.manifest = self._load()  # before the log is listed: what a flush moves meanwhile is seen at least once
        names = self._log_names()
        runs = [r for r in self._runs() if key is None or r.low <= key.hex() <= r.high]
        return self._read(runs).unionByName(self._read_log(names))

    def get(self, key: bytes) -> bytes:
        """The value; empty if the key is missing or deleted."""
        return bytes(ops.get(self.log(key), key).first().value)

    def lookup(self, key: bytes) -> tuple[int, bytes]:
        row = ops.get(self.log(key), key).first()
        return row.status, bytes(row.value)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return ops.multi_get(self.log(), probes)

    def snapshot(self) -> DataFrame:
        return ops.snapshot(self.log())

    def runs(self) -> DataFrame:
        """level, ord, sst_id, n_rows, first_key, last_key and max_seq of each run, as the manifest has them."""
        self._check()
        if self.read_only:
            self.manifest = self._load()
        rows = [(k, i, r.sst_id, r.rows, bytes.fromhex(r.low), bytes.fromhex(r.high), r.max_seq) for k, level in enumerate(self.manifest.levels) for i, r in enumerate(level)]
        return self.spark.createDataFrame(rows, "level int, ord int, sst_id long, n_rows long, first_key binary, last_key binary, max_seq long")

    def manifest_frame(self) -> DataFrame:
        """level, ord and sst_id of each run."""
        rows = [(k, i, r.sst_id) for k, level in enumerate(self.manifest.levels) for i, r in enumerate(level)]
        return self.spark.createDataFrame(rows, MANIFEST)
