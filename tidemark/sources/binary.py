"""Reading and writing the binary formats with Spark.

``read_log`` and ``read_table`` go through Spark's own file reader, so that any file system it knows will do: one file
a task at least, held as it is while its records pass. The data sources ``kvwal`` and ``kvsst`` offer the same formats to
``spark.read`` and ``df.write`` on folders that all executors share; they hold a record while they read. A writing task
holds what it sorts at once, and begins another file when one is full, so neither grows with the log; a table file still
has all versions of a key.
"""

from __future__ import annotations

import heapq
import io
import os
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..runtime import ship
from ..schema import LOG
from . import formats

_NAMES = ["key", "seq", "op", "value"]
#: Rows of a batch that is read, or bytes if that is reached before.
_ROWS, _BYTES = 10_000, 8 << 20
#: Bytes of records that a writing task sorts at once and what a record takes beside its key and value, bytes of a file after
#: which the next one begins, and sorted runs that are merged at once.
_CHUNK, _RECORD, _FILE, _FAN = 32 << 20, 200, 16 << 20, 64


def _batches(records: Iterator[formats.Record]) -> Iterator[pa.RecordBatch]:
    held: list[formats.Record] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int8(), pa.binary()))], _NAMES)

    for r in records:
        held.append(r)
        size += len(r[0]) + len(r[3])
        if len(held) == _ROWS or size >= _BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _read(spark: SparkSession, path: str, decode) -> DataFrame:  # noqa: ANN001
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from _batches(decode(io.BytesIO(data.as_py())))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, LOG)


def _log_records(f: BinaryIO) -> Iterator[formats.Record]:
    return (record for record, _ in formats.log_records(f))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of log files (path, folder or pattern), of each the longest valid prefix."""
    return _read(spark, path, _log_records)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Records of sorted-table files; a damaged file fails the job."""
    return _read(spark, path, formats.table_records)


def valid_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, valid_size and records of each log file: what a writer would cut it to."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                records = size = 0
                for _, size in formats.log_records(io.BytesIO(data)):
                    records += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)]), pa.array([size]), pa.array([records])], ["path", "size", "valid_size", "records"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, size long, valid_size long, records long")


def trim_log(path: str) -> int:
    """Cut a local log file to its valid prefix; its length afterwards."""
    with open(path, "r+b") as f:
        size = 0
        for _, size in formats.log_records(f):
            pass
        f.truncate(size)
    return size


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, decode) -> None:  # noqa: ANN001
        self.path, self.suffix, self.decode = path, suffix, decode

    def partitions(self) -> list[_File]:
        if not os.path.isdir(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(self.suffix)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with open(partition.path, "rb") as f:
                yield from _batches(self.decode(f))


def _order(r: formats.Record) -> tuple[bytes, int]:
    return r[0], -r[1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[formats.Record]]:
    """A task's records in lists of about ``_CHUNK`` bytes."""
    held: list[formats.Record] = []
    size = 0
    for b in batches:
        for r in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in _NAMES), strict=True):
            held.append(r)
            size += len(r[0]) + len(r[3]) + _RECORD
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Files:
    """Records written one after the other, to files under temporary names; a full one is followed by the next."""

    def __init__(self, folder: str, writer: type[formats.LogWriter | formats.TableWriter]) -> None:
        self.folder, self.writer = folder, writer
        self.names: list[str] = []
        self.out: BinaryIO | None = None
        self.to: formats.LogWriter | formats.TableWriter | None = None
        self.last: formats.Record | None = None

    def add(self, records: Iterator[formats.Record] | list[formats.Record]) -> None:
        for r in records:
            if self.out is None or self.to.size >= _FILE and self.to.may_end(r[0]):
                self.close()
                self.names.append(os.path.join(self.folder, f"{uuid.uuid4().hex}.tmp"))
                self.out = open(self.names[-1], "wb", 1 << 18)  # noqa: SIM115
                self.to = self.writer(self.out)
            self.to.add(r)
            self.last = r

    def close(self) -> None:
        if self.out:
            with self.out:
                self.to.finish()
            self.out = self.to = None

    def records(self) -> Iterator[formats.Record]:
        for name in self.names:
            with open(name, "rb", 1 << 18) as f:
                yield from formats.table_records(f)

    def remove(self) -> None:
        if self.out:
            self.out.close()
        for name in self.names:
            with suppress(FileNotFoundError):
                os.remove(name)


@dataclass
class _Written(WriterCommitMessage):
    temporary: list[str]


class _Writer(DataSourceArrowWriter):
    """Each task writes its files under other names; the commit renames them all."""

    def __init__(self, path: str, suffix: str, overwrite: bool, writer: type[formats.LogWriter | formats.TableWriter]) -> None:
        self.path, self.suffix, self.overwrite, self.writer = path, suffix, overwrite, writer
        os.makedirs(path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        runs: list[_Files] = []
        try:
            self._runs(_chunks(iterator), runs)
            while len(runs) > 1:
                self._merge(runs)
        except BaseException:
            for run in runs:
                run.remove()
            raise
        return _Written([name for run in runs for name in run.names])

    def _runs(self, chunks: Iterator[list[formats.Record]], runs: list[_Files]) -> None:
        """As the records come; those of a table sorted, a run as long as each chunk follows the one before."""
        for chunk in chunks:
            if self.writer is formats.TableWriter:
                chunk.sort(key=_order)
            if not runs or self.writer is formats.TableWriter and _order(chunk[0]) < _order(runs[-1].last):
                if runs:
                    runs[-1].close()
                runs.append(_Files(self.path, self.writer))
            runs[-1].add(chunk)
        if runs:
            runs[-1].close()

    def _merge(self, runs: list[_Files]) -> None:
        """The first runs become one, which is put last but stays in turn: of equal records the first written stays first."""
        for k in range(0, (len(runs) + _FAN - 1) // _FAN):
            some = runs[k : k + _FAN]
            merged = _Files(self.path, self.writer)
            runs.insert(k, merged)
            merged.add(heapq.merge(*(run.records() for run in some), key=_order))
            merged.close()
            del runs[k + 1 : k + 1 + len(some)]
            for run in some:
                run.remove()

    def commit(self, messages: list[_Written | None]) -> None:
        old = [n for n in os.listdir(self.path) if n.endswith(self.suffix)]
        last = max([int(n.split(".")[0]) for n in old if n.split(".")[0].isdigit()], default=0)
        for k, name in enumerate(n for m in messages if m for n in m.temporary):
            os.replace(name, os.path.join(self.path, f"{last + k + 1:06d}{self.suffix}"))
        if self.overwrite:
            for n in old:
                os.remove(os.path.join(self.path, n))

    def abort(self, messages: list[_Written | None]) -> None:
        for name in (n for m in messages if m for n in m.temporary):
            with suppress(FileNotFoundError):
                os.remove(name)


class _Format(DataSource):
    suffix = ""

    def schema(self) -> str:
        return "key binary, seq long, op tinyint, value binary"


class LogFormat(_Format):
    suffix = ".log"

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.suffix, _log_records)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"], self.suffix, overwrite, formats.LogWriter)


class TableFormat(_Format):
    suffix = ".sst"

    @classmethod
    def name(cls) -> str:
        return "kvsst"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.suffix, formats.table_records)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"], self.suffix, overwrite, formats.TableWriter)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LogFormat)
    spark.dataSource.register(TableFormat)
