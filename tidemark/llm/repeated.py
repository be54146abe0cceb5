"""Keys that occur more than once in a corpus, with all their occurrences.

Each task sorts the keys of a run of rows. Only the first occurrence of a key in such a run travels to the key's bucket;
the others are known to be repeated and bypass it. A key that fills a third of the corpus thus sends its bucket one entry
a run. Entries travel in packed blocks, a few a task and bucket, rather than as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, tune

#: Entries that a task sorts at once.
RUN = 1 << 20
SCHEMA = "key long, id long, aux long"
_BLOCK = "bucket int, keys binary, ids binary, aux binary, known binary"

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pack(bucket: int, keys: np.ndarray, ids: np.ndarray, aux: np.ndarray, known: np.ndarray) -> tuple:
    return bucket, keys.tobytes(), ids.tobytes(), aux.tobytes(), known.astype(np.uint8).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), *(pa.binary(),) * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "keys", "ids", "aux", "known"])


def _run(n_buckets: int, turn: int, keys: np.ndarray, ids: np.ndarray, aux: np.ndarray) -> pa.RecordBatch:
    """Blocks of one sorted run. known: 0 first and alone, 1 first of several, 2 a later one (already known)."""
    order = np.lexsort((ids, keys))
    keys, ids, aux = keys[order], ids[order], aux[order]
    same = np.concatenate(([False], keys[1:] == keys[:-1]))
    known = np.where(same, 2, np.concatenate((same[1:], [False])).astype(np.uint8))
    rows = []
    first = np.flatnonzero(~same)
    bucket = ((keys[first] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(first, cuts):
        if len(part):
            rows.append(_pack(int((int(keys[part[0]]) >> 32) * n_buckets >> 32), keys[part], ids[part], aux[part], known[part]))
    later = np.flatnonzero(same)
    for k, part in enumerate(np.array_split(later, max(1, len(later) >> 15))):
        if len(part):
            rows.append(_pack((turn + k * 7919) % n_buckets, keys[part], ids[part], aux[part], known[part]))
    return _batch(rows)


def repeated(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[Entries]]) -> DataFrame:
    """key, id, aux of every entry whose key some other entry has.

    ``entries`` gives arrays (key uint64 and evenly spread, id int64, aux int64) of each row of a batch.
    """
    tune(rows.sparkSession)
    n_buckets = 4 * partitions(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        n = turn = 0
        for batch in batches:
            for e in entries(batch):
                if len(e[0]):
                    held.append(e)
                    n += len(e[0])
                    turn = (turn * 31 + int(e[0][0])) & 0xFFFFFF
                    if n >= RUN:
                        yield _run(n_buckets, turn, *(np.concatenate([h[i] for h in held]) for i in range(3)))
                        held, n = [], 0
        if held:
            yield _run(n_buckets, turn, *(np.concatenate([h[i] for h in held]) for i in range(3)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                for to, blob, kind in zip(got, row, (np.uint64, np.int64, np.int64, np.uint8), strict=True):
                    to.append(np.frombuffer(blob, kind))
        if not got[0]:
            return
        keys, ids, aux, known = (np.concatenate(x) for x in got)
        del got
        keep = known > 0
        met = np.flatnonzero(known < 2)
        met = met[np.argsort(keys[met], kind="stable")]
        same = keys[met[1:]] == keys[met[:-1]]
        keep[met[1:][same]] = True
        keep[met[:-1][same]] = True
        at = np.flatnonzero(keep)
        for part in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(ids[part]), pa.array(aux[part])], ["key", "id", "aux"])

    return rows.mapInArrow(lean(send), _BLOCK).repartition(n_buckets // 4, "bucket").mapInArrow(lean(meet), SCHEMA)


def split_heavy(rows: DataFrame, heavy: DataFrame, keys: list[str], id_: str, limit: int) -> DataFrame:
    """Deals large groups out to bounded tasks: adds chunk, i and j.

    A group of n rows (``heavy`` has the n over ``limit`` as _n) is cut into n/limit chunks by a hash of ``id_``; a task
    gets two chunks i <= j. A row goes to all tasks of its chunk, so that any two rows of a group meet in exactly one
    task: that of their two chunks. Other groups are one task.
    """
    n = F.coalesce(F.ceil(F.col("_n") / limit).cast("int"), F.lit(1))
    rows = rows.join(heavy, keys, "left").withColumn("_chunks", n).drop("_n")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(id_), F.col("_chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")
    rows = rows.select("*", other)
    return rows.withColumns({"i": F.least("chunk", "_other"), "j": F.greatest("chunk", "_other")}).drop("_chunks", "_other")
