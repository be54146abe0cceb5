"""The three sequential folds (rotation of in-memory runs, and pages of flushed and of compacted runs), offsets and seeks.

Where a page or run begins depends on where the one before it began. Rows are range-partitioned in their order; each
partition tells for the few records at which a chain of starts may enter it where that chain leaves it; the driver follows
one chain through these short lists (a page's worth of candidates a partition), and each partition then marks its starts.
No task or driver ever holds a whole run, only a partition of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import table_size
from ..runtime import cut, ship

#: Bytes of a page, and of an in-memory run before the next write rotates it.
PAGE = ROTATE = 4096
NONE = np.iinfo(np.int64).max


def next_starts(begin: np.ndarray, free: np.ndarray, limit: int) -> np.ndarray:
    """Of each record the next start if it is one: the first free record that begins ``limit`` bytes or more after it."""
    allowed = np.append(np.flatnonzero(free), len(begin))
    return allowed[np.searchsorted(allowed, np.searchsorted(begin, begin + limit))]


def _ordered(df: DataFrame, ranges: list[str], order: list[Column | str]) -> DataFrame:
    """Sorted in range partitions, kept as they are; _p: the partition's number."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *ranges).sortWithinPartitions(*order)).withColumn("_p", F.spark_partition_id())


def _base(ordered: DataFrame, size: str) -> DataFrame:
    """_of, _base: the sizes of all partitions before; one row a partition."""
    sums = ordered.groupBy("_p").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("_p").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))


def offsets(log: DataFrame, size: Column, ranges: list[str], order: list[Column | str]) -> DataFrame:
    """Adds begin and end: running sums of ``size`` in ``order``, of which ``ranges`` are the first columns."""
    ordered = _ordered(log.withColumn("_size", size.cast("long")), ranges, order)
    inside = F.sum("_size").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = ordered.withColumn("_inside", inside).join(F.broadcast(_base(ordered, "_size")), F.col("_p") == F.col("_of"))
    end = F.col("_base") + F.col("_inside")
    return summed.select(*log.columns, (end - F.col("_size")).alias("begin"), end.alias("end"))


@dataclass
class Entry:
    """State of the chain where a partition begins: bytes before it, where the next start may be at the earliest, the first
    byte and the first start's number of the run at hand, and starts so far."""

    base: int
    earliest: int
    first: int
    number: int
    starts: int


def _columns(batches: Iterator[pa.RecordBatch], group: str, by_key: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Group, size, whether a start may be there, and whether a group begins, of a partition's records."""
    groups, sizes, free, fresh = [], [], [], []
    last = last_key = None
    for b in batches:
        own = b.column(b.schema.get_field_index(group))
        shift = lambda x, before: pa.concat_arrays([pa.array([before], x.type), x[:-1]])
        differs = lambda x, before: pc.fill_null(pc.not_equal(x, shift(x, before)), True)
        new = np.asarray(differs(own, last))
        fresh.append(new)
        if by_key:
            key = b.column(b.schema.get_field_index("key"))
            free.append(new | np.asarray(differs(key, last_key)))
            last_key = key[-1].as_py()
        else:
            free.append(np.ones(len(own), bool))
        last = own[-1].as_py()
        groups.append(own)
        sizes.append(np.asarray(b.column(b.schema.get_field_index("_size"))))
    return (pa.concat_arrays(groups), *(np.concatenate(x) for x in (sizes, free, fresh))) if groups else (None, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))


def _chained(rows: DataFrame, group: str, ranges: list[str], order: list[Column | str], by_key: bool, limit: int, schema: str, out) -> DataFrame:  # noqa: ANN001
    """Follows the chain of starts through each ``group`` of the ordered rows (which have _size). ``out`` makes a batch from
    one of rows, offsets in the group, starts, and the number of the start that each row follows."""
    ship(rows.sparkSession)
    ordered = _ordered(rows, ranges, order)
    names = [group, "_size", "_p", *(["key"] if by_key else [])]
    kind = rows.schema[group].dataType.simpleString()
    ends = ordered.groupBy("_p").agg(F.sum("_size").alias("bytes"), F.min(F.struct(F.col(group).alias("g"))).alias("low"), F.max(F.struct(F.col(group).alias("g"))).alias("high")).orderBy("_p").collect()
    bases = dict(zip([r["_p"] for r in ends], np.concatenate(([0], np.cumsum([r["bytes"] for r in ends])[:-1])).tolist() if ends else [], strict=True))
    fresh_at = {r["_p"]: i == 0 or ends[i - 1]["high"]["g"] != r["low"]["g"] for i, r in enumerate(ends)}

    def opened(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return None
        p = first.column(first.schema.get_field_index("_p"))[0].as_py()

        def all_() -> Iterator[pa.RecordBatch]:
            yield first
            yield from (b for b in batches if b.num_rows)

        _, size, free, fresh = _columns(all_(), group, by_key)
        fresh[0] = fresh_at[p]
        begin = bases[p] + np.cumsum(size) - size
        return p, begin, free | fresh, fresh, size

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a record at which a chain may enter, where it leaves (the next start's earliest byte) and its starts, up to
        the first group that begins here. kind 1: the same from that group on, and the first byte and the starts of the
        last group."""
        got = opened(batches)
        if got is None:
            return
        p, begin, free, fresh, _ = got
        after = next_starts(begin, free, limit)
        groups = np.flatnonzero(fresh)
        stop = int(groups[0]) if len(groups) else len(begin)
        inside = np.flatnonzero(free[:stop])
        near = int(np.searchsorted(begin[inside], bases[p] + limit)) + 1
        at = inside[:near]
        entry, count, last = begin[at], np.ones(len(at), np.int64), at.copy()
        while True:
            go = after[last] < stop
            if not go.any():
                break
            last[go] = after[last[go]]
            count[go] += 1
        out = [(p, 0, int(e), int(begin[k]) + limit, int(c), 0, 0) for e, k, c in zip(entry, last, count, strict=True)]
        if len(groups):
            total = 0
            for a, b in zip(groups.tolist(), [*groups.tolist(), len(begin)][1:], strict=True):
                k, n = a, 1
                while after[k] < b:
                    k, n = int(after[k]), n + 1
                total += n
            out.append((p, 1, int(begin[groups[0]]), int(begin[k]) + limit, total, int(begin[groups[-1]]), n))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), *(pa.int64(),) * 5))], ["p", "kind", "entry", "leaves", "starts", "first", "own"])

    told: dict[int, list] = {}
    for r in ordered.select(*names).mapInArrow(probe, "p int, kind int, entry long, leaves long, starts long, first long, own long").collect():  # a page's records a partition
        told.setdefault(r.p, []).append(r)
    entries: dict[int, Entry] = {}
    state = Entry(0, 0, 0, 0, 0)
    for p in sorted(told):
        entries[p] = Entry(bases[p], state.earliest, state.first, state.number, state.starts)
        enters = min((r for r in told[p] if r.kind == 0 and r.entry >= state.earliest), key=lambda r: r.entry, default=None)
        if enters:
            state = Entry(0, enters.leaves, state.first, state.number, state.starts + enters.starts)
        for r in told[p]:
            if r.kind == 1:
                state = Entry(0, r.leaves, r.first, state.starts + r.starts - r.own, state.starts + r.starts)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        got = opened(iter(held))
        if got is None:
            return
        p, begin, free, fresh, _ = got
        after, state = next_starts(begin, free, limit), entries[p]
        start = np.zeros(len(begin), bool)
        groups = np.flatnonzero(fresh)
        allowed = np.flatnonzero(free)
        enters = allowed[np.searchsorted(begin[allowed], state.earliest) :][:1].tolist()
        chains = [(k, int(groups[0]) if len(groups) else len(begin)) for k in enters]
        chains += zip(groups.tolist(), [*groups.tolist(), len(begin)][1:], strict=True)
        for k, stop in chains:
            while k < stop:
                start[k] = True
                k = int(after[k])
        number = state.starts + np.cumsum(start) - 1
        own = np.searchsorted(groups, np.arange(len(begin)), "right") - 1
        first = np.where(own >= 0, begin[groups[np.maximum(own, 0)]], state.first) if len(groups) else np.full(len(begin), state.first)
        base = np.where(own >= 0, number[groups[np.maximum(own, 0)]], state.number) if len(groups) else np.full(len(begin), state.number)
        at = 0
        for b in held:
            some = slice(at, at + b.num_rows)
            yield out(b, begin[some] - first[some], start[some], number[some] - base[some])
            at += b.num_rows

    return ordered.mapInArrow(mark, schema.format(kind=kind))


def rotate(log: DataFrame, shard: str, limit: int = ROTATE) -> DataFrame:
    """Adds run (from 0 in each ``shard``): the in-memory run a write falls into, in order of seq. A write opens a new run
    if the run already holds ``limit`` bytes."""
    names = log.columns

    def out(b: pa.RecordBatch, offset: np.ndarray, start: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(number.astype(np.int64))], [*names, "run"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema) + ", run bigint"
    sized = log.withColumn("_size", table_size(F.col("key"), F.col("value")))
    return _chained(sized, shard, [shard, "seq"], [shard, "seq"], False, limit, schema, out)


def pages(log: DataFrame, run: str, unique: bool = False, limit: int = PAGE) -> DataFrame:
    """run, key, seq, offset and page_start of each record of each sorted ``run``.

    A page opens at the first record, and at one that begins ``limit`` bytes or more after the last start. A flushed run has
    all versions, and a page never begins inside a key. A compacted one (``unique``) has each key once.
    """

    def out(b: pa.RecordBatch, offset: np.ndarray, start: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in ("run", "key", "seq")), pa.array(offset.astype(np.int64)), pa.array(start)], ["run", "key", "seq", "offset", "page_start"])

    sized = log.select(F.col(run).alias("run"), "key", "seq", table_size(F.col("key"), F.col("value")).alias("_size"))
    return _chained(sized, "run", ["run", "key"], ["run", "key", F.desc("seq")], not unique, limit, "run {kind}, key binary, seq long, offset long, page_start boolean", out)


def sparse_index(paged: DataFrame) -> DataFrame:
    """First key and offset of each page."""
    return paged.filter("page_start").select("run", "key", "offset")


def page_ranges(index: DataFrame) -> DataFrame:
    """Each page with the first key of the next one (null: the last page)."""
    by_key = Window.partitionBy("run").orderBy("key", "offset")
    return index.select("run", F.col("key").alias("first_key"), "offset", F.lead("key").over(by_key).alias("next_key"))


def _seek(index: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """For each probe (run, key) the ``value`` of the last entry of ``index`` (run, key) at or before it, null before the
    first. Both are range-partitioned together; what a partition inherits is the last entry of those before it, one row a
    partition."""
    kind = index.schema[value].dataType
    both = index.select("run", "key", value, F.lit(0).alias("_probe")).unionByName(probes.select("run", "key", F.lit(None).cast(kind).alias(value), F.lit(1).alias("_probe")))
    ordered = _ordered(both, ["run", "key"], ["run", "key", "_probe", value])
    entry = F.when(F.col("_probe") == 0, F.struct("run", value))
    inside = F.last(entry, ignorenulls=True).over(Window.partitionBy("_p").orderBy("run", "key", "_probe", value).rowsBetween(Window.unboundedPreceding, 0))
    last = ordered.groupBy("_p").agg(F.max(F.when(F.col("_probe") == 0, F.struct("run", "key", value))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(F.col("_p").alias("_of"), before.alias("_carried"))
    found = ordered.withColumn("_inside", inside).filter("_probe = 1").join(F.broadcast(carried), F.col("_p") == F.col("_of"))
    pick = F.coalesce("_inside", F.when(F.col("_carried").isNotNull(), F.struct("_carried.run", F.col(f"_carried.{value}").alias(value))))
    return found.select("run", "key", F.when(pick["run"] == F.col("run"), pick[value]).alias(value)).distinct()


def seek_pages(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (run, key) the offset of the page that may hold it: the last that begins at or before the key; null
    before the first."""
    return _seek(index, probes, "offset")


def seek_files(first_keys: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key the file with the greatest first key at or before it. first_keys: sst_id, first_key."""
    index = first_keys.select(F.lit(0).alias("run"), F.col("first_key").alias("key"), "sst_id")
    return _seek(index, probes.select(F.lit(0).alias("run"), "key"), "sst_id").drop("run")
