"""Tables, files and streams: the cases a storage engine has to survive."""

import itertools
import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.schema import LEVELS
from tidemark.sources import binary, formats
from tidemark import store
from tidemark.store import Closed, Manifest, ReadOnly, Table
from tidemark.streaming.ingest import current, ingest


def kv(spark, *pairs):
    return spark.createDataFrame([(k, v) for k, v in pairs], "key binary, value binary")


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "key binary")


def test_crud(spark, tmp_path):
    with Table.open(spark, f"file://{tmp_path}/t") as t:
        assert t.get(b"missing") == b""
        t.put(kv(spark, (b"hello", b"world"), (b"k\0x", b"v\0z"), (b"", b"empty key"), (b"stored", b"")))
        t.put(kv(spark, (b"hello", b"updated")))
        assert (t.get(b"hello"), t.get(b"k\0x"), t.get(b"")) == (b"updated", b"v\0z", b"empty key")
        t.erase(keys(spark, b"hello", b"absent"))
        assert t.lookup(b"hello") == (2, b"") and t.lookup(b"absent") == (2, b"") and t.lookup(b"never") == (0, b"") and t.lookup(b"stored") == (1, b"")
    with pytest.raises(Closed):
        t.get(b"hello")
    with pytest.raises(Closed):
        t.put(kv(spark, (b"a", b"b")))
    t.close()


def test_reopen_tombstones_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = Table.open(spark, path)
    t.put(kv(spark, (b"victim", b"old"), (b"keep", b"1")))
    t.flush()
    t.erase(keys(spark, b"victim"))
    t.flush()
    assert [r.level for r in t.manifest_frame().collect()] == [0, 0] and t.get(b"victim") == b""
    t.close()
    t = Table.open(spark, path)
    assert t.manifest.next_seq == 3 and t.get(b"victim") == b""
    t.put(kv(spark, (b"victim", b"reborn")))
    t.close()
    t = Table.open(spark, path)
    assert t.get(b"victim") == b"reborn"
    reader = t.snapshot()
    t.put(kv(spark, (b"more", b"2")))
    t.flush()  # the fourth run: compaction
    assert [(r.level, r.ord) for r in t.manifest_frame().collect()] == [(1, 0)]
    assert {bytes(r.key): bytes(r.value) for r in reader.collect()} == {b"victim": b"reborn", b"keep": b"1"}, "a reader keeps its runs"
    assert {bytes(r.key): bytes(r.value) for r in t.snapshot().collect()} == {b"victim": b"reborn", b"keep": b"1", b"more": b"2"}
    assert len(t.vacuum()) == 4 and not t.files.names("wal") and t.get(b"more") == b"2"


def test_crash_keeps_the_log(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = Table.open(spark, path)
    t.put(kv(spark, (b"a", b"accepted"), (b"b", b"old")))
    t.erase(keys(spark, b"b"))
    again = Table.open(spark, path)  # as after a crash: nothing was flushed
    assert again.get(b"a") == b"accepted" and again.get(b"b") == b"" and again.manifest.next_seq == 3
    # died after the run was published, before the log was cleared
    again.manifest.levels[0] += again._publish(again.log())
    again.manifest.flushed = 2
    again._save(again.manifest)
    third = Table.open(spark, path)
    assert third.log().count() == 3 and third.get(b"a") == b"accepted"


def test_reader_leaves_a_write_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = Table.open(spark, path)
    t.put(kv(spark, (b"a", b"1")))
    os.makedirs(tmp_path / "t/wal/000000000001/_temporary")  # a write in flight
    for again in (Table.open(spark, path, read_only=True), Table.open(spark, path)):
        assert again.get(b"a") == b"1"
        assert os.path.isdir(tmp_path / "t/wal/000000000001/_temporary")
    reader = Table.open(spark, path, read_only=True)
    for write in (lambda: reader.put(kv(spark, (b"b", b"2"))), reader.flush, reader.compact, reader.vacuum):
        with pytest.raises(ReadOnly):
            write()
    reader.close()
    assert not os.path.exists(tmp_path / "t/MANIFEST")
    Table.open(spark, path).close()  # a writer clears away what is unfinished
    assert not os.path.exists(tmp_path / "t/wal/000000000001") and Table.open(spark, path, read_only=True).get(b"a") == b"1"


def test_reader_during_flushes_and_compaction(spark, tmp_path):
    import threading

    path = f"file://{tmp_path}/t"
    t = Table.open(spark, path)
    t.put(kv(spark, *((f"stable:{i}".encode(), f"value:{i}".encode()) for i in range(10))))
    reader = Table.open(spark, path, read_only=True)
    before, wrong, done = reader.snapshot(), [], threading.Event()

    def read() -> None:
        while not done.is_set():
            got = {bytes(r.key): bytes(r.value) for r in reader.snapshot().collect()}
            wrong.extend(i for i in range(10) if got.get(f"stable:{i}".encode()) != f"value:{i}".encode())

    thread = threading.Thread(target=read)
    thread.start()
    for k in range(5):
        t.flush()
        t.put(kv(spark, (b"marker", str(k).encode())))
    t.flush()
    done.set()
    thread.join()
    assert not wrong and reader.get(b"marker") == b"4" and before.count() == 10
    assert t.manifest.levels[1]


def test_compaction_leaves_other_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "RUN_ROWS", 10)
    t = Table.open(spark, f"file://{tmp_path}/t")
    t.put(kv(spark, *((f"k{i:03d}".encode(), b"old") for i in range(40))))
    t.flush()
    t.compact()
    first = t.manifest.levels[1]
    assert len(first) == 4 and all(a.high < b.low for a, b in zip(first[:-1], first[1:], strict=True)) and sum(r.rows for r in first) == 40
    t.put(kv(spark, (b"k000", b"new"), (b"k002", b"new")))
    t.erase(keys(spark, b"k001"))
    t.flush()
    t.compact()
    second = t.manifest.levels[1]
    assert second[-3:] == first[-3:] and second[0].sst_id > first[-1].sst_id
    assert (t.get(b"k000"), t.get(b"k001"), t.get(b"k003"), t.get(b"k039")) == (b"new", b"", b"old", b"old") and t.snapshot().count() == 39


def test_lookup_by_bloom_filter(spark, tmp_path):
    """An absent key inside a run's key range: the filter of the file answers, no row is read."""
    t = Table.open(spark, f"file://{tmp_path}/t")
    t.put(kv(spark, *((f"k{2 * i:05d}".encode() * 3, b"v" * 20) for i in range(3000))))
    t.flush()

    def read(key: bytes) -> int:
        found = t.log(key).filter(F.col("key") == F.lit(key))
        rows = found.collect()
        plan, count = found._jdf.queryExecution().executedPlan(), 0
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            count += leaf.metrics().apply("numOutputRows").value() if leaf.metrics().contains("numOutputRows") and "Scan" in leaf.nodeName() else 0
        return len(rows), count

    assert read(b"k00100k00100k00100")[0] == 1 and read(b"k00100k00100k00100")[1] > 0
    assert [read(f"k{i:05d}".encode() * 3) for i in (101, 2001, 4001)] == [(0, 0)] * 3


def test_all_deleted(spark, tmp_path):
    t = Table.open(spark, f"file://{tmp_path}/t")
    for k in range(4):
        t.erase(keys(spark, b"k" * 100, bytes([k])))
        t.flush()
    assert t.manifest_frame().count() == 0 and len(t.manifest.levels) == LEVELS
    assert t.files.names("runs") and t.get(b"k" * 100) == b""
    t.close()


def test_failed_close_leaves_the_log(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = Table.open(spark, f"file://{path}")
    t.put(kv(spark, (b"recoverable", b"in the log")))
    os.makedirs(f"{path}/MANIFEST.tmp/block")
    with pytest.raises(Exception):
        t.close()
    with pytest.raises(Exception):
        t.close()
    os.rmdir(f"{path}/MANIFEST.tmp/block")
    os.rmdir(f"{path}/MANIFEST.tmp")
    again = Table.open(spark, f"file://{path}")
    assert again.get(b"recoverable") == b"in the log"
    again.close()


def test_manifest_is_strict():
    with pytest.raises(ValueError):
        Manifest.parse('{"next_id": 1, "next_seq": 0, "levels": [[]], "batches": {}, "flushed": 0}')
    data = formats.encode_manifest(9, [[1, 2], [3], [], [], [], [], []])
    assert formats.decode_manifest(data) == (9, [[1, 2], [3], [], [], [], [], []])
    for cut in (data[:-1], data + b"x", b""):
        with pytest.raises(ValueError):
            formats.decode_manifest(cut)


def test_truncated_log(spark, tmp_path):
    whole = formats.encode_log([(b"complete", 2, 1, b"kept")])
    tail = formats.encode_log([(b"tail", 3, 1, b"partial")])
    for n in range(len(tail)):
        assert formats.decode_log(whole + tail[:n]) == ([(b"complete", 2, 1, b"kept")], len(whole))
    assert formats.decode_log(whole + b"\7" + tail[1:])[1] == len(whole)
    os.makedirs(tmp_path / "logs")
    (tmp_path / "logs/a.log").write_bytes(whole + tail[:-1])
    (tmp_path / "logs/b.log").write_bytes(formats.encode_log([(b"live", 8, 1, b"v"), (b"deleted", 9, 1, b"old"), (b"deleted", 10, 0, b"")]))
    assert binary.read_log(spark, f"{tmp_path}/logs").count() == 4
    sizes = {os.path.basename(r.path): (r.size, r.valid_size, r.records) for r in binary.valid_sizes(spark, f"{tmp_path}/logs").collect()}
    assert sizes["a.log"] == (len(whole + tail) - 1, len(whole), 1)
    assert binary.trim_log(str(tmp_path / "logs/a.log")) == len(whole) == os.path.getsize(tmp_path / "logs/a.log")


def test_table_files():
    rows = sorted([(f"key{i % 50:03d}".encode(), i, i % 5 > 0, b"x" * (i % 300) if i % 5 else b"") for i in range(400)], key=lambda r: (r[0], -r[1]))
    rows = [(k, s, int(o), v) for k, s, o, v in rows]
    data = formats.encode_table(rows)
    assert list(formats.decode_table(data)) == rows
    for key in {r[0] for r in rows}:
        assert formats.search_table(data, key) == max((r for r in rows if r[0] == key), key=lambda r: r[1])
    assert formats.search_table(data, b"absent") is None and formats.search_table(data, b"zz") is None
    with pytest.raises(ValueError):
        formats.encode_table(rows[::-1])
    with pytest.raises(ValueError):
        list(formats.decode_table(data[:-1]))


def test_sources(spark, tmp_path):
    binary.register(spark)
    rows = [(f"k{i}".encode(), i, 1, b"v" * i) for i in range(100)]
    df = spark.createDataFrame(rows, "key binary, seq long, op tinyint, value binary").repartition(3)
    for kind, read in (("kvwal", binary.read_log), ("kvsst", binary.read_table)):
        path = f"{tmp_path}/{kind}"
        for mode in ("append", "overwrite"):
            df.write.format(kind).option("path", path).mode(mode).save()
            for back in (read(spark, path), spark.read.format(kind).load(path)):
                assert sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in back.collect()) == sorted(rows)
        assert not [n for n in os.listdir(path) if n.endswith(".tmp")]


def test_writing_task_is_bounded(tmp_path, monkeypatch):
    """A writing or reading task holds as much of a large log as of a small one, and a table file all versions of a key."""
    monkeypatch.setattr(binary, "_CHUNK", 100_000)
    monkeypatch.setattr(binary, "_FILE", 50_000)
    monkeypatch.setattr(binary, "_FAN", 3)
    monkeypatch.setattr(binary, "_BYTES", 50_000)

    def order(r):
        return r[0], -r[1]

    def batches(rows):
        for at in range(0, len(rows), 100):
            some = rows[at : at + 100]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int8(), pa.binary()))], ["key", "seq", "op", "value"])

    source = {"kvsst": binary.TableFormat, "kvwal": binary.LogFormat}
    for kind, shape in itertools.product(source, ("sorted", "reversed", "shuffled")):
        peaks = []
        for n in (3000, 12000):
            rows = sorted(((f"k{i * 7 % (n // 3):06d}".encode(), i, 1, b"v" * 300) for i in range(n)), key=order)
            rows.append((b"k999999", n, 1, b"last"))
            if shape == "reversed":
                rows.reverse()
            elif shape == "shuffled":
                random.Random(5).shuffle(rows)
            form = source[kind]({"path": f"{tmp_path}/{kind}-{shape}-{n}"})
            writer = form.writer(None, False)
            tracemalloc.start()
            written = writer.write(batches(rows))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            writer.commit([None, written])
            names = sorted(os.listdir(writer.path))
            assert names == [f"{i + 1:06d}{form.suffix}" for i in range(len(names))] and len(names) > 5
            reader = form.reader(None)
            found = [[r for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))] for p in reader.partitions()]
            assert list(itertools.chain(*found)) == (sorted(rows, key=order) if kind == "kvsst" else rows)
            if kind == "kvsst":
                for records, name in zip(found, names):
                    with open(f"{writer.path}/{name}", "rb") as f:
                        assert f.read() == formats.encode_table(records)
                assert all(a[-1][0] < b[0][0] for a, b in zip(found, found[1:]))
            largest = max(os.path.getsize(f"{writer.path}/{name}") for name in names)
            assert largest < 80_000
        assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 2_500_000, (kind, shape, peaks)
    again = binary.TableFormat({"path": f"{tmp_path}/failed"}).writer(None, False)

    def fails():
        yield from batches(rows)
        raise OSError

    with pytest.raises(OSError):
        again.write(fails())
    assert not os.listdir(again.path)


def test_stream(spark, tmp_path):
    rows = [(i % 7, i, i % 5 > 0, f"v{i}") for i in range(60)]
    schema = "k int, i long, put boolean, v string"
    for a in range(0, 60, 20):
        spark.createDataFrame(rows[a : a + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    shaped = stream.select(F.col("k").cast("string").cast("binary").alias("key"), F.col("put").cast("tinyint").alias("op"), F.col("v").cast("binary").alias("value"), "i")
    table = Table.open(spark, f"file://{tmp_path}/t")
    ingest(shaped, table, f"{tmp_path}/cp", ["i"]).trigger(availableNow=True).start().awaitTermination()
    batches = dict(table.manifest.batches)
    table.ingest(spark.createDataFrame([(b"x", 1, b"replayed", 1)], "key binary, op tinyint, value binary, i long"), batches["ingest"], "ingest", ["i"])
    want = {}
    log = stream.select(F.col("k").cast("string").cast("binary").alias("key"), F.col("i").alias("seq"), F.col("put").cast("tinyint").alias("op"), F.col("v").cast("binary").alias("value"))
    current(log).writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start().awaitTermination()
    for k, i, put, v in rows:
        want[str(k).encode()] = (i, put, v.encode())
    assert {bytes(r.key): (r.seq, bool(r.op), bytes(r.value)) for r in spark.table("state").collect()} == want
    assert table.snapshot().count() > 0 and table.get(b"x") == b""
