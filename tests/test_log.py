"""Log operators, folds, codec and filters against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec
from tidemark.operators import log as ops
from tidemark.operators import pages, workload
from tidemark.plans.queries import ORACLE, QUERIES
from tidemark.schema import LOG
from tidemark.sources import formats

KEYS = [b"", b"\0", b"a", b"a\0", b"k\0x", b"\x80", b"\xff\xfe", b"key"]


def make(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(KEYS), i, op, rng.choice([b"", b"v\0z", b"x" * rng.randint(0, 900)]) if op else b"") for i in range(n) for op in [int(rng.random() < 0.8)]]


def state(rows):
    live = {}
    for key, seq, op, value in sorted(rows, key=lambda r: r[1]):
        if op:
            live[key] = (seq, value)
        else:
            live.pop(key, None)
    return live


@pytest.fixture(scope="module")
def rows():
    return make(1)


@pytest.fixture(scope="module")
def log(spark, rows):
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    return spark.createDataFrame(shuffled, LOG).cache()


def test_state(log, rows):
    want = state(rows)
    assert {bytes(r.key): (r.seq, bytes(r.value)) for r in ops.snapshot(log).collect()} == want
    assert {bytes(r.key) for r in ops.deleted(log).collect()} == {k for k, *_ in rows} - set(want)
    pick = lambda df: sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in df.collect())
    assert pick(ops.latest(log)) == pick(ops.latest_by_rank(log)) == pick(ops.overlay([log.filter("seq > 200"), log.filter("seq <= 200")]))
    assert pick(ops.latest(ops.append(log, log))) == pick(ops.latest(log)) and ops.dedupe_replay(ops.append(log, log)).count() == len(rows)
    for at in (0, 17, 150):
        assert {bytes(r.key): (r.seq, bytes(r.value)) for r in ops.as_of(log, at).collect()} == state([r for r in rows if r[1] <= at])


def test_key_order_is_unsigned(log):
    assert [bytes(r.key) for r in log.select("key").distinct().orderBy("key").collect()] == sorted(KEYS)
    assert {bytes(r.key) for r in ops.key_range(log, b"a", b"\x80").collect()} <= {b"a", b"a\0", b"k\0x", b"key"}


def test_lookups(spark, log, rows):
    want, known = state(rows), {k for k, *_ in rows}
    probes = [*KEYS, b"none", b"zzz", b"a"]
    for r in ops.multi_get(log, spark.createDataFrame([(k, i) for i, k in enumerate(probes)], "key binary, i int")).collect():
        key = probes[r.i]
        assert r.status == (1 if key in want else 2 if key in known else 0)
        assert bytes(r.value) == want.get(key, (0, b""))[1]
    for key in (b"", b"a", b"none"):
        row = ops.get(log, key).collect()
        assert len(row) == 1 and bytes(row[0].value) == want.get(key, (0, b""))[1]


def test_key_filter_reaches_the_scan(spark, log, tmp_path):
    log.write.parquet(f"{tmp_path}/log")
    plan = ops.latest(spark.read.parquet(f"{tmp_path}/log")).filter(F.col("key") == F.lit(b"a")).filter("op = 1")._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(key" in pushed and "op" not in pushed.split("PushedFilters")[1].split("ReadSchema")[0]


def test_assign_seq(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("op"))
    got = ops.assign_seq(df, ["x"], 50).collect()
    assert sorted((r.x, r.seq) for r in got) == [(i, i + 50) for i in range(1000)]
    assert ops.assign_seq(df.limit(0), ["x"]).count() == 0
    assert ops.next_seq(ops.empty(spark)).first()[0] == 0


def test_statistics(log, rows):
    r = ops.statistics(log).first()
    size = sum(len(k) + len(v) for k, _, _, v in rows)
    live = len(state(rows))
    assert (r["keys"], r.live, r.deleted, r.shadowed, r.max_seq, r.log_bytes, r.table_bytes) == (8, live, 8 - live, len(rows) - 8, len(rows) - 1, size + 17 * len(rows), size + 16 * len(rows))
    assert ops.statistics(log.limit(0)).first().log_bytes == 0


def test_rotation_and_pages(log, rows):
    want, used, run = {}, 0, 0
    for key, seq, _, value in rows:
        if used >= 4096:
            used, run = 0, run + 1
        want[seq] = run
        used += 16 + len(key) + len(value)
    assert {r.seq: r.run for r in pages.rotate(log.withColumn("shard", F.lit(1)), "shard").collect()} == want
    off, last, before, index = 0, 0, None, []
    for key, _, _, value in sorted(rows, key=lambda r: (r[0], -r[1])):
        if off == 0 or (off - last >= 4096 and key != before):
            index.append((key, off))
            last = off
        before, off = key, off + 16 + len(key) + len(value)
    paged = pages.pages(log.withColumn("run", F.lit(1)), "run")
    assert sorted((bytes(r.key), r.offset) for r in pages.sparse_index(paged).collect()) == index
    assert formats.decode_index(formats.encode_table(sorted(rows, key=lambda r: (r[0], -r[1])))) == index
    ranges = pages.page_ranges(pages.sparse_index(paged)).collect()
    assert sum(r.next_key is None for r in ranges) == 1


def test_folds_across_partitions_and_groups(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c"]), f"k{rng.randint(0, 12):02d}".encode(), i, 1, b"v" * rng.choice([0, 3, 40])) for i in range(300)]
    log = spark.createDataFrame(rows, "g string, key binary, seq long, op tinyint, value binary")
    size = lambda r: 16 + len(r[1]) + len(r[4])
    for limit in (1, 50, 400, 100_000):
        want, paged, unique = {}, {}, {}
        for g in "abc":
            own, run, held = sorted((r for r in rows if r[0] == g), key=lambda r: r[2]), 0, 0
            for r in own:
                if held >= limit:
                    run, held = run + 1, 0
                want[g, r[2]] = run
                held += size(r)
            for out, any_ in ((paged, False), (unique, True)):
                at, begin, last = 0, None, None
                for r in sorted(own, key=lambda r: (r[1], -r[2])):
                    start = begin is None or (at - begin >= limit and (any_ or r[1] != last))
                    begin = at if start else begin
                    out[g, r[1], r[2]] = (at, start)
                    at, last = at + size(r), r[1]
        assert {(r.g, r.seq): r.run for r in pages.rotate(log, "g", limit).collect()} == want, limit
        assert {(r.run, bytes(r.key), r.seq): (r.offset, r.page_start) for r in pages.pages(log, "g", limit=limit).collect()} == paged, limit
        assert {(r.run, bytes(r.key), r.seq): (r.offset, r.page_start) for r in pages.pages(log, "g", True, limit).collect()} == unique, limit
    assert pages.rotate(log.limit(0), "g").count() == 0 and pages.pages(log.limit(0), "g").count() == 0


def test_seeks_across_partitions(spark):
    import bisect
    import random

    rng = random.Random(9)
    index = [(run, f"{k:04d}".encode(), 7 * k) for run in (1, 2) for k in sorted(rng.sample(range(500, 3000), 40))]
    probes = [(rng.choice([0, 1, 2, 3]), f"{rng.randint(0, 3500):04d}".encode()) for _ in range(300)]
    got = {(r.run, bytes(r.key)): r.offset for r in pages.seek_pages(spark.createDataFrame(index, "run int, key binary, offset long"), spark.createDataFrame(probes, "run int, key binary")).collect()}
    for run, key in probes:
        own = [(k, o) for r, k, o in index if r == run]
        at = bisect.bisect_right([k for k, _ in own], key) - 1
        assert got[run, key] == (own[at][1] if at >= 0 else None)


def test_seek_files(spark):
    files = spark.createDataFrame([(1, b"b"), (2, b"m")], "sst_id long, first_key binary")
    got = pages.seek_files(files, spark.createDataFrame([(b"a",), (b"b",), (b"c",), (b"m",), (b"z",)], "key binary")).collect()
    assert {bytes(r.key): r.sst_id for r in got} == {b"a": None, b"b": 1, b"c": 1, b"m": 2, b"z": 2}


def test_codec(log, rows):
    got = log.select("seq", codec.log_record(F.col("op"), F.col("seq"), F.col("key"), F.col("value")).alias("w"), codec.table_record(F.col("key"), F.col("seq"), F.col("op"), F.col("value")).alias("t"), codec.pack_key(F.col("seq"), F.col("op")).alias("p")).collect()
    for r in got:
        row = rows[r.seq]
        assert bytes(r.w) == formats.encode_log([row]) and r.p == row[1] << 8 | row[2]
        assert bytes(r.t) == formats.encode_table([row])[: 16 + len(row[0]) + len(row[3])]
    back = log.select(codec.decode_table_record(codec.table_record(F.col("key"), F.col("seq"), F.col("op"), F.col("value"))).alias("r")).select("r.*")
    assert sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in back.collect()) == sorted(rows)


def test_large_sequence_numbers(spark):
    big = (1 << 55) + 5
    r = spark.range(1).select(codec.pack_key(F.lit(big), F.lit(1)).alias("p")).select(codec.unpack_seq(F.col("p")).alias("s"), codec.unpack_op(F.col("p")).alias("o"), codec.number(codec.fixed(F.col("p"), 8), 1, 8).alias("n"), "p").first()
    assert (r.s, r.o, r.n) == (big, 1, r.p)
    assert [x.n for x in spark.createDataFrame([(5,), (1234567,)], "i long").select(codec.table_file_name(F.col("i")).alias("n")).collect()] == ["000005.sst", "1234567.sst"]


def test_wire(spark):
    data = spark.createDataFrame([(bytes([0x4B, 1, 2, 0, 0, 0, 1, 0, 0, 0]) + b"abc",), (b"x",), (bytes([0x4B, 1, 9, 0, 0, 0, 1, 0, 0, 0]) + b"abc",)], "d binary").select(codec.decode_wire(F.col("d")).alias("r")).select("r.*").collect()
    assert (data[0].valid, data[0].opcode, bytes(data[0].key), bytes(data[0].value)) == (True, 1, b"ab", b"c")
    assert [r.valid for r in data[1:]] == [False, False]


def test_bloom(spark):
    keys = [*KEYS, *(f"key{i}".encode() for i in range(200))]
    df = spark.createDataFrame([(1, k) for k in keys] + [(2, b"one"), (2, b"one")], "run int, key binary")
    built = {r.run: bytes(r.filter) for r in bloom.build(df, ["run"]).collect()}
    assert built == {1: formats.build_bloom(keys), 2: formats.build_bloom([b"one"])}
    hashes = spark.createDataFrame([(b"hello",), (b"ab",), (b"\xff\x80",), (b"",)], "key binary").select(bloom.bloom_hash(F.col("key"), 0x12345678).alias("h")).collect()
    assert [r.h for r in hashes] == [1724801856, 2830173371, 2680228319, 0x12345678]
    probes = spark.createDataFrame([(k, built[1]) for k in [*keys, *(f"no{i}".encode() for i in range(300))]] + [(b"q", None), (b"q", b"")], "key binary, f binary")
    got = [r.m for r in probes.select(bloom.may_contain(F.col("f"), F.col("key")).alias("m")).collect()]
    assert all(got[: len(keys)]) and all(got[-2:]) and sum(got[len(keys) : -2]) < 25
    halves = df.filter("run = 1").withColumn("run", F.lit(1)).select(F.lit(1).alias("g"), F.lit(formats.build_bloom([b"a"])).alias("filter")).limit(1).unionByName(spark.createDataFrame([(1, formats.build_bloom([b"b"]))], "g int, filter binary"))
    assert bytes(bloom.union(halves, ["g"]).first()["filter"]) == formats.build_bloom([b"a", b"b"])


def test_bloom_probe(spark):
    """Probes meet the words they ask for; no row holds a filter, which would be copied for every probe."""
    keys = spark.createDataFrame([(run, f"{run}-{i}".encode()) for run in (1, 2) for i in range(300 * run)] + [(3, b"")], "run int, key binary")
    probes = spark.createDataFrame([(run, f"{a}-{i}".encode()) for run in (1, 2, 3, 4) for a in (1, 2, 5) for i in range(400)] * 2, "run int, key binary")
    filters = {run: formats.build_bloom([bytes(r.key) for r in keys.filter(f"run = {run}").collect()]) for run in (1, 2, 3)} | {4: b""}
    asked = bloom.probe(probes, keys, ["run"])
    got = {(r.run, bytes(r.key)): r.may for r in asked.collect()}
    assert got == {(r.run, bytes(r.key)): formats.may_contain(filters[r.run], bytes(r.key)) for r in probes.collect()} and asked.count() == len(got)
    assert {r.may for r in bloom.probe(probes.select("key"), keys.limit(0).select("key"), []).collect()} == {False}
    asked = QUERIES["kv_bloom_probe"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in asked._jdf.queryExecution().optimizedPlan().toString()


def test_bloom_build_parts(spark, monkeypatch):
    """A filter's bytes are put together by words and parts, missing ones as zeros, and never looked up one by one."""
    none = spark.createDataFrame([], "key binary")
    assert [(r.n_bits, bytes(r.filter)) for r in bloom.build(none, []).collect()] == [(64, bytes(8))]
    keys = [f"key{i}".encode() for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    built = bloom.build(df, [])
    assert bytes(built.first()["filter"]) == formats.build_bloom(keys)
    assert "element_at" not in built._jdf.queryExecution().optimizedPlan().toString()
    for part in (1, 16, 1024):
        monkeypatch.setattr(bloom, "PART", part)
        for per_key in (1, 10, 7777):
            monkeypatch.setattr(bloom, "BITS_PER_KEY", per_key)
            for some in (keys[:1], keys[:9], keys[:40]):
                want = bytearray(-(-max(per_key * len(some), 64) // 8))
                for bit in (formats.bloom_hash(k, s) % (8 * len(want)) for k in some for s in bloom.SEEDS):
                    want[bit // 8] |= 1 << bit % 8
                assert bytes(bloom.build(df.filter(F.col("key").isin(some)), []).first()["filter"]) == want


def test_workload(spark):
    for name, (read, erase) in workload.SCENARIOS.items():
        counts = {r.action: r["count"] for r in workload.operations(spark, name).groupBy("action").count().collect()}
        assert counts.get("get", 0) == 80 * read and counts.get("erase", 0) == 80 * erase
    done = workload.operations(spark, "mixed_with_delete", 500, 20)
    model, want = {}, {}
    for r in done.orderBy("i").collect():
        if r.action == "get":
            want[r.i] = model.get(r.key, "")
        elif r.action == "put":
            model[r.key] = r.value
        else:
            model.pop(r.key, None)
    assert {r.i: r.expected for r in workload.expected(done).collect()} == want
    assert {bytes(r.key).decode(): bytes(r.value).decode() for r in ops.snapshot(workload.to_log(done)).collect()} == model
    cycle = ops.statistics(workload.correctness_cycle(spark)).first()
    assert (cycle.live, cycle.deleted) == (100, 100)
    p = {r.p: r.value for r in workload.percentiles(spark.createDataFrame([(float(i),) for i in range(4)], "v double"), "v", [50, 99]).collect()}
    assert p == {50: 1.0, 99: 2.0}
    assert [r.value for r in workload.percentiles(spark.createDataFrame([], "v double"), "v", [50]).collect()] == [0.0]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
