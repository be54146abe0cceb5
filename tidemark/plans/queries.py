"""The engine's operators as queries over the driver's tables, each with SQL for DuckDB.

The table ``events`` is the change log: key user_id (as text bytes), seq event_id, a deletion where event_type is
'error', else a put of event_type and props.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..operators import log as ops
from ..operators import pages, workload
from ..runtime import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "props")
    erased = F.col("event_type") == "error"
    value = F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))
    return ops.as_log(rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(erased, 0).otherwise(1).alias("op"), F.when(erased, "").otherwise(value).alias("value")))


def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


LOG = """WITH log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|' || coalesce(props, '') END AS value FROM events)"""
LATEST = LOG + ", latest AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log GROUP BY key)"


@query(f"{LOG} SELECT key, seq, op, value FROM log")
def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and blind deletions, appended."""
    log = events(spark, sf_dir)
    done = ops.append(ops.puts(log.filter("op = 1").select("key", "seq", "value")), ops.erasures(log.filter("op = 0").select("key", "seq")))
    return done.select(text("key"), "seq", F.col("op").cast("int").alias("op"), text("value"))


@query(f"{LATEST} SELECT key, seq, value FROM latest WHERE op = 1")
def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snapshot(events(spark, sf_dir)).select(text("key"), "seq", text("value"))


@query(f"{LATEST} SELECT key, seq FROM latest WHERE op = 0")
def kv_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deleted(events(spark, sf_dir)).select(text("key"), "seq")


@query(f"{LOG} SELECT key, seq, op, value FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def kv_latest_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_by_rank(events(spark, sf_dir)).select(text("key"), "seq", F.col("op").cast("int").alias("op"), text("value"))


@query(f"{LATEST} SELECT CASE WHEN count(*) = 0 THEN 0 WHEN max(op) = 1 THEN 1 ELSE 2 END AS status, coalesce(max(CASE WHEN op = 1 THEN value END), '') AS value FROM latest WHERE key = '7'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.get(events(spark, sf_dir), b"7").select(F.col("status").cast("int").alias("status"), text("value"))


@query("SELECT 0 AS status, '' AS value")
def kv_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.get(events(spark, sf_dir), b"no such key").select(F.col("status").cast("int").alias("status"), text("value"))


@query(f"""{LATEST} SELECT c_custkey, CASE WHEN op IS NULL THEN 0 WHEN op = 1 THEN 1 ELSE 2 END AS status, CASE WHEN op = 1 THEN value ELSE '' END AS value
FROM customer LEFT JOIN latest ON key = CAST(c_custkey AS VARCHAR)""")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").cast("binary").alias("key"), "c_custkey")
    return ops.multi_get(events(spark, sf_dir), probes).select("c_custkey", F.col("status").cast("int").alias("status"), text("value"))


@query(f"{LATEST} SELECT key, seq, value FROM latest WHERE op = 1 AND key >= '10' AND key < '3'")
def kv_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.key_range(events(spark, sf_dir), b"10", b"3").select(text("key"), "seq", text("value"))


@query(f"{LOG} SELECT key, seq, value FROM (SELECT * FROM log WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def kv_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.as_of(events(spark, sf_dir), 500).select(text("key"), "seq", text("value"))


@query(f"{LOG} SELECT key, seq, op, row_number() OVER w AS version, lead(seq) OVER w AS until, lead(seq) OVER w IS NULL AS newest FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)")
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.history(events(spark, sf_dir)).select(text("key"), "seq", F.col("op").cast("int").alias("op"), F.col("version").cast("long").alias("version"), "until", "newest")


@query(f"{LOG} SELECT key, seq, op, row_number() OVER (ORDER BY key, seq DESC) - 1 AS place FROM log")
def kv_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs in one order; places by partition counts."""
    log = events(spark, sf_dir)
    runs = [log.filter(F.col("seq") % 4 == k) for k in range(4)]
    merged = ops.merge(*runs).withColumn("down", -F.col("seq")).withColumnRenamed("seq", "was")
    return ops.assign_seq(merged, ["key", "down"]).select(text("key"), F.col("was").alias("seq"), F.col("op").cast("int").alias("op"), F.col("seq").alias("place"))


@query(f"{LATEST} SELECT key, seq, op, value FROM latest")
def kv_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers' cascade, newest tier first."""
    log = events(spark, sf_dir)
    tiers = [log.filter("seq > 800"), log.filter("seq > 300 and seq <= 800"), log.filter("seq <= 300")]
    return ops.overlay(tiers).select(text("key"), "seq", F.col("op").cast("int").alias("op"), text("value"))


@query(f"{LATEST} SELECT key, seq, value FROM latest WHERE op = 1")
def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction's relational part: merge, newest version, deletions dropped, ranges sorted by key."""
    log = events(spark, sf_dir)
    live = ops.latest(ops.append(*(log.filter(F.col("seq") % 4 == k) for k in range(4)))).filter("op = 1")
    return live.repartitionByRange("key").sortWithinPartitions("key").select(text("key"), "seq", text("value"))


@query(f"""{LATEST}, per AS (SELECT count(*) AS n, max(seq) AS m, sum(17 + strlen(key) + strlen(value)) AS lb, sum(16 + strlen(key) + strlen(value)) AS tb FROM log)
SELECT count(*) AS keys, count(*) FILTER (op = 1) AS live, count(*) FILTER (op = 0) AS deleted, any_value(n) - count(*) AS shadowed, any_value(m) AS max_seq,
CAST(any_value(lb) AS BIGINT) AS log_bytes, CAST(any_value(tb) AS BIGINT) AS table_bytes FROM latest, per""")
def kv_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.statistics(events(spark, sf_dir))


@query("SELECT max(event_id) + 1 AS next_seq FROM events")
def kv_next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.next_seq(events(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 AS seq FROM lineitem")
def kv_assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return ops.assign_seq(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"], 1000).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "seq")


@query("""WITH log AS (SELECT o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) SELECT key, seq, status FROM log WHERE status <> 'F'""")
def kv_orders_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another feed: a customer's newest order; a finished one deletes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    log = ops.as_log(orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("op"), F.col("o_orderstatus").alias("value")))
    return ops.snapshot(log).select(F.col("key").cast("string").cast("long").alias("key"), "seq", F.col("value").cast("string").alias("status"))


@query(f"{LOG} SELECT key, seq, op FROM log")
def kv_replay_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that stand in a run and in the replayed log count once."""
    log = events(spark, sf_dir)
    return ops.dedupe_replay(ops.append(log, log.filter("seq > 500"))).select(text("key"), "seq", F.col("op").cast("int").alias("op"))


# folds

_SIZED = LOG + ", sized AS (SELECT *, 16 + strlen(key) + strlen(value) AS size FROM log)"


@query(f"""WITH RECURSIVE {_SIZED[5:]}, s AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
starts(i, before, run) AS (SELECT i, before, 0 FROM s WHERE i = 1 UNION ALL
SELECT n.i, n.before, n.run FROM (SELECT s.i, s.before, starts.run + 1 AS run, row_number() OVER (ORDER BY s.i) AS r FROM starts, s WHERE s.before - starts.before >= 4096) n WHERE r = 1)
SELECT run, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT s.*, starts.run FROM s ASOF JOIN starts ON s.i >= starts.i) GROUP BY run""")
def kv_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumn("shard", F.lit(0))
    size = codec.table_size(F.col("key"), F.col("value"))
    return pages.rotate(log, "shard").groupBy("run").agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(size).alias("bytes"))


def _pages_sql(source: str, free: str) -> str:
    return f"""WITH RECURSIVE {source}, s AS (SELECT *, row_number() OVER w AS i, coalesce(sum(size) OVER (ORDER BY key, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, coalesce(lag(key) OVER w <> key, true) AS fresh FROM sized WINDOW w AS (ORDER BY key, seq DESC)),
starts(i, off) AS (SELECT i, off FROM s WHERE i = 1 UNION ALL
SELECT n.i, n.off FROM (SELECT s.i, s.off, row_number() OVER (ORDER BY s.i) AS r FROM starts, s WHERE s.off - starts.off >= 4096 AND {free}) n WHERE r = 1)
SELECT s.key, CAST(s.off AS BIGINT) AS page_offset FROM s JOIN starts USING (i)"""


@query(_pages_sql(_SIZED[5:], "s.fresh"))
def kv_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one flushed run of all versions."""
    paged = pages.pages(events(spark, sf_dir).withColumn("run", F.lit(1)), "run")
    return pages.sparse_index(paged).select(text("key"), F.col("offset").alias("page_offset"))


_LIVE = LATEST + ", sized AS (SELECT key, seq, 16 + strlen(key) + strlen(value) AS size FROM latest WHERE op = 1)"


@query(_pages_sql(_LIVE[5:], "true"))
def kv_sparse_index_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ops.snapshot(events(spark, sf_dir)).withColumn("run", F.lit(1))
    return pages.sparse_index(pages.pages(live, "run", unique=True)).select(text("key"), F.col("offset").alias("page_offset"))


@query(f"""{LATEST}, page(first_key, off) AS (SELECT key, row_number() OVER (ORDER BY key) - 1 FROM latest), picked AS (SELECT * FROM page WHERE off % 5 = 0)
SELECT c_custkey, off AS page_offset FROM customer ASOF LEFT JOIN picked ON CAST(c_custkey AS VARCHAR) >= first_key""")
def kv_seek_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each probe key the last page that begins at or before it (here a page is five keys)."""
    keys = ops.assign_seq(ops.latest(events(spark, sf_dir)).select("key"), ["key"]).withColumnRenamed("seq", "offset")
    index = keys.filter("offset % 5 = 0").select(F.lit(1).alias("run"), "key", "offset")
    return pages.seek_pages(index, _probes(spark, sf_dir)).select(F.col("key").cast("string").cast("long").alias("c_custkey"), F.col("offset").alias("page_offset"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(1).alias("run"), F.col("c_custkey").cast("string").cast("binary").alias("key"))


@query(f"""{_pages_sql(_SIZED[5:], "s.fresh").rpartition("SELECT s.key")[0]}, page(first_key, off) AS (SELECT s.key, CAST(s.off AS BIGINT) FROM s JOIN starts USING (i))
SELECT c_custkey, off AS page_offset FROM customer ASOF LEFT JOIN page ON CAST(c_custkey AS VARCHAR) >= first_key""")
def kv_page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the sparse index of a flushed run."""
    index = pages.sparse_index(pages.pages(events(spark, sf_dir).withColumn("run", F.lit(1)), "run"))
    return pages.seek_pages(index, _probes(spark, sf_dir)).select(F.col("key").cast("string").cast("long").alias("c_custkey"), F.col("offset").alias("page_offset"))


@query(f"""{LATEST}, numbered AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM latest), file AS (SELECT key AS first_key, n // 7 + 1 AS sst_id FROM numbered WHERE n % 7 = 0)
SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key, sst_id FROM customer ASOF LEFT JOIN file ON CAST(c_custkey AS VARCHAR) >= first_key""")
def kv_l1_file_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each probe key the level-1 file that may hold it; a file has seven keys here."""
    keys = ops.assign_seq(ops.latest(events(spark, sf_dir)).select("key"), ["key"])
    files = keys.filter("seq % 7 = 0").select((F.floor(F.col("seq") / 7) + 1).alias("sst_id"), F.col("key").alias("first_key"))
    return pages.seek_files(files, _probes(spark, sf_dir).select("key")).select(text("key"), "sst_id")


@query("""WITH RECURSIVE sized AS (SELECT o_orderkey, printf('%012d', o_orderkey) AS key, 16 + 12 + strlen(o_orderpriority) AS size FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT *, row_number() OVER (ORDER BY key) AS i, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sized),
starts(i, off) AS (SELECT i, off FROM s WHERE i = 1 UNION ALL SELECT n.i, n.off FROM (SELECT s.i, s.off, row_number() OVER (ORDER BY s.i) AS r FROM starts, s WHERE s.off - starts.off >= 4096) n WHERE r = 1)
SELECT s.key, CAST(s.off AS BIGINT) AS page_offset FROM s JOIN starts USING (i)""")
def kv_sparse_index_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a compacted run of many pages: orders by key, a finished one deleted."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    log = ops.as_log(orders.select(F.format_string("%012d", "o_orderkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("op"), F.col("o_orderpriority").alias("value")))
    paged = pages.pages(ops.snapshot(log).withColumn("run", F.lit(1)), "run", unique=True)
    return pages.sparse_index(paged).select(text("key"), F.col("offset").alias("page_offset"))


_OFFSETS = "CAST(sum({0}) OVER (ORDER BY {1}) - ({0}) AS BIGINT) AS start_off, CAST(sum({0}) OVER (ORDER BY {1}) AS BIGINT) AS end_off"


def _wal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return pages.offsets(log, codec.log_size(F.col("key"), F.col("value")), ["seq"], ["seq"])


@query(f"{LOG} SELECT seq, {_OFFSETS.format('17 + strlen(key) + strlen(value)', 'seq')} FROM log")
def kv_wal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record of the log file begins and ends."""
    return _wal_offsets(spark, sf_dir).select("seq", F.col("begin").alias("start_off"), F.col("end").alias("end_off"))


@query(f"{LOG}, cut AS (SELECT *, {_OFFSETS.format('17 + strlen(key) + strlen(value)', 'seq')} FROM log) SELECT key, seq, op, value FROM cut WHERE end_off <= 100000")
def kv_wal_replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay finds in a log file that was cut after 100,000 bytes: whole records only."""
    return _wal_offsets(spark, sf_dir).filter("`end` <= 100000").select(text("key"), "seq", F.col("op").cast("int").alias("op"), text("value"))


@query(f"{LOG} SELECT key, seq, {_OFFSETS.format('16 + strlen(key) + strlen(value)', 'key, seq DESC')} FROM log")
def kv_sst_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record of a flushed run begins and ends."""
    log = events(spark, sf_dir)
    placed = pages.offsets(log, codec.table_size(F.col("key"), F.col("value")), ["key"], ["key", F.desc("seq")])
    return placed.select(text("key"), "seq", F.col("begin").alias("start_off"), F.col("end").alias("end_off"))


@query(f"{LATEST} SELECT min(key) AS key, 2 AS status, '' AS value FROM latest WHERE op = 0")
def kv_point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least deleted key: its status tells it from one that never was, its value doesn't."""
    log = events(spark, sf_dir)
    probe = ops.deleted(log).agg(F.min("key").alias("key"))
    return ops.multi_get(log, probe).select(text("key"), F.col("status").cast("int").alias("status"), text("value"))


# codec

_LE = lambda x, n: " || ".join(f"substr(printf('%016X', CAST({x} AS BIGINT)), {15 - 2 * i}, 2)" for i in range(n))


@query(f"{LOG} SELECT seq, {_LE('op', 1)} || {_LE('seq', 8)} || {_LE('strlen(key)', 4)} || hex(encode(key)) || {_LE('strlen(value)', 4)} || hex(encode(value)) AS record FROM log")
def kv_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", F.hex(codec.log_record(F.col("op"), F.col("seq"), F.col("key"), F.col("value"))).alias("record"))


@query(f"{LOG} SELECT seq, {_LE('8 + strlen(key)', 4)} || hex(encode(key)) || {_LE('seq * 256 + op', 8)} || {_LE('strlen(value)', 4)} || hex(encode(value)) AS record FROM log")
def kv_table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", F.hex(codec.table_record(F.col("key"), F.col("seq"), F.col("op"), F.col("value"))).alias("record"))


@query(f"{LOG} SELECT key, seq, op, value FROM log")
def kv_table_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(codec.decode_table_record(codec.table_record(F.col("key"), F.col("seq"), F.col("op"), F.col("value"))).alias("r")).select("r.*")
    return rows.select(text("key"), "seq", F.col("op").cast("int").alias("op"), text("value"))


@query(f"{LOG} SELECT seq, seq * 256 + op AS packed FROM log")
def kv_pack_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", codec.pack_key(F.col("seq"), F.col("op")).alias("packed"))


@query("SELECT DISTINCT c_custkey * 997 AS sst_id, printf('%06d.sst', c_custkey * 997) AS name FROM customer")
def kv_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") * 997).alias("sst_id")).distinct()
    return ids.select("sst_id", codec.table_file_name(F.col("sst_id")).alias("name"))


@query(f"{LOG} SELECT seq, '4B' || CASE WHEN op = 1 THEN '01' ELSE '03' END || {_LE('strlen(key)', 4)} || {_LE('strlen(value)', 4)} || hex(encode(key)) || hex(encode(value)) AS frame, key, true AS valid FROM log")
def kv_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests framed for the wire, and read back."""
    code = F.when(F.col("op") == 1, codec.WIRE_PUT).otherwise(codec.WIRE_DELETE)
    framed = events(spark, sf_dir).select("seq", codec.wire_request(code, F.col("key"), F.col("value")).alias("frame"))
    back = framed.withColumn("r", codec.decode_wire(F.col("frame")))
    return back.select("seq", F.hex("frame").alias("frame"), F.col("r.key").cast("string").alias("key"), F.col("r.valid").alias("valid"))


# Bloom filters

_BYTES = "list_transform(range(1, strlen(key) + 1), lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT))"
_HASH = lambda seed: f"list_reduce(list_prepend(CAST({seed} AS BIGINT), {_BYTES}), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_KEYS = f"{LOG}, keys AS (SELECT DISTINCT key FROM log)"


@query(f"{_KEYS} SELECT key, {_HASH(bloom.SEEDS[0])} AS h1, {_HASH(bloom.SEEDS[1])} AS h2, {_HASH(bloom.SEEDS[2])} AS h3 FROM keys")
def kv_bloom_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events(spark, sf_dir).select("key").distinct()
    return keys.select(text("key"), *(bloom.bloom_hash(F.col("key"), s).alias(f"h{i + 1}") for i, s in enumerate(bloom.SEEDS)))


_BITS = f"""{_KEYS}, n AS (SELECT (greatest(count(*) * 10, 64) + 7) // 8 * 8 AS n_bits FROM keys),
bits AS (SELECT DISTINCT unnest([{", ".join(_HASH(s) for s in bloom.SEEDS)}]) % n_bits AS bit FROM keys, n),
by_byte AS (SELECT bit // 8 AS at, CAST(sum(1 << (bit % 8)) AS BIGINT) AS byte FROM bits GROUP BY 1)"""


@query(f"{_BITS} SELECT CAST(n_bits AS BIGINT) AS n_bits, string_agg(printf('%02X', coalesce(byte, 0)), '' ORDER BY g.at) AS filter FROM n, (SELECT unnest(range(0, n_bits // 8)) AS at FROM n) g LEFT JOIN by_byte ON by_byte.at = g.at GROUP BY n_bits")
def kv_bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = bloom.build(events(spark, sf_dir).select("key"), [])
    return built.select("n_bits", F.hex("filter").alias("filter"))


_PROBE = "(SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer)"


@query(f"""{_BITS} SELECT p.key, (SELECT count(*) FROM bits WHERE bit IN ({", ".join(f"p.h{i} % (SELECT n_bits FROM n)" for i in range(3))})) = len(list_distinct([{", ".join(f"p.h{i} % (SELECT n_bits FROM n)" for i in range(3))}])) AS may
FROM (SELECT key, {", ".join(f"{_HASH(s)} AS h{i}" for i, s in enumerate(bloom.SEEDS))} FROM {_PROBE}) p""")
def kv_bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").cast("binary").alias("key"))
    return bloom.probe(probes, events(spark, sf_dir).select("key"), []).select(text("key"), "may")


# workloads

_OPS = """ops AS (SELECT i, action, key, CASE WHEN action = 'put' THEN repeat(chr(CAST(97 + i % 26 AS INT)), 64) ELSE '' END AS value FROM (SELECT i, CASE WHEN (i * 7919 + 42) % 100 + 1 <= 50 THEN 'get' WHEN (i * 7919 + 42) % 100 + 1 <= 70 THEN 'erase' ELSE 'put' END AS action,
'bench_key_' || CAST((i * 104729 + 1302) % 1000 AS VARCHAR) AS key FROM range(8000) t(i)))"""
_EXPECTED = f"""{_OPS}, expected AS (SELECT i, action, key, coalesce(last_value(CASE WHEN action = 'put' THEN value WHEN action = 'erase' THEN '' END IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS expected FROM ops)"""


@query(f"WITH {_OPS} SELECT i, action, key, value FROM ops")
def kv_bench_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.operations(spark, "mixed_with_delete")


@query(f"WITH {_EXPECTED} SELECT i, key, expected FROM expected WHERE action = 'get'")
def kv_bench_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.expected(workload.operations(spark, "mixed_with_delete"))


@query(f"WITH {_EXPECTED} SELECT count(*) AS reads, count(*) FILTER (expected <> '') AS hits, count(*) FILTER (expected = '') AS misses FROM expected WHERE action = 'get'")
def kv_bench_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.hits(workload.expected(workload.operations(spark, "mixed_with_delete")))


@query("""WITH v AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT p, v AS value FROM v, (VALUES (50), (95), (99)) t(p) WHERE r = floor(p / 100 * (n - 1))""")
def kv_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", [50, 95, 99])


@query("SELECT 200 AS keys, 100 AS live, 100 AS deleted, 100 AS shadowed, 299 AS max_seq")
def kv_correctness_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.statistics(workload.correctness_cycle(spark)).select("keys", "live", "deleted", "shadowed", "max_seq")


# storage, end to end


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


@query(f"{LATEST} SELECT key, value FROM latest WHERE op = 1")
def kv_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a table: five writes with a flush each (which compacts), one more left in the log, reopened."""
    from ..store import Table

    path, log = scratch(spark), events(spark, sf_dir)
    with Table.open(spark, path) as table:
        for k in range(5):
            table.write(log.filter(F.floor(F.col("seq") / 200) == k).select("key", "op", "value", F.col("seq").alias("place")), ["place"])
            table.flush()
    table = Table.open(spark, path)
    table.write(log.filter("seq >= 1000").select("key", "op", "value", F.col("seq").alias("place")), ["place"])
    return Table.open(spark, path).snapshot().select(text("key"), text("value"))


@query(f"""{LOG}, old AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op FROM log WHERE seq % 5 < 4 GROUP BY key),
run AS (SELECT 1 AS level, key FROM old WHERE op = 1 UNION ALL SELECT 0, key FROM log WHERE seq % 5 = 4)
SELECT level, 0 AS ord, count(*) AS n_rows, min(key) AS first_key, max(key) AS last_key FROM run GROUP BY level""")
def kv_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as a relation, after five flushes: four runs compacted into one of level 1, and one run of level 0."""
    from ..store import Table

    path, log = scratch(spark), events(spark, sf_dir)
    with Table.open(spark, path) as table:
        for k in range(5):
            table.load(log.filter(F.col("seq") % 5 == k))
    found = Table.open(spark, path, read_only=True).runs()
    return found.select("level", F.col("ord"), "n_rows", text("first_key"), text("last_key"))


@query(f"{LATEST} SELECT key, value FROM latest WHERE op = 1")
def kv_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through Structured Streaming: micro-batches become runs, runs are compacted."""
    from ..store import Table
    from ..streaming.ingest import ingest

    path = scratch(spark)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):  # three files, one a micro-batch
        source.filter(F.least(F.floor(F.col("event_id") / 300), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{path}-in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-in")
    erased = F.col("event_type") == "error"
    rows = stream.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.when(erased, 0).otherwise(1).cast("tinyint").alias("op"), F.when(erased, "").otherwise(F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))).cast("binary").alias("value"), F.col("event_id").alias("place"))
    table = Table.open(spark, path)
    ingest(rows, table, f"{path}-checkpoint", ["place"]).trigger(availableNow=True).start().awaitTermination()
    return table.snapshot().select(text("key"), text("value"))


@query(f"{LOG} SELECT key, seq, op, value FROM log")
def kv_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To log files and back, through the data source."""
    from ..sources import binary

    return _files(spark, sf_dir, "kvwal", binary.read_log)


@query(f"{LOG} SELECT key, seq, op, value FROM log")
def kv_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To sorted-table files and back."""
    from ..sources import binary

    return _files(spark, sf_dir, "kvsst", binary.read_table)


def _files(spark: SparkSession, sf_dir: str, kind: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    from ..sources import binary

    binary.register(spark)
    path = scratch(spark)
    local = path.removeprefix("file://")
    events(spark, sf_dir).repartitionByRange(3, "key").sortWithinPartitions("key", F.desc("seq")).write.format(kind).option("path", local).mode("append").save()
    return read(spark, path).select(text("key"), "seq", F.col("op").cast("int").alias("op"), text("value"))
