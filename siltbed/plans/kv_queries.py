"""Queries for the key-value operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import keys, record, resp, status, wal
from siltbed.operators import cache, cursor, layout, log, manifest, merge
from siltbed.operators import wal as wal_ops
from siltbed.plans.core_problems import TRUE_KEY_HEX
from siltbed.session import cut, join_small, scratch
from siltbed.sources.storage import tables
from siltbed.streaming.upsert import UpsertSink
from siltbed.table import KvTable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a log of puts: key user, order (ts, event_id)."""
    e = tables(spark, sf)("events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("value"), "props", "event_type", "ts", "event_id")


_LOG = "SELECT CAST(user_id AS VARCHAR) AS key, value, props, event_type, ts, event_id FROM events"


def _order_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = tables(spark, sf)("orders")
    return o.select(F.col("o_orderkey").cast("string").alias("key"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


# B, E: state and lookups


@query(f"SELECT key, value, event_type, ts, event_id FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1")
def kv_latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return log.latest(_log(spark, sf), "key", ["ts", "event_id"]).drop("props")


@query(f"SELECT key, value, event_type, ts, event_id FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1")
def kv_first_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return log.first_write_wins(_log(spark, sf), "key", ["ts", "event_id"]).drop("props")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 1234")
def kv_point_get(spark: SparkSession, sf: str) -> DataFrame:
    return log.get(tables(spark, sf)("orders"), "o_orderkey", 1234).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT rec_id, db_name, value_ FROM slices WHERE file_id_ = 17 AND block_id_ = 0 AND offset_ >= 0 AND offset_ <= 4096")
def kv_get_by_location(spark: SparkSession, sf: str) -> DataFrame:
    s = tables(spark, sf)("slices")
    return log.get_by_location(s, F.col("file_id_"), F.col("block_id_"), F.col("offset_"), (17, 0, 0), 4096).select("rec_id", "db_name", "value_")


@query("SELECT rec_id, offset_ // 65536 AS block_no, offset_ % 65536 AS in_block FROM slices WHERE offset_ IS NOT NULL")
def kv_block_addr(spark: SparkSession, sf: str) -> DataFrame:
    s = tables(spark, sf)("slices").where(F.col("offset_").isNotNull())
    return s.select("rec_id", record.block_of(F.col("offset_")).alias("block_no"), record.offset_in_block(F.col("offset_")).alias("in_block"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem)")
def kv_multi_get(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return log.multi_get(t("orders"), "o_orderkey", t("lineitem"), "l_partkey").select("o_orderkey", "o_totalprice")


_PROBES = "SELECT DISTINCT l_suppkey * 37 AS probe FROM lineitem"


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("lineitem").select((F.col("l_suppkey") * 37).alias("probe")).distinct()


@query(f"SELECT probe, o_orderkey IS NOT NULL AS found, o_totalprice FROM ({_PROBES}) LEFT JOIN orders ON o_orderkey = probe")
def kv_get_miss(spark: SparkSession, sf: str) -> DataFrame:
    return log.probe(tables(spark, sf)("orders"), "o_orderkey", _probes(spark, sf), "probe", ["o_totalprice"])


@query(f"SELECT probe FROM ({_PROBES}) WHERE probe IN (SELECT o_orderkey FROM orders)")
def kv_exists(spark: SparkSession, sf: str) -> DataFrame:
    return log.exists(_probes(spark, sf), "probe", tables(spark, sf)("orders"), "o_orderkey")


@query(f"SELECT key, value, event_type FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def kv_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf).withColumn("deleted", F.col("event_type") == "error")
    return log.latest(rows, "key", ["ts", "event_id"], "deleted").select("key", "value", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderkey >= 1000 AND o_orderkey < 2000)")
def kv_delete_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = _order_keys(spark, sf)
    return log.delete_range(rows, F.col("key"), F.lit("1000"), F.lit("2000")).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS keys FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def kv_size(spark: SparkSession, sf: str) -> DataFrame:
    return log.latest(_log(spark, sf), "key", ["ts", "event_id"]).agg(F.count(F.lit(1)).alias("keys"))


@query("SELECT abs(hash_0_ % 8)::INTEGER AS shard, count(*) AS records, count(DISTINCT hash_0_) AS keys FROM key_history GROUP BY 1")
def kv_shard_totals(spark: SparkSession, sf: str) -> DataFrame:
    h = tables(spark, sf)("key_history")
    return h.groupBy(keys.shard8(F.col("hash_0_")).alias("shard")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("hash_0_").alias("keys"))


# C: ordered iteration


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY strlen(CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR)) AS rank FROM customer")
def kv_scan_ordered(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)("customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("key"))
    return cursor.scan(c, "key").select("c_custkey", "c_name", "rank")


_PART_KEY = "p_name || ' ' || p_type"


def _part_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("part").select(F.concat_ws(" ", "p_name", "p_type").alias("key"), "p_partkey").groupBy("key").agg(F.min("p_partkey").alias("p_partkey"))


@query(f"SELECT {_PART_KEY} AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 ORDER BY strlen(key), key LIMIT 1")
def kv_first(spark: SparkSession, sf: str) -> DataFrame:
    return cursor.first(_part_keys(spark, sf), "key")


@query(f"SELECT {_PART_KEY} AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 ORDER BY strlen(key) DESC, key DESC LIMIT 1")
def kv_last(spark: SparkSession, sf: str) -> DataFrame:
    return cursor.last(_part_keys(spark, sf), "key")


_AT_LEAST = "(strlen(key) > strlen({t}) OR (strlen(key) = strlen({t}) AND key >= {t}))"
_ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey, o_custkey FROM orders"


@query(f"SELECT key, o_custkey FROM ({_ORDERS}) WHERE {_AT_LEAST.format(t=chr(39) + '1234a' + chr(39))} ORDER BY strlen(key), key LIMIT 5")
def kv_seek(spark: SparkSession, sf: str) -> DataFrame:
    return cursor.seek(_order_keys(spark, sf), "key", F.lit("1234a"), 5).select("key", "o_custkey")


@query(f"SELECT key, o_custkey FROM ({_ORDERS}) WHERE NOT {_AT_LEAST.format(t=chr(39) + '1234' + chr(39))} ORDER BY strlen(key) DESC, key DESC LIMIT 3")
def kv_seek_for_prev(spark: SparkSession, sf: str) -> DataFrame:
    return cursor.seek_for_prev(_order_keys(spark, sf), "key", F.lit("1234"), 3).select("key", "o_custkey")


@query(f"SELECT key, o_custkey FROM ({_ORDERS}) WHERE {_AT_LEAST.format(t=chr(39) + '99' + chr(39))} AND NOT {_AT_LEAST.format(t=chr(39) + '1500' + chr(39))}")
def kv_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return cursor.range_scan(_order_keys(spark, sf), "key", F.lit("99"), F.lit("1500")).select("key", "o_custkey")


@query(
    """SELECT key, p_partkey, lag(key) OVER w AS prev_key, lead(key) OVER w AS next_key
FROM (SELECT p_name || ' ' || p_type AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1) WINDOW w AS (ORDER BY strlen(key), key)"""
)
def kv_next_prev(spark: SparkSession, sf: str) -> DataFrame:
    return cursor.neighbours(_part_keys(spark, sf), "key")


@query(
    """SELECT a.n_name AS a, b.n_name AS b,
CASE WHEN strlen(a.n_name) < strlen(b.n_name) OR (strlen(a.n_name) = strlen(b.n_name) AND a.n_name < b.n_name) THEN -1 WHEN a.n_name = b.n_name THEN 0 ELSE 1 END AS cmp
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"""
)
def kv_compare3(spark: SparkSession, sf: str) -> DataFrame:
    n = tables(spark, sf)("nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", keys.compare3(F.col("a"), F.col("b")).alias("cmp"))


@query(f"SELECT event_id // 500 AS block_id, key, value, event_id FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY event_id // 500, key ORDER BY event_id DESC) = 1")
def kv_block_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf).select(F.struct(F.floor(F.col("event_id") / 500).alias("block_id"), "key").alias("at"), "value", "event_id")
    return log.latest(rows, "at", ["event_id"]).select("at.block_id", "at.key", "value", "event_id")


# D: merge and compaction


def _runs(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Three overlapping runs of order keys: all, those no longer open, those finished; the later ones with newer versions."""
    o = _order_keys(spark, sf)
    picked = [o, o.where(F.col("o_orderstatus") != "O"), o.where(F.col("o_orderstatus") == "F")]
    return [r.select("key", (F.col("o_totalprice") + i).alias("value"), F.lit(i).cast("bigint").alias("version"), "o_orderpriority") for i, r in enumerate(picked)]


_RUNS = " UNION ALL ".join(
    f"SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice + {i} AS value, CAST({i} AS BIGINT) AS version, {i} AS run_no, o_orderpriority FROM orders{where}" for i, where in enumerate(("", " WHERE o_orderstatus <> 'O'", " WHERE o_orderstatus = 'F'"))
)


@query(f"SELECT key, run_no, value, row_number() OVER (ORDER BY strlen(key), key, run_no) AS rank FROM ({_RUNS})")
def kv_merge_runs(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_runs(_runs(spark, sf), "key").select("key", "run_no", "value", "rank")


@query(f"SELECT key, run_no, value FROM ({_RUNS}) ORDER BY strlen(key) DESC, key DESC, run_no LIMIT 1")
def kv_merge_last(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_last(_runs(spark, sf), "key").select("key", "run_no", "value")


@query(f"SELECT key, value, version FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1")
def kv_compact(spark: SparkSession, sf: str) -> DataFrame:
    return merge.compact(_runs(spark, sf), "key", ["version"]).select("key", "value", "version")


@query(f"SELECT key, strlen(key)::INTEGER AS key_bytes, value, event_id FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1")
def kv_flush(spark: SparkSession, sf: str) -> DataFrame:
    rows = log.latest(_log(spark, sf), "key", ["ts", "event_id"]).select("key", "value", "event_id")
    return merge.write_run(rows, "key", scratch(spark, "kv-flush"))


@query(f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM ({_RUNS})) WHERE r = 1 AND o_orderpriority <> '5-LOW'")
def kv_table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Puts in three calls, a flush, deletes and a full compaction of a stored table; its live rows."""
    table = KvTable(spark, scratch(spark, "kv-table"))
    runs = _runs(spark, sf)
    for rows in runs:
        table.put(rows.select("key", F.col("value").cast("string").alias("value"), "version"))
    table.flush()
    table.delete(runs[0].where(F.col("o_orderpriority") == "5-LOW").select("key", F.lit(9).alias("version")))
    table.compact()
    return table.rows().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


# A, E, F: layout


_BLOCKS = "SELECT CAST(o_orderkey AS VARCHAR) AS key, row_number() OVER (ORDER BY strlen(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR)) AS pos FROM orders"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys in key order, 100 to a block and 10 blocks to a file."""
    at = cursor.scan(_order_keys(spark, sf).select("key"), "key")
    return layout.fixed_blocks(at, F.col("rank"), 100, 10)


@query(f"SELECT file_id, arg_min(key, pos) AS min_key, arg_max(key, pos) AS max_key, count(*) AS records FROM (SELECT *, (pos - 1) // 1000 AS file_id FROM ({_BLOCKS})) GROUP BY 1")
def kv_file_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return layout.key_ranges(_blocks(spark, sf), ["file_id"], "key")


@query(f"SELECT block_id, arg_min(key, pos) AS min_key FROM (SELECT *, (pos - 1) // 100 AS block_id FROM ({_BLOCKS})) GROUP BY 1")
def kv_block_min_keys(spark: SparkSession, sf: str) -> DataFrame:
    return layout.key_ranges(_blocks(spark, sf), ["block_id"], "key").select("block_id", "min_key")


@query(f"SELECT (pos - 1) // 100 AS block_id, ((pos - 1) % 100) // 16 AS restart_no, key FROM ({_BLOCKS}) WHERE ((pos - 1) % 100) % 16 = 0")
def kv_restart_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = _blocks(spark, sf).withColumn("in_block", (F.col("rank") - 1) % 100)
    return layout.restart_points(rows, F.col("in_block")).select("block_id", "restart_no", "key")


@query(
    f"""WITH f AS (SELECT file_id, arg_min(key, pos) AS lo, arg_max(key, pos) AS hi FROM (SELECT *, (pos - 1) // 1000 AS file_id FROM ({_BLOCKS})) GROUP BY 1),
p AS (SELECT DISTINCT CAST(l_suppkey * 37 AS VARCHAR) AS probe FROM lineitem)
SELECT probe, file_id FROM p LEFT JOIN f ON (strlen(probe) > strlen(lo) OR (strlen(probe) = strlen(lo) AND probe >= lo)) AND (strlen(probe) < strlen(hi) OR (strlen(probe) = strlen(hi) AND probe <= hi))"""
)
def kv_locate_file(spark: SparkSession, sf: str) -> DataFrame:
    ranges = layout.key_ranges(_blocks(spark, sf), ["file_id"], "key")
    probes = _probes(spark, sf).select(F.col("probe").cast("string").alias("probe"))
    return cursor.locate(probes, "probe", ranges, "min_key", "max_key", "file_id")


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    f = manifest.live_files(tables(spark, sf)("file_infos"), more=["min_key_", "max_key_"])
    return f.select("file_id", "db_name", F.col("min_key_").alias("min_key"), F.col("max_key_").alias("max_key"), F.col("file_level").cast("int").alias("level"))


_FILES = """SELECT file_id, db_name, min_key_ AS min_key, max_key_ AS max_key, CAST(file_level AS INTEGER) AS level FROM
(SELECT * FROM file_infos QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY manifest_no DESC) = 1) WHERE file_status = 0"""


@query(
    f"""WITH f AS ({_FILES}), k AS (SELECT * FROM f WHERE min_key IS NOT NULL AND max_key IS NOT NULL),
lo AS (SELECT min_key AS lo FROM k WHERE level = 1 ORDER BY octet_length(min_key), min_key LIMIT 1),
hi AS (SELECT max_key AS hi FROM k WHERE level = 1 ORDER BY octet_length(max_key) DESC, max_key DESC LIMIT 1)
SELECT file_id, level FROM k, lo, hi WHERE level = 1 OR (level = 2 AND (octet_length(max_key) > octet_length(lo) OR (octet_length(max_key) = octet_length(lo) AND max_key >= lo))
 AND (octet_length(hi) > octet_length(min_key) OR (octet_length(hi) = octet_length(min_key) AND hi >= min_key)))"""
)
def kv_compaction_pick(spark: SparkSession, sf: str) -> DataFrame:
    return merge.pick_overlapping(_catalogue(spark, sf), 1, 2).select("file_id", "level")


@query(f"SELECT count(*) AS files, count(*) > 8 AS needed FROM ({_FILES}) WHERE level = 0")
def kv_needs_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return merge.needs_compaction(_catalogue(spark, sf))


@query(
    f"""WITH f AS (SELECT file_id, arg_min(key, pos) AS low, arg_max(key, pos) AS high FROM (SELECT *, (pos - 1) // 1000 AS file_id FROM ({_BLOCKS})) GROUP BY 1)
SELECT file_id, low, high, coalesce(lag(high) OVER w = low, row_number() OVER w = 1) AS contiguous FROM f WINDOW w AS (ORDER BY strlen(low), low)"""
)
def kv_range_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    r = layout.key_ranges(_blocks(spark, sf), ["file_id"], "key").select("file_id", F.col("min_key").alias("low"), F.col("max_key").alias("high"))
    return layout.contiguous(r, "low", "high")


@query(f"SELECT key, n AS records FROM (SELECT {_PART_KEY} AS key, row_number() OVER (ORDER BY strlen({_PART_KEY}), {_PART_KEY}) AS r, count(*) OVER () AS n FROM part) WHERE r = n // 2 + 1")
def kv_median_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf)("part").select(F.concat_ws(" ", "p_name", "p_type").alias("key"))
    return layout.median_split(rows, "key")


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The stored hashes of all rows of the key history; NULL where a writer left it out."""
    return tables(spark, sf)("key_history").select("hist_id", F.col("hash_0_").alias("h"))


@query("SELECT abs(hash_0_ % 8)::INTEGER AS shard, count(*) AS records FROM key_history GROUP BY 1")
def kv_shard8(spark: SparkSession, sf: str) -> DataFrame:
    return _hashes(spark, sf).groupBy(keys.shard8(F.col("h")).alias("shard")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT CAST((hash_0_ >> 52) & 4095 AS INTEGER) AS bucket, count(*) AS records FROM key_history GROUP BY 1")
def kv_ring_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return _hashes(spark, sf).groupBy(keys.ring_bucket(F.col("h")).alias("bucket")).agg(F.count(F.lit(1)).alias("records"))


_SPLIT_LIMIT = 4
_SPLIT = f"""WITH h AS (SELECT DISTINCT hash_0_ AS h, CAST((hash_0_ >> 52) & 4095 AS INTEGER) AS bucket FROM key_history WHERE hash_0_ IS NOT NULL),
n AS (SELECT bucket, CAST(level AS INTEGER) AS level, (h >> (52 - level)) & ((CAST(1 AS BIGINT) << level) - 1) AS part, count(*) AS n FROM h, (SELECT unnest(range(0, 53)) AS level) GROUP BY ALL),
l AS (SELECT bucket, level, max(n) AS largest, CAST(sum(n) AS BIGINT) AS records FROM n GROUP BY ALL),
s AS (SELECT * FROM l WHERE largest < {_SPLIT_LIMIT} OR level = 52 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY level) = 1)"""


@query(_SPLIT + " SELECT bucket, level, records, largest FROM s")
def kv_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """How often each ring bucket of different hashes is halved, with few entries to a part so that some must be."""
    return layout.hash_split(_hashes(spark, sf).where("h IS NOT NULL").select("h").distinct(), "h", limit=_SPLIT_LIMIT)


@query(_SPLIT + " SELECT h.h, s.bucket, s.level, CAST((h.h >> (52 - s.level)) & ((CAST(1 AS BIGINT) << s.level) - 1) AS BIGINT) AS part FROM h JOIN s ON s.bucket = h.bucket")
def kv_hash_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Where each hash lies when all buckets have been split."""
    hashes = _hashes(spark, sf).where("h IS NOT NULL").select("h").distinct()
    return layout.split_parts(hashes, "h", layout.hash_split(hashes, "h", limit=_SPLIT_LIMIT)).select("h", "bucket", "level", "part")


@query(
    """SELECT hist_id, CASE WHEN hash_0_ >= 0 THEN hash_0_ >> 7 ELSE (hash_0_ >> 7) + (CAST(1 AS BIGINT) << 57) END AS h1,
CAST(hash_0_ & 127 AS INTEGER) AS h2, CAST((((hash_0_ >> 7) & 4294967295) * 64) >> 32 AS INTEGER) AS start FROM key_history"""
)
def kv_hash_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = keys.hash_parts(F.col("h"))
    return _hashes(spark, sf).select("hist_id", parts["h1"].alias("h1"), parts["h2"].alias("h2"), keys.fast_mod(parts["h1"], 64).alias("start"))


@query(
    f"""WITH k AS (SELECT {TRUE_KEY_HEX.format(key="data_", length="length_")} AS key_hex, hash_0_ FROM key_history WHERE hash_0_ <> 0)
SELECT key_hex, min(hash_0_) AS h, abs(min(hash_0_) % 8)::INTEGER AS shard, CAST((min(hash_0_) >> 52) & 4095 AS INTEGER) AS bucket
FROM k GROUP BY 1 HAVING count(*) >= 3 AND min(hash_0_) = max(hash_0_)"""
)
def kv_hash_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Hash, shard and ring bucket of the keys whose writers agree about the hash (three at least).

    Here they are computed from the key; the SQL, which has no such hash function, takes
    the ones that the table carries. It is the part of ``kv_hash_routes`` that SQL can check.
    """
    t = tables(spark, sf)("key_history").where(F.col("hash_0_") != 0)
    key = keys.true_key(F.col("data_"), F.col("length_")).alias("k")
    agreed = t.select(key, "hash_0_").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("hash_0_").alias("lo"), F.max("hash_0_").alias("hi")).where("n >= 3 AND lo = hi")
    return _routes(agreed)


def _routes(distinct_keys: DataFrame) -> DataFrame:
    h = keys.hash0(F.col("k"))
    return distinct_keys.select(F.hex("k").alias("key_hex"), h.alias("h"), keys.shard8(h).alias("shard"), keys.ring_bucket(h).alias("bucket"))


@query(None)
def kv_hash_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Hash, shard and ring bucket of every true key of the key history, whatever hashes its rows carry."""
    key = keys.true_key(F.col("data_"), F.col("length_")).alias("k")
    return _routes(tables(spark, sf)("key_history").select(key).where(F.col("k").isNotNull()).distinct())


@query("SELECT doc_id, 45 + strlen(CAST(doc_id AS VARCHAR)) + coalesce(strlen(text), 0) AS record_bytes FROM documents")
def kv_record_size(spark: SparkSession, sf: str) -> DataFrame:
    d = tables(spark, sf)("documents")
    return d.select("doc_id", record.record_size(F.col("doc_id").cast("string"), F.col("text")).alias("record_bytes"))


@query("SELECT abs(doc_id % 8)::INTEGER AS shard, count(*) AS records, CAST(sum(45 + strlen(CAST(doc_id AS VARCHAR)) + coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def kv_bytes_per_shard(spark: SparkSession, sf: str) -> DataFrame:
    d = tables(spark, sf)("documents")
    return d.groupBy(keys.shard8(F.col("doc_id")).alias("shard")).agg(F.count(F.lit(1)).alias("records"), F.sum(record.record_size(F.col("doc_id").cast("string"), F.col("text"))).alias("bytes"))


_PACK = """WITH RECURSIVE r AS (SELECT {group} AS g, {id} AS id, {size} AS size, row_number() OVER (PARTITION BY {group} ORDER BY {id}) AS pos FROM {table}),
w AS (SELECT g, id, size, pos, CAST(0 AS BIGINT) AS block_id, CAST(0 AS BIGINT) AS start_at FROM r WHERE pos = 1
UNION ALL SELECT r.g, r.id, r.size, r.pos, CASE WHEN w.start_at + w.size + r.size > {cap} THEN w.block_id + 1 ELSE w.block_id END, CASE WHEN w.start_at + w.size + r.size > {cap} THEN 0 ELSE w.start_at + w.size END
FROM w JOIN r ON r.g = w.g AND r.pos = w.pos + 1)"""


@query(_PACK.format(group="doc_id % 16", id="doc_id", size="45 + strlen(CAST(doc_id AS VARCHAR)) + coalesce(strlen(text), 0)", table="documents", cap=65520) + " SELECT id AS doc_id, g AS file_id, block_id, start_at AS \"offset\" FROM w")
def kv_block_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in 16 files, packed into blocks in order of their id."""
    d = tables(spark, sf)("documents").select("doc_id", (F.col("doc_id") % 16).alias("file_id"), record.record_size(F.col("doc_id").cast("string"), F.col("text")).alias("size"))
    return layout.assign_blocks(d, ["file_id"], [F.col("doc_id")], F.col("size")).select("doc_id", "file_id", "block_id", "offset")


@query("SELECT l_orderkey, l_linenumber, CAST((l_orderkey << 32) | l_linenumber AS VARCHAR) AS cache_key FROM lineitem")
def kv_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    li = tables(spark, sf)("lineitem")
    return li.select("l_orderkey", "l_linenumber", record.cache_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("cache_key"))


# I: the log


_WAL_FILE = 65_536
_WAL_SQL = _PACK.format(group="event_type", id="event_id", size="13 + strlen(props)", table="events", cap=_WAL_FILE) + ", l AS (SELECT g AS event_type, id AS event_id, ((block_id + 1) << 32) | (start_at + size) AS lsn FROM w)"


def _wal(spark: SparkSession, sf: str) -> DataFrame:
    e = tables(spark, sf)("events").select("event_type", "event_id", F.octet_length("props").alias("n"))
    return wal_ops.append(e, ["event_type"], [F.col("event_id")], F.col("n"), _WAL_FILE).select("event_type", "event_id", "lsn")


@query(_WAL_SQL + " SELECT * FROM l")
def wal_lsn(spark: SparkSession, sf: str) -> DataFrame:
    return _wal(spark, sf)


@query(_WAL_SQL + ", m AS (SELECT event_type, max(lsn) AS top, min(lsn) + 1000 AS read_to FROM l GROUP BY 1) SELECT l.event_type, event_id, lsn FROM l JOIN m ON m.event_type = l.event_type WHERE lsn > read_to AND lsn <= top - 100")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    rows = _wal(spark, sf)
    marks = rows.groupBy("event_type").agg((F.max("lsn") - 100).alias("applied"), (F.min("lsn") + 1000).alias("read"))
    joined = join_small(rows, marks, ["event_type"], "inner")
    return wal_ops.replay_after(joined, "lsn", F.col("read"), F.col("applied")).select("event_type", "event_id", "lsn")


@query("SELECT db_name, lsn, log_type FROM wal_log WHERE (lsn >> 32) >= (SELECT max(lsn) >> 32 FROM wal_log)")
def wal_truncate(spark: SparkSession, sf: str) -> DataFrame:
    w = tables(spark, sf)("wal_log")
    return wal_ops.truncate(w, "lsn", w.agg(F.max("lsn")).scalar()).select("db_name", "lsn", "log_type")


@query("SELECT ckpt_id, db_name, CASE WHEN lsn_new = lsn_copy THEN lsn_copy ELSE lsn_prev END AS lsn FROM checkpoints")
def wal_meta(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("checkpoints").select("ckpt_id", "db_name", wal.checkpoint_lsn(F.col("lsn_prev"), F.col("lsn_new"), F.col("lsn_copy")).alias("lsn"))


@query(_WAL_SQL + f" SELECT event_type, max(lsn) AS last_lsn, {_WAL_FILE} - (max(lsn) & 4294967295) AS room FROM l GROUP BY 1")
def wal_surplus(spark: SparkSession, sf: str) -> DataFrame:
    return wal_ops.surplus(_wal(spark, sf), ["event_type"], "lsn", _WAL_FILE)


# K, H, J


@query(f"SELECT file_id, db_name, level FROM ({_FILES})")
def manifest_list(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.live_files(tables(spark, sf)("file_infos")).select("file_id", "db_name", F.col("file_level").cast("int").alias("level"))


@query(
    """SELECT file_level, count(*) AS files, CAST(sum(greatest(coalesce(file_size_, 0), 0)) AS BIGINT) AS bytes FROM
(SELECT * FROM file_infos QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY manifest_no DESC) = 1) WHERE file_status = 0 GROUP BY 1"""
)
def manifest_levels(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.levels(tables(spark, sf)("file_infos"))


@query("SELECT c_custkey, '$' || strlen(c_name) || chr(13) || chr(10) || c_name || chr(13) || chr(10) AS reply FROM customer")
def resp_encode(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("customer").select("c_custkey", resp.bulk(F.col("c_name")).cast("string").alias("reply"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'SET' ELSE 'GET' END AS verb, c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS value, CAST(NULL AS VARCHAR) AS problem FROM customer")
def resp_decode(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)("customer")
    sent = F.when(F.col("c_custkey") % 2 == 0, resp.request(F.lit("set"), F.col("c_name"), F.col("c_mktsegment"))).otherwise(resp.request(F.lit("GET"), F.col("c_name")))
    decoded = resp.decode_requests(c.select("c_custkey", sent.alias("data")), "data")
    return decoded.select("c_custkey", "verb", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "problem")


_CACHE = 100


@query(
    f"""WITH t AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, user_id, before IS NOT NULL AND (SELECT count(*) FROM t u WHERE u.event_id > t.before AND u.event_id < t.event_id AND (u.before IS NULL OR u.before <= t.before)) < {_CACHE} AS hit FROM t"""
)
def lru_trace(spark: SparkSession, sf: str) -> DataFrame:
    return cache.lru_trace(tables(spark, sf)("events").select("event_id", "user_id"), "user_id", "event_id", _CACHE)


@query(SQL["kv_latest_by_key"])
def kv_stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files into an upsert sink; its table when the stream is drained."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*")
    keyed = stream.select(F.col("user_id").cast("string").alias("key"), "value", "event_type", "ts", "event_id")
    sink = UpsertSink(spark, scratch(spark, "kv-stream"), "key", ["ts", "event_id"])
    sink.start(keyed, availableNow=True).awaitTermination()
    return cut(sink.table())


@query(
    """SELECT code, CASE code WHEN 0 THEN 'OK ' WHEN 40002 THEN 'Error: ' WHEN 40001 THEN 'Database error: ' WHEN 40003 THEN 'Not found: ' WHEN 40004 THEN 'Already exist: '
WHEN 40005 THEN 'Invalid path: ' ELSE 'Error code(' || code || '): ' END || 'msg' AS text FROM (SELECT unnest([0, 1, 30004, 40001, 40002, 40003, 40004, 40005, 60003]) AS code)"""
)
def status_text(spark: SparkSession, sf: str) -> DataFrame:
    codes = spark.createDataFrame([(c,) for c in (0, 1, 30004, 40001, 40002, 40003, 40004, 40005, 60003)], "code int")
    return codes.select("code", status.status_text(F.col("code"), F.lit("msg")).alias("text"))
