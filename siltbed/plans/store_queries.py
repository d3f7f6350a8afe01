"""Queries for the stored structures, the protocol and the layout of files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import keys, record, resp, status, wal
from siltbed.operators import changefeed, cursor, layout, manifest, merge
from siltbed.plans import kv_queries
from siltbed.plans.core_problems import LIVE_SQL, TRUE_KEY_HEX
from siltbed.session import cut, scratch
from siltbed.sources import resp_stream
from siltbed.sources.storage import tables
from siltbed.sources.stored_log import START, StoredLog
from siltbed.table import KvTable, RunCache

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Records and names


@query(
    f"""SELECT DISTINCT rec_id, {TRUE_KEY_HEX.format(key="key_", length="key_length_")} AS key_hex, coalesce(hex(value_), '') AS value_hex, coalesce(version_, 0) AS version, coalesce(file_id_, 0) AS file_id,
coalesce(block_id_, 0) AS block_id, CAST(coalesce(block_type_, 0) AS INTEGER) AS block_type, coalesce(offset_, 0) AS "offset" FROM slices"""
)
def kv_record_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of the slices encoded to bytes and decoded again."""
    s = tables(spark, sf)("slices")
    key = keys.true_key(F.col("key_"), F.col("key_length_"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    encoded = s.select("rec_id", key.alias("k"), "*").select("rec_id", record.encode_record(F.col("k"), F.col("value_"), number("version_"), number("file_id_"), number("block_id_"), number("block_type_"), number("offset_"), keys.hash0(F.col("k"))).alias("data"))
    d = record.decode_columns(F.col("data"))
    out = encoded.select("rec_id", d.alias("d")).select("rec_id", F.hex("d.key").alias("key_hex"), F.hex("d.value").alias("value_hex"), "d.version", "d.file_id", "d.block_id", "d.block_type", "d.offset")
    return out.distinct()


@query("SELECT DISTINCT file_id, CASE file_type WHEN 0 THEN file_id || '.wal' ELSE file_id || '.sst' END AS name FROM file_infos WHERE file_id IS NOT NULL")
def manifest_names(spark: SparkSession, sf: str) -> DataFrame:
    f = tables(spark, sf)("file_infos").where(F.col("file_id").isNotNull())
    name = F.when(F.col("file_type") == 0, record.wal_file_name(F.col("file_id"))).otherwise(record.sst_file_name(F.col("file_id")))
    return f.select("file_id", name.alias("name")).distinct()


@query("SELECT rec_id, offset_ % 65536 + 128 >= 65536 AS is_full FROM slices WHERE offset_ IS NOT NULL")
def kv_block_full(spark: SparkSession, sf: str) -> DataFrame:
    s = tables(spark, sf)("slices").where(F.col("offset_").isNotNull())
    return s.select("rec_id", record.is_full(record.offset_in_block(F.col("offset_"))).alias("is_full"))


@query("SELECT delivery_id, lsn >> 32 AS file_no, lsn & 4294967295 AS end_offset FROM wal_log")
def wal_parts(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)("wal_log").select("delivery_id", wal.lsn_file(F.col("lsn")).alias("file_no"), wal.lsn_offset(F.col("lsn")).alias("end_offset"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MIN_BYTE' WHEN c_custkey % 10 = 1 THEN 'MAX_BYTE' ELSE c_name END AS text FROM customer")
def kv_key_text(spark: SparkSession, sf: str) -> DataFrame:
    """Keys as text, with those that stand for no key and for the key beyond all others."""
    c = tables(spark, sf)("customer")
    rest = F.col("c_custkey") % 10
    key = F.when(rest == 0, F.lit("")).when(rest == 1, F.repeat(F.lit("x"), 65)).otherwise(F.col("c_name"))
    return c.select("c_custkey", keys.key_text(key).alias("text"))


@query(
    """SELECT l_orderkey, l_linenumber, code, CASE WHEN code > 70000 THEN 'sst' WHEN code > 60000 THEN 'wal' WHEN code > 50000 THEN 'index' WHEN code > 40000 THEN 'db' WHEN code > 30000 THEN 'server' ELSE 'general' END AS area
FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 10000 + 1 + l_orderkey % 5 AS INTEGER) AS code FROM lineitem)"""
)
def status_area(spark: SparkSession, sf: str) -> DataFrame:
    li = tables(spark, sf)("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10_000 + 1 + F.col("l_orderkey") % 5).cast("int").alias("code"))
    return li.withColumn("area", status.code_area(F.col("code")))


@query("SELECT * FROM (VALUES ('server', 37), ('db', 15), ('index', 4), ('wal', 5), ('sst', 1)) AS t(area, codes)")
def status_codes(spark: SparkSession, sf: str) -> DataFrame:
    return status.code_table(spark).groupBy("area").agg(F.count(F.lit(1)).cast("int").alias("codes"))


# Files and blocks


_PACKED = kv_queries._PACK.format(group="doc_id % 16", id="doc_id", size="45 + strlen(CAST(doc_id AS VARCHAR)) + coalesce(strlen(text), 0)", table="documents", cap=65520)
_BLOCKS_MAX = 1 << 14


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    d = tables(spark, sf)("documents").select("doc_id", (F.col("doc_id") % 16).alias("file_id"), record.record_size(F.col("doc_id").cast("string"), F.col("text")).alias("size"))
    return layout.assign_blocks(d, ["file_id"], [F.col("doc_id")], F.col("size"))


@query(_PACKED + " SELECT g AS file_id, count(DISTINCT block_id) AS blocks FROM w GROUP BY 1")
def kv_block_count(spark: SparkSession, sf: str) -> DataFrame:
    return layout.block_counts(_packed(spark, sf), ["file_id"], "block_id")


@query(_PACKED + f" SELECT g AS file_id, greatest(65520 - arg_max(start_at + size, pos), 0) + ({_BLOCKS_MAX} - 1 - max(block_id)) * 65520 AS room FROM w GROUP BY 1")
def kv_block_free(spark: SparkSession, sf: str) -> DataFrame:
    return layout.free_space(_packed(spark, sf), ["file_id"], "size", _BLOCKS_MAX)


@query(
    f"""WITH p AS (SELECT (pos - 1) // 100 AS block_id, ((pos - 1) % 100) // 16 AS restart_no, key FROM ({kv_queries._BLOCKS}) WHERE ((pos - 1) % 100) % 16 = 0),
a AS (SELECT CAST(c_custkey * 7 AS VARCHAR) AS probe FROM customer),
b AS (SELECT printf('%s%020d', chr(64 + CAST(strlen(key) AS INTEGER)), CAST(key AS BIGINT)) AS at, * FROM p), c AS (SELECT printf('%s%020d', chr(64 + CAST(strlen(probe) AS INTEGER)), CAST(probe AS BIGINT)) AS at, probe FROM a)
SELECT c.probe, b.block_id, b.restart_no FROM c ASOF LEFT JOIN b ON c.at > b.at"""
)
def kv_restart_seek(spark: SparkSession, sf: str) -> DataFrame:
    """For each probe the restart point from which a search for it begins: the last one below it."""
    rows = kv_queries._blocks(spark, sf).withColumn("in_block", (F.col("rank") - 1) % 100)
    points = layout.restart_points(rows, F.col("in_block")).select("key", "block_id", "restart_no")
    probes = tables(spark, sf)("customer").select((F.col("c_custkey") * 7).cast("string").alias("probe"))
    return layout.seek_restart(probes, "probe", points, "key").select("probe", "restart.block_id", "restart.restart_no")


@query(f"SELECT file_id, db_name FROM ({kv_queries._FILES}) WHERE level = 1")
def manifest_level(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.live_files(tables(spark, sf)("file_infos"), level=1).select("file_id", "db_name")


@query("SELECT c_custkey, CAST(least(c_custkey * 8 // (1 + max(c_custkey) OVER ()), 7) AS INTEGER) AS shard FROM customer")
def kv_shard_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """The shard whose range of keys holds each key, the ranges being eighths of the key numbers."""
    c = tables(spark, sf)("customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 20, "0").alias("key"))
    n = c.agg((F.max("c_custkey") + 1).alias("n"))
    low = F.ceil(F.col("shard") * F.col("n") / 8)
    ranges = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("shard")).select("shard", F.lpad(low.cast("string"), 20, "0").alias("low"))
    return cursor.locate(c, "key", ranges, "low", None, "shard").select("c_custkey", "shard")


# Stored tables, logs and requests


def _kv(spark: SparkSession, sf: str) -> DataFrame:
    """The log's Puts and Deletes as one log of keys of all databases, in order of lsn."""
    changes = changefeed.wal_changes(tables(spark, sf)("wal_log"))
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce("db_name", F.lit("")), F.hex("key")).cast("binary")))
    return changes.select("lsn", "kind", key.alias("key"), "value")


_TABLE = LIVE_SQL + "SELECT upper(md5(coalesce(db_name, '') || ':' || key_hex)) AS key_hex, lsn, value_hex FROM latest WHERE kind = 'put'"


@query(_TABLE)
def kv_table_recover(spark: SparkSession, sf: str) -> DataFrame:
    """A table recovered from the log in two steps, the second of which is handed the whole log again."""
    table, log = KvTable(spark, scratch(spark, "kv-recover")), cut(_kv(spark, sf))
    middle = log.agg(F.percentile_approx("lsn", 0.5)).first()[0]
    table.recover(log.where(F.col("lsn") <= (middle or 0)))
    table.recover(log)
    table.flush()
    return table.rows().select(F.hex("key").alias("key_hex"), F.col("version").alias("lsn"), F.hex("value").alias("value_hex"))


@query(_TABLE)
def kv_table_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The log written in twelve calls to a table whose level 0 holds three files: writes trigger flushes, and levels are merged by overlap."""
    table, log = KvTable(spark, scratch(spark, "kv-levels"), level0_files=3, file_rows=100_000), cut(_kv(spark, sf))
    part = F.pmod(F.xxhash64("key", "lsn"), F.lit(12))
    for i in range(12):
        mine = log.where(part == i)
        written = mine.select("key", F.coalesce("value", F.unhex(F.lit(""))).alias("value"), F.col("lsn").alias("version"), (F.col("kind") == "delete").alias("deleted"))
        table.write(written)
    table.compact(1)
    return table.rows().select(F.hex("key").alias("key_hex"), F.col("version").alias("lsn"), F.hex("value").alias("value_hex"))


@query(
    LIVE_SQL
    + """SELECT count(*) AS records, CAST(sum(CAST(kind = 'put' AS INTEGER)) AS BIGINT) AS puts, CAST(sum(CAST(kind = 'delete' AS INTEGER)) AS BIGINT) AS deletes,
max(lsn) AS key_version, true AS pruned FROM changes"""
)
def kv_table_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What a table's manifest says after the whole log was written once, and whether lookups open fewer files than there are."""
    rows = cut(_kv(spark, sf))
    table = KvTable(spark, scratch(spark, "kv-counters"), level0_files=None, file_rows=1 + rows.count() // 8)
    by_write = F.unhex(F.md5(F.concat(F.col("key"), F.col("lsn").cast("string").cast("binary"))))  # every write under a key of its own
    table.write(rows.select(by_write.alias("key"), F.coalesce("value", F.unhex(F.lit(""))).alias("value"), F.col("lsn").alias("version"), (F.col("kind") == "delete").alias("deleted")))
    table.flush()
    pruned = len(table.files_for(bytes(16))) <= 1
    c = table.counters
    return spark.createDataFrame([(table.record_count, c["rows_put"], c["rows_deleted"], table.key_version, pruned)], "records bigint, puts bigint, deletes bigint, key_version bigint, pruned boolean")


@query("SELECT count(*) AS asked, CAST(sum(CAST(n_nationkey IN (SELECT c_custkey FROM customer) AS INTEGER)) AS BIGINT) AS found, true AS hit FROM nation")
def kv_cached_gets(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of all nations looked up twice among the customers, through a cache of the table's files: how many are customers' numbers, and whether the cache was hit."""
    cache = RunCache(spark, 8)
    table = KvTable(spark, scratch(spark, "kv-cached"), cache=cache)
    table.put(tables(spark, sf)("customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")))
    asked = [str(r.n_nationkey).encode() for r in tables(spark, sf)("nation").select("n_nationkey").collect()]
    found = [not table.get(key).isEmpty() for key in [*asked, *asked]]
    told = (len(asked), sum(found) // 2, cache.hits > 0 and cache.misses <= len(table.state["files"]))
    cache.clear()
    return spark.createDataFrame([told], "asked bigint, found bigint, hit boolean")


_LOG_FILE = 65_536
_LOGGED = f"""WITH e AS (SELECT event_id, event_id * 3 // (1 + max(event_id) OVER ()) AS third, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)
SELECT event_id, ((1 + pos // ({_LOG_FILE} // 21)) << 32) | ((pos % ({_LOG_FILE} // 21) + 1) * 21) AS lsn FROM e WHERE third >= 1"""


@query(_LOGGED)
def wal_store(spark: SparkSession, sf: str) -> DataFrame:
    """The events logged in three batches; the writer is taken back behind the second and writes the third again; read behind the first."""
    e = tables(spark, sf)("events").select("event_id")
    third = F.floor(F.col("event_id") * 3 / (1 + e.agg(F.max("event_id")).scalar()))
    log = StoredLog(spark, scratch(spark, "wal-store"), _LOG_FILE)
    ends = [log.append(e.where(third == i), [F.col("event_id")], F.lit(8)) for i in range(3)]
    log.reset_write(ends[1])
    log.append(e.where(third == 2), [F.col("event_id")], F.lit(8))
    return log.read_after(ends[0]).select("event_id", "lsn")


@query("SELECT event_id, lsn FROM (" + _LOGGED.replace("WHERE third >= 1", "") + ") WHERE lsn >> 32 >= (SELECT max(lsn) >> 32 FROM (" + _LOGGED.replace("WHERE third >= 1", "") + "))")
def wal_store_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The events logged after a reset; what is left when the log files before the last are forgotten."""
    e = tables(spark, sf)("events").select("event_id")
    log = StoredLog(spark, scratch(spark, "wal-truncate"), _LOG_FILE)
    log.append(e, [F.col("event_id")], F.lit(8))
    log.reset(START)
    log.append(e, [F.col("event_id")], F.lit(8))
    log.truncate(log.last)
    return log.read_after(0).select("event_id", "lsn")


@query(
    """WITH s AS (SELECT event_id, user_id, event_type = 'purchase' AS is_set, CAST(event_id AS VARCHAR) AS v FROM events),
r AS (SELECT event_id, is_set, last_value(CASE WHEN is_set THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s)
SELECT event_id, CASE WHEN is_set THEN '+OK' || chr(13) || chr(10) WHEN seen IS NULL THEN '$-1' || chr(13) || chr(10) ELSE '$' || strlen(seen) || chr(13) || chr(10) || seen || chr(13) || chr(10) END AS reply FROM r"""
)
def resp_session(spark: SparkSession, sf: str) -> DataFrame:
    """The events as pipelined requests of each user, SET for a purchase and GET for the rest: split, decoded and answered in order."""
    e = tables(spark, sf)("events").select("event_id", F.col("user_id").cast("string").alias("key"), (F.col("event_type") == "purchase").alias("is_set"))
    sent = F.when(F.col("is_set"), resp.request(F.lit("SET"), F.col("key"), F.col("event_id").cast("string"))).otherwise(resp.request(F.lit("GET"), F.col("key")))
    # A PING-like request that the server doesn't know stands before each, so that there is something to split.
    piped = resp.split_requests(e.select("event_id", F.concat(resp.request(F.lit("HELLO")), sent).alias("data")), "data")
    answered = resp_stream.replies(piped, "request", ["event_id", "request_no"], spark.createDataFrame([], "key binary, value binary"))
    return answered.where("request_no = 1").select("event_id", F.col("reply").cast("string").alias("reply"))


@query(
    f"""SELECT needed, files FROM (SELECT count(*) AS files, count(*) > 8 AS needed FROM ({kv_queries._FILES}) WHERE level = 1)"""
)
def kv_level_needs_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return merge.needs_compaction(kv_queries._catalogue(spark, sf), 1).select("needed", "files")
