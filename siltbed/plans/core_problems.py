"""The p2, p3 and p5 queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import changefeed, consolidate, incremental
from siltbed.session import scratch
from siltbed.sources.storage import tables

#: Size of a consolidated file in the queries; production files would take the operator's default.
QUERY_TARGET_BYTES = 262_144


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return incremental.unhandled_records(t("wal_log"), t("checkpoints"), scratch(spark, "p2-found")).select("db_name", "lsn")


def p2_batches(spark: SparkSession, sf: str) -> DataFrame:
    loaded = incremental.incremental_table(spark, f"{sf}/wal_log.parquet", scratch(spark, "p2-batches"), "delivery_id")
    return loaded.groupBy("db_name").agg(F.count(F.lit(1)).alias("deliveries"), F.sum("delivery_id").alias("id_sum"), F.sum(F.octet_length("log_data")).alias("bytes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    live = changefeed.live_keys(tables(spark, sf)("wal_log"))
    return live.select("db_name", F.hex("key").alias("key_hex"), "lsn")


def p3_state(spark: SparkSession, sf: str) -> DataFrame:
    live = changefeed.live_keys(tables(spark, sf)("wal_log"))
    return live.select("db_name", F.hex("key").alias("key_hex"), "lsn", F.hex("value").alias("value_hex"))


def p3_partial(spark: SparkSession, sf: str) -> DataFrame:
    state = changefeed.partial_state(tables(spark, sf)("wal_log"))
    return state.select("db_name", F.hex("key").alias("key_hex"), "lsn", F.hex("value").alias("value_hex"), "short_lsn", "long_lsn")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return consolidate.consolidated_files(t("slices"), t("file_infos"), scratch(spark, "p5-found"), "v1", target=QUERY_TARGET_BYTES).select("file_id")


def p5_layout(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    layout = consolidate.consolidated_layout(t("slices"), t("file_infos"), scratch(spark, "p5-layout"), "v1", target=QUERY_TARGET_BYTES)
    return layout.select("rec_id", "db_name", "file_level", F.col("file").contains("-").alias("rewritten"))


def p5_folder(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a folder of small files, by database, consolidated."""
    home = scratch(spark, "p5-folder")
    rows = spark.read.parquet(f"{sf}/wal_log.parquet")
    rows.write.option("maxRecordsPerFile", 2000).partitionBy("db_name").parquet(f"{home}/small files")
    out = consolidate.consolidate_folder(spark, f"{home}/small files", f"{home}/out", "v1")
    return out.select("delivery_id", "db_name", "lsn", "log_type", "log_size", F.hex("log_data").alias("data_hex"))


QUERIES = {f.__name__: f for f in (p2_found, p2_batches, p3_found, p3_state, p3_partial, p5_found, p5_layout, p5_folder)}

#: SQL of the true key in upper-case hex, from a stored buffer and a length.
TRUE_KEY_HEX = """CASE WHEN {length} > 0 THEN substr(hex({key}), 1, 2 * {length})
 WHEN hex({key}) LIKE '%0D0A' THEN substr(hex({key}), 1, 2 * octet_length({key}) - 4)
 WHEN right(hex({key}), 2) = '0A' THEN substr(hex({key}), 1, 2 * octet_length({key}) - 2)
 WHEN right(hex({key}), 2) = '00' AND octet_length({key}) >= 64 THEN regexp_replace(hex({key}), '(?:00)+$', '')
 WHEN right(hex({key}), 2) = '00' THEN substr(hex({key}), 1, 2 * octet_length({key}) - 2)
 ELSE hex({key}) END"""

_WHOLE = "SELECT *, lower(trim(log_type)) AS t FROM wal_log WHERE octet_length(log_data) = log_size"

_KIND = """CASE WHEN {t} IN ('put', 'p', '1') THEN 'put' WHEN {t} IN ('delete', 'del', 'd', '2') THEN 'delete' ELSE 'other' END"""

LIVE_SQL = f"""
WITH whole AS ({_WHOLE}),
present AS (SELECT db_name, lsn, {_KIND.format(t="t")} AS kind, hex(log_data) AS h FROM whole
            QUALIFY row_number() OVER (PARTITION BY db_name, lsn ORDER BY received_at DESC) = 1),
sized AS (SELECT *, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS klen
          FROM present WHERE kind <> 'other' AND length(h) >= 8),
changes AS (SELECT db_name, lsn, kind, substr(h, 9, 2 * klen) AS key_hex, substr(h, 9 + 2 * klen) AS value_hex
            FROM sized WHERE klen BETWEEN 1 AND 64 AND length(h) >= 8 + 2 * klen),
latest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY db_name, key_hex ORDER BY lsn DESC) = 1)
"""

_PRESENT_FILES = "SELECT * FROM file_infos WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY manifest_no DESC) = 1"

_LISTING = f"""
WITH present AS ({_PRESENT_FILES}),
records AS (SELECT DISTINCT rec_id, file_id_, db_name, {TRUE_KEY_HEX.format(key="key_", length="key_length_")} AS k, value_ FROM slices),
measured AS (SELECT file_id_, sum(45 + length(k) // 2 + coalesce(octet_length(value_), 0)) AS n FROM records GROUP BY 1),
listing AS (SELECT file_id, CAST(file_level AS INTEGER) AS file_level,
                   CASE WHEN file_size_ > 0 THEN file_size_ ELSE coalesce(n, 0) END AS size
            FROM present LEFT JOIN measured ON file_id_ = file_id WHERE file_status = 0 AND file_level >= 1)
"""

SQL = {
    "p2_found": f"""
WITH whole AS ({_WHOLE}),
present AS (SELECT db_name, lsn, log_data FROM whole QUALIFY row_number() OVER (PARTITION BY db_name, lsn ORDER BY received_at DESC) = 1),
first_seen AS (SELECT p.db_name, p.lsn, min(w.received_at) AS first_at FROM present p
               JOIN whole w ON w.db_name = p.db_name AND w.lsn = p.lsn AND w.log_data = p.log_data GROUP BY 1, 2),
runs AS (SELECT db_name, checkpoint_, read_at FROM checkpoints WHERE lsn_new = lsn_copy
         QUALIFY row_number() OVER (PARTITION BY db_name ORDER BY written_at DESC, ckpt_id DESC) = 1)
SELECT f.db_name, f.lsn FROM first_seen f LEFT JOIN runs r ON r.db_name = f.db_name
WHERE r.db_name IS NULL OR f.lsn > r.checkpoint_ OR f.first_at > r.read_at""",
    "p2_batches": """
SELECT db_name, count(*) AS deliveries, CAST(sum(delivery_id) AS BIGINT) AS id_sum, CAST(sum(octet_length(log_data)) AS BIGINT) AS bytes
FROM wal_log GROUP BY 1""",
    "p3_found": LIVE_SQL + "SELECT db_name, key_hex, lsn FROM latest WHERE kind = 'put'",
    "p3_state": LIVE_SQL + "SELECT db_name, key_hex, lsn, value_hex FROM latest WHERE kind = 'put'",
    "p3_partial": LIVE_SQL
    + """, gone AS (SELECT db_name, key_hex, max(lsn) AS gone_at FROM changes WHERE kind = 'delete' GROUP BY 1, 2)
SELECT c.db_name, c.key_hex, max(lsn) AS lsn, arg_max(value_hex, lsn) FILTER (value_hex <> '') AS value_hex,
       max(lsn) FILTER (value_hex <> '' AND length(value_hex) < 64) AS short_lsn, max(lsn) FILTER (length(value_hex) >= 64) AS long_lsn
FROM changes c LEFT JOIN gone g ON g.db_name = c.db_name AND g.key_hex = c.key_hex WHERE kind = 'put' AND (gone_at IS NULL OR lsn > gone_at) GROUP BY 1, 2""",
    "p5_folder": "SELECT delivery_id, db_name, lsn, log_type, log_size, hex(log_data) AS data_hex FROM wal_log",
    "p5_found": _LISTING + "SELECT file_id FROM listing WHERE size < 32768",
    "p5_layout": _LISTING + "SELECT rec_id, db_name, file_level, size < 32768 AS rewritten FROM records JOIN listing ON file_id = file_id_",
}
