"""p1 and p4: queries over the record copies and the key probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.keys import true_key
from siltbed.llm import seen, survivors
from siltbed.plans.core_problems import TRUE_KEY_HEX
from siltbed.session import scratch
from siltbed.sources.storage import tables

FUSED_AS_OF = "2025-06-01"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    best = survivors.best_copies(t("slices"), t("file_infos"))
    return best.select("db_name", F.hex("key").alias("key_hex"), "value_rec_id", "slot_rec_id")


def p1_fused(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    fused = survivors.fused_records(t("slices"), t("file_infos"), FUSED_AS_OF)
    return fused.select("db_name", F.hex("key").alias("key_hex"), F.hex("value_").alias("value_hex"), "slot", "version_")


def p1_overruled(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return survivors.overruled(t("slices"), t("file_infos"), FUSED_AS_OF)


def _hashed(table: DataFrame, order: str, bits: int = 64) -> DataFrame:
    return table.select(order, seen.key_hash(true_key(F.col("data_"), F.col("length_")), bits).alias("h"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    earlier = _hashed(t("key_history"), "hist_id").select("h")
    return seen.seen_before(earlier, _hashed(t("key_probes"), "probe_id"), "probe_id", "h")


def p4_batches(spark: SparkSession, sf: str, batches: int = 4) -> DataFrame:
    """p4_found with the probes in batches: each is judged against a stored index and then merged into it."""
    t = tables(spark, sf)
    home = scratch(spark, "p4-index")
    seen.build(_hashed(t("key_history"), "hist_id").select("h")).write.parquet(f"{home}/0")
    probes = _hashed(t("key_probes"), "probe_id")
    last = probes.agg(F.max("probe_id").alias("m")).first().m or 0
    size, found = last // batches + 1, None
    for i in range(batches):
        batch = probes.where((F.col("probe_id") >= i * size) & (F.col("probe_id") < (i + 1) * size))
        index = spark.read.schema(seen.INDEX_SCHEMA).parquet(f"{home}/{i}")
        part = seen.seen_before(None, batch, "probe_id", "h", index)
        found = part if found is None else found.unionByName(part)
        if i + 1 < batches:
            seen.extend(index, batch.select("h")).write.parquet(f"{home}/{i + 1}")
    return found


def p4_exact(spark: SparkSession, sf: str) -> DataFrame:
    """What the index says at 64 bits, against the exact keys: probes, new keys, keys missed, false alarms."""
    return p4_wrong_answers(spark, sf, (64,)).select("hash_bits", "probes", "new_keys", "missed", "false_alarms")


def p4_wrong_answers(spark: SparkSession, sf: str, hash_bits: tuple[int, ...] = (64, 28)) -> DataFrame:
    """The rate of wrong answers at 64 and at 28 hash bits: as measured against exact keys, and as expected.

    The exact answer is taken from the keys themselves, so this is a test of the operator
    and not a way to run it.
    """
    t = tables(spark, sf)
    key = true_key(F.col("data_"), F.col("length_"))
    history = t("key_history").select(key.alias("k")).where("k IS NOT NULL").distinct()
    probes = t("key_probes").select("probe_id", key.alias("k")).where("k IS NOT NULL").distinct()
    first = probes.groupBy("k").agg(F.min("probe_id").alias("first_id"))
    new = first.join(history, "k", "left_anti").select(F.col("first_id").alias("probe_id"), F.lit(True).alias("new"))
    truth = probes.select("probe_id").join(new, "probe_id", "left").select("probe_id", F.col("new").isNull().alias("truth"))
    out = None
    for bits in hash_bits:
        said = seen.seen_before(_hashed(t("key_history"), "hist_id", bits).select("h"), _hashed(t("key_probes"), "probe_id", bits), "probe_id", "h").withColumn("said", F.lit(True))
        both = truth.join(said, "probe_id", "left").withColumn("said", F.coalesce("said", F.lit(False)))
        row = both.agg(
            F.lit(bits).alias("hash_bits"),
            F.count(F.lit(1)).alias("probes"),
            F.sum((~F.col("truth")).cast("bigint")).alias("new_keys"),
            F.sum((F.col("truth") & ~F.col("said")).cast("bigint")).alias("missed"),
            F.sum((~F.col("truth") & F.col("said")).cast("bigint")).alias("false_alarms"),
        )
        out = row if out is None else out.unionByName(row)
    keys = history.agg(F.count(F.lit(1))).scalar()
    measured = F.col("false_alarms") / F.greatest("new_keys", F.lit(1))
    # A new key meets the earlier ones and, on average, half of the other new ones.
    expected = (keys + F.col("new_keys") / 2) * F.pow(F.lit(2.0), -F.col("hash_bits"))
    return out.select("*", measured.alias("measured_rate"), expected.alias("expected_rate"))


QUERIES = {f.__name__: f for f in (p1_found, p1_fused, p1_overruled, p4_found, p4_batches, p4_exact, p4_wrong_answers)}

_COPIES = f"""
WITH live AS (SELECT file_id FROM (SELECT * FROM file_infos QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY manifest_no DESC) = 1) WHERE file_status = 0),
copies AS (SELECT DISTINCT s.*, {TRUE_KEY_HEX.format(key="key_", length="key_length_")} AS k, live.file_id IS NOT NULL AS live_file
           FROM slices s LEFT JOIN live ON live.file_id = s.file_id_),
judged AS (SELECT *, value_ IS NOT NULL AND (data_length_ = 0 OR data_length_ = 45 + length(k) // 2 + octet_length(value_)) AS complete FROM copies)
"""

# The ages are weighed as the operator does: whole half-lives by shifting, parts of one in 20 bits; here sums are exact for up to 60 half-lives.
_VOTES = (
    _COPIES
    + f"""
, aged AS (SELECT *, greatest(date_diff('day', CAST(stored_at AS DATE), DATE '{FUSED_AS_OF}'), 0) AS age, row_number() OVER (ORDER BY coalesce(version_, 0), seq_, rec_id) AS r FROM judged),
weighed AS (SELECT *, CAST(round(pow(2, 20 - (age % 7) / 7.0)) AS HUGEINT) * CAST(pow(2, 60 - age // 7) AS HUGEINT) AS w FROM aged),
keyed AS (SELECT db_name, k FROM judged GROUP BY 1, 2 HAVING count(DISTINCT rec_id) > 1),
votes AS (SELECT db_name, k, 'value' AS f, hex(value_) AS v, sum(w * CASE WHEN complete THEN 4 ELSE 1 END) AS n, max(r) AS r FROM weighed WHERE value_ IS NOT NULL GROUP BY ALL
    UNION ALL SELECT db_name, k, 'slot', file_id_ || ':' || block_id_ || ':' || offset_, sum(w * CASE WHEN live_file THEN 4 ELSE 1 END), max(r) FROM weighed WHERE file_id_ > 0 GROUP BY ALL
    UNION ALL SELECT db_name, k, 'version', CAST(version_ AS VARCHAR), sum(w * 4), max(r) FROM weighed WHERE version_ > 0 GROUP BY ALL),
won AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY db_name, k, f ORDER BY n DESC, r DESC, v DESC) = 1)
"""
)

_KEYS = f"SELECT probe_id, {TRUE_KEY_HEX.format(key='data_', length='length_')} AS k FROM key_probes"
_TRUTH = f"""
WITH probes AS (SELECT DISTINCT * FROM ({_KEYS})),
history AS (SELECT DISTINCT {TRUE_KEY_HEX.format(key="data_", length="length_")} AS k FROM key_history),
firsts AS (SELECT k, min(probe_id) AS first_id FROM probes GROUP BY k)
"""
_SEEN = (
    _TRUTH
    + """
SELECT p.probe_id FROM probes p JOIN firsts f ON f.k = p.k LEFT JOIN history h ON h.k = p.k
WHERE h.k IS NOT NULL OR p.probe_id > f.first_id"""
)

SQL = {
    "p1_found": _COPIES
    + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY db_name, k ORDER BY coalesce(version_, 0) DESC, seq_ DESC) AS r FROM judged),
best AS (SELECT db_name, k AS key_hex, arg_min(rec_id, r) AS first_rec, arg_min(rec_id, r) FILTER (complete) AS value_rec, arg_min(rec_id, r) FILTER (live_file) AS slot_rec
         FROM ranked GROUP BY db_name, k HAVING count(DISTINCT rec_id) > 1)
SELECT db_name, key_hex, coalesce(value_rec, first_rec) AS value_rec_id, coalesce(slot_rec, value_rec, first_rec) AS slot_rec_id FROM best""",
    "p1_fused": _VOTES
    + """
SELECT y.db_name, y.k AS key_hex, max(v) FILTER (f = 'value') AS value_hex, max(v) FILTER (f = 'slot') AS slot, CAST(max(v) FILTER (f = 'version') AS BIGINT) AS version_
FROM keyed y LEFT JOIN won ON won.db_name = y.db_name AND won.k = y.k GROUP BY y.db_name, y.k""",
    "p1_overruled": _VOTES
    + """, first AS (SELECT * FROM votes WHERE f = 'value' QUALIFY row_number() OVER (PARTITION BY db_name, k ORDER BY r DESC) = 1)
SELECT y.db_name, count(*) AS keys, CAST(sum(CAST(w.v IS DISTINCT FROM o.v AS INTEGER)) AS BIGINT) AS overruled FROM keyed y
LEFT JOIN (SELECT * FROM won WHERE f = 'value') w ON w.db_name = y.db_name AND w.k = y.k LEFT JOIN first o ON o.db_name = y.db_name AND o.k = y.k GROUP BY 1""",
    "p4_exact": _TRUTH
    + """SELECT CAST(64 AS INTEGER) AS hash_bits, count(*) AS probes, CAST(sum(CAST(is_new AS INTEGER)) AS BIGINT) AS new_keys, CAST(0 AS BIGINT) AS missed, CAST(0 AS BIGINT) AS false_alarms
FROM (SELECT p.probe_id, h.k IS NULL AND p.probe_id = f.first_id AS is_new FROM probes p JOIN firsts f ON f.k = p.k LEFT JOIN history h ON h.k = p.k WHERE p.k IS NOT NULL)""",
    "p4_found": _SEEN,
    "p4_batches": _SEEN,
}
