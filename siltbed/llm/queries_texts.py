"""p6, p7 and p8: queries over the mail archive. No SQL gives the rows of most; they have tests, and SQL states what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import leaks, packing, sentences
from siltbed.sources.storage import tables


#: Commands that the mails of this archive speak of, written small where a sentence begins too.
COMMANDS = ("iostat", "vmstat", "netstat", "mpstat", "pidstat", "dstat", "sar", "lsof", "strace", "perf", "top", "htop", "grep", "awk", "sed", "curl", "wget", "rsync", "ssh", "fsck", "mount")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(tables(spark, sf)("documents"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers are filled: tokens, containers, the fewest that could hold them, and the share left empty."""
    packed = packing.containers(tables(spark, sf)("documents"))
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = used.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("n").alias("fullest"))
    fewest = F.ceil(F.col("tokens") / packing.CAPACITY)
    return total.select("tokens", "containers", "fullest", fewest.alias("fewest_possible"), F.round(1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY), 6).alias("empty_share"))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: every document is in them once, its pieces in a row, and none is overfull."""
    packed = packing.containers(tables(spark, sf)("documents"))
    gap = (F.col("start_at") != F.col("piece") * packing.CAPACITY) | (F.col("n_tokens") > packing.CAPACITY)
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("d"), (F.max("piece") + 1).alias("m"), F.sum(gap.cast("bigint")).alias("gaps"))
    texts = per.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when((F.col("n") != F.col("d")) | (F.col("n") != F.col("m")), 1).otherwise(0).cast("bigint")).alias("doubled"), F.sum("gaps").alias("gaps"))
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return texts.withColumn("overfull", used.agg(F.sum((F.col("n") > packing.CAPACITY).cast("bigint"))).scalar())


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return leaks.leaks(t("documents"), "doc_id", "text", t("eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(tables(spark, sf)("documents"), with_text=False, names=COMMANDS)


def p8_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(tables(spark, sf)("documents"), names=COMMANDS)


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the units: they lie in their document, don't overlap, aren't empty, have no white space at either end, and are what the text has there."""
    d = tables(spark, sf)("documents")
    units = sentences.sentence_units(d, names=COMMANDS)
    above = F.lag("end_at").over(Window.partitionBy("doc_id").orderBy("start_at", "end_at"))
    joined = units.withColumn("above", above).join(d.select("doc_id", "text", "n_chars"), "doc_id")
    told = F.substr("text", (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int"))
    faults = {
        "outside": (F.col("start_at") < 0) | (F.col("end_at") > F.length("text")),
        "overlapping": F.coalesce(F.col("above") > F.col("start_at"), F.lit(False)),
        "empty": F.col("end_at") <= F.col("start_at"),
        "untrimmed": F.col("sentence").rlike(r"^\s|\s$"),
        "other": F.col("sentence") != told,
    }
    return joined.agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in faults.items()])


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p6_checks, p7_found, p8_found, p8_units, p8_checks)}
_NONE = "CAST(0 AS BIGINT) AS "
SQL: dict[str, str] = {
    "p6_checks": f"SELECT count(*) AS documents, {_NONE}doubled, {_NONE}gaps, {_NONE}overfull FROM documents",
    "p8_checks": f"SELECT {_NONE}outside, {_NONE}overlapping, {_NONE}empty, {_NONE}untrimmed, {_NONE}other",
}
