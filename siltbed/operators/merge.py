"""Merging sorted runs, compaction, and which files a compaction takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.keys import key_at_least, shortlex, shortlex_sort
from siltbed.operators.cursor import ranked
from siltbed.operators.log import latest
from siltbed.sources import storage

LEVEL0_FILES = 8


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All runs in one, with ``run_no`` by their order in the list."""
    return reduce(DataFrame.unionByName, [r.withColumn("run_no", F.lit(i)) for i, r in enumerate(runs)])


def merge_runs(runs: list[DataFrame], key: str, more: list[Column] | None = None) -> DataFrame:
    """The rows of all runs with their position in merged order; equal keys in the order of the runs, none dropped."""
    return ranked(union_runs(runs), [*shortlex_sort(F.col(f"`{key}`")), F.col("run_no").asc(), *(more or [])])


def merge_last(runs: list[DataFrame], key: str) -> DataFrame:
    """The row with the largest key; of equal ones that of the earliest run."""
    return union_runs(runs).orderBy(*shortlex_sort(F.col(f"`{key}`"), descending=True), F.col("run_no").asc()).limit(1)


def compact(runs: list[DataFrame], key: str, order: list[str], deleted: str | None = None, bottom: bool = False) -> DataFrame:
    """One row per key: its last write over all runs. Deletes are kept, as older runs below may
    still have the key, unless this is the ``bottom`` level."""
    merged = reduce(DataFrame.unionByName, runs)
    return latest(merged, key, order, deleted if bottom else None)


def pick_overlapping(files: DataFrame, low_level: int, high_level: int) -> DataFrame:
    """The files a compaction of ``low_level`` into ``high_level`` takes: all of the low level,
    and those of the high level whose [min_key, max_key] meets the range of the low level.
    Files without keys don't count."""
    keyed = files.where(F.col("min_key").isNotNull() & F.col("max_key").isNotNull())
    low = keyed.where(F.col("level") == low_level)
    lo = low.agg(F.min(shortlex(F.col("min_key")))).scalar()
    hi = low.agg(F.max(shortlex(F.col("max_key")))).scalar()
    meets = key_at_least(F.col("max_key"), lo["k"]) & key_at_least(hi["k"], F.col("min_key"))
    return low.unionByName(keyed.where((F.col("level") == high_level) & meets))


def needs_compaction(files: DataFrame, level: int = 0, limit: int = LEVEL0_FILES) -> DataFrame:
    """One row: how many files the level has, and whether that is too many."""
    return files.where(F.col("level") == level).agg(F.count(F.lit(1)).alias("files")).withColumn("needed", F.col("files") > limit)


def write_run(rows: DataFrame, key: str, path: str, files: int | None = None, bloom: bool = False) -> DataFrame:
    """Write ``rows`` as one sorted run: disjoint ranges of keys, each file sorted. Returns it as read back.

    The key's length is stored first, so that the statistics of the files follow the key
    order and a filter on (length, key) skips row groups. With ``bloom`` every row group
    also has a Bloom filter on the key, which point lookups ask first.
    """
    order = shortlex_sort(F.col(f"`{key}`"))
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    staged = f"{path}.staged"
    writer = ranged.sortWithinPartitions(*order).select(F.octet_length(f"`{key}`").alias("key_bytes"), "*").write.mode("overwrite")
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(staged)
    if not storage.publish(rows.sparkSession, staged, path):
        storage.delete(rows.sparkSession, staged)
        raise FileExistsError(path)
    return rows.sparkSession.read.parquet(path)
