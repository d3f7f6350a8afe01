"""The catalogue of files: present records, levels, soft deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.consolidate import present_files


def live_files(records: DataFrame, level: int | None = None, more: list[str] | None = None) -> DataFrame:
    """The present record of every file that isn't deleted, of one level or all, with ``more`` of its columns."""
    out = present_files(records, more).where(F.col("file_status") == 0)
    return out if level is None else out.where(F.col("file_level") == level)


def levels(records: DataFrame) -> DataFrame:
    """Per level: how many live files there are and their recorded bytes (those without a size count as 0)."""
    size = F.greatest(F.coalesce("file_size_", F.lit(0)), F.lit(0))
    return live_files(records).groupBy("file_level").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
