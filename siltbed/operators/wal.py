"""The write-ahead log: sequence numbers, replay, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.record import WAL_HEAD_BYTES
from siltbed.functions.wal import lsn_file, lsn_pack
from siltbed.operators.layout import assign_blocks


def append(records: DataFrame, log: list[str], order: list[Column], data_size: Column, file_bytes: int, after: int = 1 << 32) -> DataFrame:
    """``records`` with ``size`` and the ``lsn`` that appending them in order, behind the lsn ``after``, gives.

    An lsn is the number of the log file (from 1) and the record's end in it; a record that
    doesn't fit in what is left of ``file_bytes`` begins the next file.
    """
    size = data_size.cast("bigint") + WAL_HEAD_BYTES
    laid = assign_blocks(records.withColumn("size", size), log, order, F.col("size"), file_bytes, ((after >> 32) - 1, after & 0xFFFFFFFF))
    return laid.withColumn("lsn", lsn_pack(F.col("block_id") + 1, F.col("offset") + F.col("size"))).drop("block_id", "offset")


def replay_after(records: DataFrame, lsn: str, read: Column, applied: Column) -> DataFrame:
    """The records a reader at ``read`` still has to take, up to the last applied one."""
    return records.where((F.col(lsn) > read) & (F.col(lsn) <= applied))


def truncate(records: DataFrame, lsn: str, flushed: Column) -> DataFrame:
    """The records of the log files that may not be removed yet: those from the file of the flushed lsn on."""
    return records.where(lsn_file(F.col(lsn)) >= lsn_file(flushed))


def surplus(records: DataFrame, log: list[str], lsn: str, file_bytes: int) -> DataFrame:
    """Of each log: the last lsn, and the room left in its file."""
    last = records.groupBy(*log).agg(F.max(lsn).alias("last_lsn"))
    return last.withColumn("room", F.lit(file_bytes) - F.col("last_lsn").bitwiseAND(F.lit(4294967295)))
