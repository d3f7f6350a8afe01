"""State of a log of puts and deletes: latest value per key, lookups, membership.

A log is a DataFrame with a key column, an order (columns that rank the writes of a key)
and perhaps a BOOLEAN that marks deletes. Rows with a NULL key are no writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.keys import valid_key


def latest(log: DataFrame, key: str, order: list[str], deleted: str | None = None) -> DataFrame:
    """The last write of every key; without the keys whose last write is a delete.

    The whole row of the winner comes out. Ties in the order are decided by the rest of the
    row. Each task sends at most one row per key, so hot keys don't matter.
    """
    rows = log.where(F.col(f"`{key}`").isNotNull())
    rest = [c for c in log.columns if c not in {key, *order}]
    rank = F.struct(*[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in rest])
    out = rows.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max(rank).alias("__w"))
    out = out.select(*[F.col("__key").alias(c) if c == key else F.col(f"__w.`{c}`").alias(c) for c in log.columns])
    return out if deleted is None else out.where(~F.coalesce(F.col(f"`{deleted}`"), F.lit(False)))


def first_write_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first write of every key."""
    rows = log.where(F.col(f"`{key}`").isNotNull())
    rest = [c for c in log.columns if c not in {key, *order}]
    rank = F.struct(*[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in rest])
    out = rows.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min(rank).alias("__w"))
    return out.select(*[F.col("__key").alias(c) if c == key else F.col(f"__w.`{c}`").alias(c) for c in log.columns])


def get(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; the equality reaches the scan."""
    return table.where(F.col(f"`{key}`") == F.lit(value))


def get_by_location(table: DataFrame, file_id: Column, block_id: Column, offset: Column, at: tuple[int, int, int], upto: int | None = None) -> DataFrame:
    """The rows at a place (file, block, offset), or from there up to the offset ``upto``; the filter reaches the scan."""
    return table.where((file_id == at[0]) & (block_id == at[1]) & (offset == at[2] if upto is None else offset.between(at[2], upto)))


def multi_get(table: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """The rows of ``table`` whose key is among the probes."""
    wanted = probes.select(F.col(f"`{probe}`").alias("__probe"))
    return table.join(wanted, table[f"`{key}`"] == wanted["__probe"], "left_semi")


def probe(table: DataFrame, key: str, probes: DataFrame, probe_key: str, columns: list[str]) -> DataFrame:
    """Every probe with ``found`` and the columns of its row in ``table`` (a table of one row per key); NULL keys are misses."""
    right = table.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`").alias(c) for c in columns])
    joined = probes.join(right, probes[f"`{probe_key}`"] == right["__key"], "left")
    return joined.withColumn("found", F.col("__key").isNotNull()).drop("__key")


def exists(probes: DataFrame, probe_key: str, table: DataFrame, key: str) -> DataFrame:
    """The probes whose key is in the table."""
    return multi_get(probes, probe_key, table, key)


def delete(table: DataFrame, key: str, doomed: DataFrame, doomed_key: str) -> DataFrame:
    """The rows whose key isn't among the doomed ones."""
    gone = doomed.select(F.col(f"`{doomed_key}`").alias("__gone"))
    return table.join(gone, table[f"`{key}`"] == gone["__gone"], "left_anti")


def delete_range(table: DataFrame, key: Column, low: Column, high: Column) -> DataFrame:
    """The rows whose key isn't in [low, high); NULL bounds are open."""
    from siltbed.functions.keys import compare_range

    return table.where(F.coalesce(compare_range(key, low, high) != 0, F.lit(True)))


def invalid_keys(log: DataFrame, key: str) -> DataFrame:
    """The rows whose key can't be stored: NULL, empty or longer than 64 bytes."""
    return log.where(~valid_key(F.col(f"`{key}`").cast("binary")))
