"""Applying a feed of inserts, updates and deletes in sequence order.

``replay`` rebuilds the state of a table: change rows are laid out by key and sequence,
and one state machine walks over every key in order. It keeps one row of state, whatever
the length of a key's history, so a task's memory doesn't depend on the data. A hot key is
first split over several tasks by ranges of its sequence; each leaves one row that stands
for its stretch, and these few rows are walked over again in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = 0, 1, 2


def present_records(deliveries: DataFrame, identity: list[str], received: list[Column], payload: list[Column]) -> DataFrame:
    """The last delivery of each record: one row per ``identity`` with the ``payload`` columns.

    Repeated deliveries shrink to one per task before the shuffle. Equal times: the larger
    payload, so that the result doesn't depend on the order of rows.
    """
    packed = F.struct(*payload)
    rows = deliveries.select(*[F.col(f"`{c}`") for c in identity], packed.alias("__p"), F.struct(*received, packed).alias("__o"))
    return rows.groupBy(*identity).agg(F.max_by("__p", "__o").alias("__p")).select(*identity, "__p.*")


def replay(changes: DataFrame, keys: list[str], seq: str, op: Column, columns: list[str], state: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """State after all changes: one row (keys, seq, live, columns) for every key ever touched.

    ``op`` gives INSERT (a whole row: columns that are NULL become NULL), UPDATE (a partial
    row: NULL means untouched) or DELETE; rows with another or no op, or without a sequence,
    aren't changes and are left out. Order is by ``seq`` alone. Of several changes with one
    key and sequence the first by (op, hash of its columns) counts and the rest are skipped
    as already applied. An update after a delete, or of a key that never was, starts a new
    row with just its own columns. A key whose last change is a delete comes out with
    ``live`` false. NULL parts of a key are ordinary values. ``state`` is an earlier result
    of this function: its sequences count as applied and older changes are skipped. Other
    columns are dropped. No changes: no rows.
    """
    spark = changes.sparkSession
    picked = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    values = [F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(columns)]
    rows = changes.select(*picked, F.col(f"`{seq}`").cast("bigint").alias("__seq"), op.cast("tinyint").alias("__op"), F.lit(1).alias("__new"), *values)
    rows = rows.where(F.col("__op").between(INSERT, DELETE) & F.col("__seq").isNotNull())
    if state is not None:
        applied = F.when(F.col("live"), INSERT).otherwise(DELETE).cast("tinyint")
        rows = rows.unionByName(state.select(*picked, F.col(f"`{seq}`").alias("__seq"), applied.alias("__op"), F.lit(0).alias("__new"), *values))
    names = [f"__k{i}" for i in range(len(keys))]
    order = [*names, "__seq"]
    if columns:
        rows = rows.withColumn("__tie", F.xxhash64(*[f"__v{i}" for i in range(len(columns))]))
    ties = ["__new", "__op", *(["__tie"] if columns else [])]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = [*names, "__seq", "__op", *[f"__v{i}" for i in range(len(columns))]]
    walk = _walker(len(keys))
    stretches = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, *ties).select(*shape)
    folded = stretches.mapInArrow(walk, stretches.schema)
    whole = folded.repartition(*names).sortWithinPartitions(*order)
    out = whole.mapInArrow(walk, stretches.schema)
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
        F.col("__seq").alias(seq),
        (F.col("__op") != DELETE).alias("live"),
        *[F.when(F.col("__op") != DELETE, F.col(f"__v{i}")).alias(c) for i, c in enumerate(columns)],
    )


def _walker(n_keys: int):
    """The state machine over rows (keys, seq, op, values) that come sorted by key and sequence."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if carried is not None:
                rows = pa.concat_tables([carried.cast(rows.schema), rows]).combine_chunks()
            folded = _fold(rows, n_keys)
            carried = folded.slice(folded.num_rows - 1)
            yield from folded.slice(0, folded.num_rows - 1).to_batches()
        if carried is not None:
            yield from carried.to_batches()

    return walk


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """For every row but the first: is its value another than the one above? NULL equals NULL."""
    flat = column.combine_chunks()
    above, here = flat.slice(0, len(flat) - 1), flat.slice(1)
    unequal = pc.fill_null(pc.not_equal(above, here), False)
    return pc.or_(unequal, pc.xor(pc.is_null(above), pc.is_null(here))).to_numpy(zero_copy_only=False)


def _fold(rows: pa.Table, n_keys: int) -> pa.Table:
    """One row per key that has the effect of all its rows, with the last sequence."""
    n = rows.num_rows
    fresh = np.ones(n, bool)
    fresh[1:] = False
    for i in range(n_keys):
        fresh[1:] |= _differs(rows.column(i))
    sequence = rows.column(n_keys).to_numpy()
    applied = np.zeros(n, bool)
    applied[1:] = ~fresh[1:] & (sequence[1:] == sequence[:-1])
    if applied.any():
        keep = np.flatnonzero(~applied)
        rows, fresh, sequence = rows.take(pa.array(keep)), fresh[keep], sequence[keep]
        n = len(keep)
    at = np.arange(n)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n) - 1
    op = rows.column(n_keys + 1).to_numpy()
    reset = np.maximum.reduceat(np.where(op != UPDATE, at, -1), starts)
    patched = np.maximum.reduceat(np.where(op == UPDATE, at, -1), starts)
    result = np.where(reset < 0, UPDATE, np.where((op[np.maximum(reset, 0)] == DELETE) & (patched < reset), DELETE, INSERT)).astype(np.int8)
    floor = np.repeat(np.maximum(reset, starts), np.diff(np.append(starts, n)))
    out = [rows.column(i).take(pa.array(ends)) for i in range(n_keys + 1)] + [pa.chunked_array([pa.array(result)])]
    for i in range(n_keys + 2, rows.num_columns):
        column = rows.column(i)
        touched = (op == INSERT) | ((op == UPDATE) & pc.is_valid(column).to_numpy())
        last = np.maximum.reduceat(np.where(touched & (at >= floor), at, -1), starts)
        out.append(column.take(pa.array(np.where(last < 0, 0, last), mask=last < 0)))
    return pa.table(out, schema=rows.schema)


def wal_changes(wal: DataFrame, with_value: bool = True) -> DataFrame:
    """(db_name, lsn, kind, key[, value]): the present content of every Put and Delete record.

    Deliveries that aren't whole are ignored. The type is that of the last whole delivery.
    A record whose payload holds no key of 1 to 64 bytes changes nothing and is left out.
    """
    from siltbed.functions.wal import DELETE as DEL
    from siltbed.functions.wal import PUT, payload_key, payload_value, record_type, whole

    complete = wal.where(whole(F.col("log_data"), F.col("log_size")))
    payload = [record_type(F.col("log_type")).alias("kind"), payload_key(F.col("log_data")).alias("key")]
    if with_value:
        payload.append(payload_value(F.col("log_data")).alias("value"))
    records = present_records(complete, ["db_name", "lsn"], [F.col("received_at")], payload)
    return records.where(F.col("kind").isin(PUT, DEL) & F.col("key").isNotNull())


def live_keys(wal: DataFrame, with_value: bool = True) -> DataFrame:
    """(db_name, key, lsn[, value]) of the keys that the log leaves alive."""
    changes = wal_changes(wal, with_value)
    op = F.when(F.col("kind") == "put", INSERT).otherwise(DELETE)
    return replay(changes, ["db_name", "key"], "lsn", op, ["value"] if with_value else []).where("live").drop("live")


#: Values of this many bytes and more are long ones.
LONG_BYTES = 32


def partial_state(wal: DataFrame) -> DataFrame:
    """(db_name, key, lsn, value, short_lsn, long_lsn) of the live keys, every Put taken for a partial update.

    A Put sets the value, and where it was last written short or long, only as far as it
    carries them: an empty value leaves the one before untouched, and a short value leaves
    the place of the last long one. A Delete ends all of them.
    """
    changes = wal_changes(wal)
    n = F.octet_length("value")
    said = changes.select("db_name", "lsn", "kind", "key", F.when(n > 0, F.col("value")).alias("value"), F.when((n > 0) & (n < LONG_BYTES), F.col("lsn")).alias("short_lsn"), F.when(n >= LONG_BYTES, F.col("lsn")).alias("long_lsn"))
    op = F.when(F.col("kind") == "put", UPDATE).otherwise(DELETE)
    return replay(said, ["db_name", "key"], "lsn", op, ["value", "short_lsn", "long_lsn"]).where("live").drop("live")
