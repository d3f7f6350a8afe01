"""How records lie in blocks and files, and how key space is split."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.keys import RING_BITS, ring_bucket, shortlex, shortlex_sort, sub_bucket
from siltbed.functions.record import RESTART_EVERY, RESTARTS_MAX
from siltbed.operators.cursor import locate, placed, ranked
from siltbed.session import cut, join_small

#: What a block of a sorted file can hold of records.
USABLE_BYTES = 65_520
SPLIT_LIMIT, SPLIT_LEVELS = 1000, 5


#: Below so many bytes of input, as the planner estimates them, no file can be too much for one task.
PLAIN_BYTES = 1 << 30


def assign_blocks(records: DataFrame, group: list[str], order: list[Column], size: Column, capacity: int = USABLE_BYTES, start: tuple[int, int] = (0, 0), hot_rows: int = 5_000_000, plain_bytes: int = PLAIN_BYTES) -> DataFrame:
    """``records`` with ``block_id`` (from 0) and ``offset`` in the order of their file.

    Records are put into the current block while there is room and never straddle two; a
    record larger than a block has one of its own. Files (``group``) are independent; each
    goes on from ``start``, a block and the bytes used of it. ``order`` should be total.

    Files of up to ``hot_rows`` records are walked over by one task each, which holds only
    the block under way. If one is larger (they are counted, unless the input is small
    anyway), the records are cut into stretches that all tasks share: each stretch is first
    reduced to a table of what it does to any state it may begin in, the tables are chained
    along every file, and then all stretches are walked over side by side.
    """
    sized = records.withColumn("__size", F.coalesce(size.cast("bigint"), F.lit(0))).withColumn("__file", F.xxhash64(*[F.col(f"`{g}`") for g in group]) if group else F.lit(0).cast("bigint"))
    keep = len(records.columns)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields], "block_id bigint", "offset bigint"])
    estimate = int(str(records._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < plain_bytes or sized.groupBy("__file").count().where(F.col("count") > hot_rows).isEmpty():
        laid = sized.withColumns({"__block": F.lit(start[0]).cast("bigint"), "__used": F.lit(start[1]).cast("bigint")})
        laid = (laid.repartition("__file") if group else laid.coalesce(1)).sortWithinPartitions("__file", *order)
        return laid.mapInArrow(_walker(keep, capacity), schema)
    at = placed(sized, [F.col("__file").asc(), *order])
    stretch = at.select("__file", "__task", "__row", "__size").repartition("__task").sortWithinPartitions("__task", "__row")
    tables = stretch.mapInArrow(_tabulate(capacity), _TABLE).repartition("__file").sortWithinPartitions("__file", "__task")
    begins = cut(tables.mapInArrow(_chain(capacity, start), "__file bigint, __task int, __block bigint, __used bigint"))
    joined = join_small(at, begins, ["__file", "__task"], "inner").repartition("__task").sortWithinPartitions("__task", "__row")
    return joined.select(*[F.col(f"`{c}`") for c in records.columns], "__size", F.xxhash64("__file", "__task").alias("__file"), "__block", "__used").mapInArrow(_walker(keep, capacity), schema)


def _walker(keep: int, capacity: int):
    """Blocks and offsets of records that come in order; those of one stretch say where it begins."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, used = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(keep).to_numpy()
            files = batch.column(keep + 1).to_numpy()
            ends = np.cumsum(sizes)
            borders = [*np.flatnonzero(np.diff(files)) + 1, len(files)]
            blocks, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            at = 0
            for border in borders:
                if files[at] != current:
                    current, block, used = files[at], batch.column(keep + 2)[at].as_py(), batch.column(keep + 3)[at].as_py()
                while at < border:
                    base = int(ends[at] - sizes[at])
                    fits = min(int(np.searchsorted(ends, base + capacity - used, side="right")), border)
                    if fits <= at:
                        if used:
                            block, used = block + 1, 0
                            continue
                        fits = at + 1
                    blocks[at:fits] = block
                    offsets[at:fits] = used + ends[at:fits] - sizes[at:fits] - base
                    used += int(ends[fits - 1]) - base
                    at = fits
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(blocks), pa.array(offsets)], names=[*batch.schema.names[:keep], "block_id", "offset"])

    return walk


#: A stretch from the state "used bytes": with room for fewer than ``upto[i]`` bytes it breaks first at record i, and then
#: begins ``blocks[i]`` blocks in all and leaves ``ends[i]`` bytes used; the ``fresh`` ones are for a block not begun.
_TABLE = "__file bigint, __task int, total bigint, fresh_blocks bigint, fresh_end bigint, upto array<bigint>, blocks array<bigint>, ends array<bigint>"


def _tabulate(capacity: int):
    def table(file: int, task: int, sizes: np.ndarray) -> tuple:
        n, ends = len(sizes), np.cumsum(sizes)
        # Where the block that begins with a record breaks: the record itself always fits.
        following = np.maximum(np.searchsorted(ends, ends - sizes + capacity, side="right"), np.arange(n) + 1)
        blocks, left = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
        blocks[n] = 0
        jumps = following.tolist()
        for i in range(n - 1, -1, -1):
            j = jumps[i]
            blocks[i] = 1 + blocks[j]
            left[i] = left[j] if j < n else ends[-1] - ends[i] + sizes[i]
        first = np.flatnonzero(ends <= capacity)[-1:] + 1
        last = int(first[0]) if len(first) else 0
        picked = np.arange(min(last + 1, n))
        return file, task, int(ends[-1]), int(blocks[0]) - 1, int(left[0]), ends[picked].tolist(), blocks[picked].tolist(), left[picked].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sizes, out = None, [], []

        def flush() -> None:
            if current is not None:
                out.append(table(*current, np.concatenate(sizes)))

        for batch in batches:
            file, task = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            borders = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(task) != 0)) + 1).tolist(), len(file)] if len(file) else []
            for a, b in zip(borders, borders[1:], strict=False):
                if (int(file[a]), int(task[a])) != current:
                    flush()
                    current, sizes = (int(file[a]), int(task[a])), []
                sizes.append(batch.column(3).to_numpy()[a:b])
        flush()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        names = ["__file", "__task", "total", "fresh_blocks", "fresh_end", "upto", "blocks", "ends"]
        for one in out:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names=names)

    return run


def _chain(capacity: int, start: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, used = None, 0, 0
        for batch in batches:
            begins = []
            for row in batch.to_pylist():
                if row["__file"] != current:
                    current, (block, used) = row["__file"], start
                begins.append((block, used))
                if not used:
                    block, used = block + row["fresh_blocks"], row["fresh_end"]
                    continue
                at = bisect_right(row["upto"], capacity - used)
                if at == len(row["upto"]):
                    used += row["total"]  # all of it fits
                else:
                    block, used = block + row["blocks"][at], row["ends"][at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in zip(*begins, strict=True)]] if begins else [batch.column(0), batch.column(1), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["__file", "__task", "__block", "__used"])

    return run


def fixed_blocks(rows: DataFrame, position: Column, per_block: int, blocks_per_file: int) -> DataFrame:
    """``rows`` with ``file_id`` and ``block_id`` for records of one size, from their position (from 1)."""
    block = F.floor((position - 1) / per_block)
    return rows.withColumn("file_id", F.floor(block / blocks_per_file)).withColumn("block_id", block)


def block_counts(packed: DataFrame, by: list[str], block: str) -> DataFrame:
    """How many different blocks each file has."""
    return packed.groupBy(*by).agg(F.countDistinct(block).alias("blocks"))


def free_space(packed: DataFrame, by: list[str], size: str, blocks_max: int, capacity: int = USABLE_BYTES) -> DataFrame:
    """What a file can still take: the room in its last block and the blocks it hasn't begun (``packed`` as by ``assign_blocks``)."""
    end = F.col("offset") + F.col(f"`{size}`")
    last = packed.groupBy(*by).agg(F.max(F.struct("block_id", end.alias("used"))).alias("__last"))
    room = F.greatest(F.lit(capacity) - F.col("__last.used"), F.lit(0)) + F.greatest(F.lit(blocks_max - 1) - F.col("__last.block_id"), F.lit(0)) * capacity
    return last.select(*by, room.alias("room"))


def restart_points(rows: DataFrame, row_in_block: Column, most: int | None = RESTARTS_MAX) -> DataFrame:
    """Every 16th row of a block (``row_in_block`` from 0) with ``restart_no``; at most ``most`` of a block, None for all."""
    wanted = row_in_block % RESTART_EVERY == 0
    if most is not None:
        wanted &= row_in_block < RESTART_EVERY * most
    return rows.where(wanted).withColumn("restart_no", F.floor(row_in_block / RESTART_EVERY))


def seek_restart(probes: DataFrame, key: str, points: DataFrame, point_key: str) -> DataFrame:
    """Every probe with ``restart``: the columns of the last restart point whose key is below it, where a linear search begins.

    A probe at or below the first point has that of no point (NULL): its search begins at
    the first row. The points' keys must be different.
    """
    ranges = points.select(F.col(f"`{point_key}`").alias("low"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("restart"))
    return locate(probes, key, ranges, "low", None, "restart", strict=True)


def key_ranges(rows: DataFrame, by: list[str], key: str, more: list[Column] | None = None) -> DataFrame:
    """Smallest and largest key and number of rows of every file or block, and ``more`` aggregates."""
    order = shortlex(F.col(f"`{key}`"))
    out = rows.groupBy(*by).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"), F.count(F.lit(1)).alias("records"), *(more or []))
    return out.select(F.col("__lo.k").alias("min_key"), F.col("__hi.k").alias("max_key"), *[F.col(f"`{c}`") for c in out.columns if c not in {"__lo", "__hi"}])


def contiguous(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Ranges and whether each begins where the one before, in order of their lower bound, ends; the first does.

    Laid out by ranges of the bound; a task takes over the end of the task before it.
    """
    at = placed(ranges, shortlex_sort(F.col(f"`{low}`")))
    w = Window.partitionBy("__task").orderBy("__row")
    lasts = at.groupBy("__task").agg(F.max_by(F.struct(F.col(f"`{high}`").alias("h")), "__row").alias("__end"))
    carried = lasts.select(F.col("__task").alias("__t"), F.lag("__end").over(Window.orderBy("__task")).alias("__carried"))
    joined = at.withColumn("__above", F.lag(F.struct(F.col(f"`{high}`").alias("h"))).over(w)).join(F.broadcast(carried), F.col("__task") == F.col("__t"))
    above = F.coalesce("__above", "__carried")
    follows = F.when(above.isNull(), True).otherwise(F.coalesce(above["h"] == F.col(f"`{low}`"), F.lit(False)))
    return joined.select(*[F.col(f"`{c}`") for c in ranges.columns], follows.alias("contiguous"))


def median_split(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Of every group the key at which it is split in two: the one at position n // 2 + 1.

    All groups are laid out by ranges of (group, key), so a large one is spread over tasks.
    """
    by = by or []
    picked = rows.select(*[F.col(f"`{g}`") for g in by], F.col(f"`{key}`").alias("key"))
    at = ranked(picked, [*[F.col(f"`{g}`").asc() for g in by], *shortlex_sort(F.col("key"))], "__position")
    groups = at.groupBy(*by).agg(F.min("__position").alias("__first"), F.count(F.lit(1)).alias("records"))
    middle = groups.where("records > 0").select(*by, "records", (F.col("__first") + F.floor(F.col("records") / 2)).alias("__middle"))
    found = at.select(F.col("__position").alias("__middle"), "key").join(middle, "__middle")
    return found.select(*by, "key", "records")


def hash_split(hashes: DataFrame, h: str, limit: int = SPLIT_LIMIT, step: int = SPLIT_LEVELS) -> DataFrame:
    """(bucket, level, records, largest): how often each ring bucket must be halved until no part has ``limit`` entries.

    Counted ``step`` levels at a time at the finest of them with partial sums, and rolled
    up from there; only buckets that are still too large are looked at again, down to the
    last of the 52 bits below the ring's. A bucket of equal hashes ends there, and
    ``largest`` tells.
    """
    bits, done, at = 64 - RING_BITS, None, 0
    rows = hashes.select(ring_bucket(F.col(h)).alias("bucket"), F.col(h).alias("h"))
    while True:
        upto = min(at + step, bits)
        fine = rows.groupBy("bucket", sub_bucket(F.col("h"), upto).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        each = fine.select("bucket", "part", "n", F.explode(F.sequence(F.lit(at), F.lit(upto))).alias("level"))
        parts = each.groupBy("bucket", "level", F.call_function("shiftright", F.col("part"), F.lit(upto) - F.col("level")).alias("part")).agg(F.sum("n").alias("n"))
        sizes = parts.groupBy("bucket", "level").agg(F.max("n").alias("largest"), F.sum("n").alias("records"))
        fits = F.when((F.col("largest") < limit) | (F.col("level") == bits), F.col("level"))
        found = cut(sizes.groupBy("bucket").agg(F.min(fits).alias("level"), F.max("records").alias("records"), F.min_by("largest", fits).alias("largest")))
        decided = found.where("level IS NOT NULL")
        done = decided if done is None else done.unionByName(decided)
        left = found.where("level IS NULL").select("bucket")
        if left.isEmpty():
            return done
        rows, at = join_small(rows, left, ["bucket"], "left_semi"), upto + 1


def split_parts(hashes: DataFrame, h: str, splits: DataFrame) -> DataFrame:
    """``hashes`` with ``bucket``, ``level`` and ``part``: every split sends the half with the next bit set to a new part."""
    rows = hashes.withColumn("bucket", ring_bucket(F.col(f"`{h}`")))
    joined = join_small(rows, splits.select("bucket", "level"), ["bucket"], "inner")
    return joined.withColumn("part", sub_bucket(F.col(f"`{h}`"), F.col("level")))
