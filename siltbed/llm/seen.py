"""Whether a key has occurred before, against a compact index of all earlier keys.

Keys are hashed to 64 bits (XXH64). The top bits name a shard; within a shard the sorted,
different hashes are cut into segments, and each segment is stored in Elias-Fano form: the
high bits of the offsets in unary, the low bits packed. That is about 2 + log2(gap) bits a
key, and a probe is answered by a successor search without decoding the segment. A new
batch of keys is merged in one pass over the sorted segments of each shard. Memory per task
is one segment and one Arrow batch.

A key is never taken for new if it has been seen. One that is new is taken for seen only if
another key has the same hash bits, with a probability of n / 2^bits for n earlier keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.keys import hash0, ring_bucket

SHARD_BITS = 12
SEGMENT_KEYS = 1024
INDEX_SCHEMA = "shard int, base bigint, n int, width int, low binary, high binary"
_COLUMNS = ["shard", "at", "kind", "n", "width", "low", "high", "tag"]
_SEGMENT, _PROBE = 0, 1


def key_hash(key: Column, bits: int = 64) -> Column:
    """The leading ``bits`` bits of the key's XXH64, the others 0; NULL for NULL."""
    full = hash0(key)
    return full if bits == 64 else F.shiftleft(F.shiftright(full, 64 - bits), 64 - bits)


# Elias-Fano, for one segment


def encode(offsets: np.ndarray) -> tuple[int, bytes, bytes]:
    """(width, low, high) of sorted, different uint64 offsets, of which there is one at least."""
    n, top = len(offsets), int(offsets[-1])
    width = max(0, (top // n).bit_length() - 1) if n else 0
    width = min(width, 56)
    low = offsets & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    highs = (offsets >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(highs[-1]) + n + 1, np.uint8)
    unary[highs + np.arange(n)] = 1
    return width, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes()


class Segment:
    """A segment opened for searches."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes):
        self.n, self.width = n, width
        self.low = np.frombuffer(low + bytes(8), np.uint8)
        unary = np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little")
        self.ones = np.flatnonzero(unary)[:n]
        zeros = np.flatnonzero(unary == 0)
        #: before[h]: how many offsets have a high part below h.
        last = int(self.ones[-1]) - (n - 1)
        self.last = last
        self.before = np.concatenate(([0], zeros[:last] - np.arange(last), [n]))

    def lows(self, index: np.ndarray) -> np.ndarray:
        """The low parts at these places: eight bytes from where each starts, shifted and masked."""
        if not self.width:
            return np.zeros(len(index), np.uint64)
        bit = index.astype(np.int64) * self.width
        window = self.low[(bit >> 3)[:, None] + np.arange(8)].astype(np.uint64)
        whole = (window << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
        return (whole >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        index = np.arange(self.n)
        return ((self.ones - index).astype(np.uint64) << np.uint64(self.width)) | self.lows(index)

    def successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each uint64 probe the smallest offset at or above it, and whether there is one."""
        high = np.minimum((probes >> np.uint64(self.width)).astype(np.int64), self.last + 1)
        low = probes & np.uint64((1 << self.width) - 1)
        left = self.before[np.minimum(high, self.last + 1)]
        right = self.before[np.minimum(high + 1, self.last + 1)]
        while True:
            open_ = left < right
            if not open_.any():
                break
            middle = (left + right) >> 1
            below = open_ & (self.lows(np.minimum(middle, self.n - 1)) < low)
            right = np.where(open_ & ~below, middle, right)
            left = np.where(below, middle + 1, left)
        there = left < self.n
        place = np.minimum(left, self.n - 1)
        found = ((self.ones[place] - place).astype(np.uint64) << np.uint64(self.width)) | self.lows(place)
        return found, there


def _segments(shard: int, hashes: np.ndarray) -> list[tuple]:
    out = []
    for i in range(0, len(hashes), SEGMENT_KEYS):
        piece = hashes[i : i + SEGMENT_KEYS]
        out.append((shard, int(piece[0]), len(piece), *encode((piece - piece[0]).astype(np.uint64))))
    return out


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "base", "n", "width", "low", "high"])


# Index


def empty_index(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], INDEX_SCHEMA)


def extend(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """The index with a batch of hashes (one BIGINT column) merged in.

    Repeated hashes and hashes already in the index count once; NULL isn't a key. The
    batch is made distinct with partial results per task before it is shuffled, so a hot
    key arrives once per task.
    """
    name = hashes.columns[0]
    new = hashes.select(F.col(f"`{name}`").alias("at")).where(F.col("at").isNotNull()).distinct()
    return _laid(index, new.withColumn("tag", F.lit(None).cast("bigint"))).mapInArrow(_merge, INDEX_SCHEMA)


def build(hashes: DataFrame) -> DataFrame:
    """An index of a column of hashes."""
    return extend(empty_index(hashes), hashes)


def _laid(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Segments and probes of a shard together, in order of hash, a segment before the probes at or above its base."""
    blank = {"n": "int", "width": "int", "low": "binary", "high": "binary"}
    segments = index.select("shard", F.col("base").alias("at"), F.lit(_SEGMENT).cast("tinyint").alias("kind"), *blank, F.lit(None).cast("bigint").alias("tag"))
    asked = probes.select(ring_bucket(F.col("at"), SHARD_BITS).alias("shard"), "at", F.lit(_PROBE).cast("tinyint").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], "tag")
    return segments.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "at", "kind", "tag").select(*_COLUMNS)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Stretches of a batch that start with a segment or a new shard."""
    shard = batch.column(0).to_numpy()
    kind = batch.column(2).to_numpy()
    cut = kind == _SEGMENT
    cut[0] = True
    cut[1:] |= shard[1:] != shard[:-1]
    starts = np.flatnonzero(cut)
    yield from zip(starts.tolist(), np.append(starts[1:], len(cut)).tolist(), strict=True)


def _opened(batch: pa.RecordBatch, row: int) -> Segment:
    return Segment(batch.column(3)[row].as_py(), batch.column(4)[row].as_py(), batch.column(5)[row].as_py(), batch.column(6)[row].as_py())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, waiting = None, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ready: list[tuple] = []
        at = batch.column(1).to_numpy()
        for start, end in _runs(batch):
            here = batch.column(0)[start].as_py()
            if here != shard:
                if len(waiting):
                    ready += _segments(shard, waiting)
                shard, waiting = here, np.empty(0, np.int64)
            if batch.column(2)[start].as_py() == _SEGMENT:
                # What waits is below this segment's base but for what the last segment holds above it.
                waiting = np.union1d(waiting, _opened(batch, start).all().astype(np.int64) + at[start])
                start += 1
            if start < end:
                waiting = np.union1d(waiting, at[start:end])
            # Everything below the last row's place is complete; whole segments of it can go.
            done = int(np.searchsorted(waiting, at[end - 1])) // SEGMENT_KEYS * SEGMENT_KEYS
            if done:
                ready += _segments(shard, waiting[:done])
                waiting = waiting[done:]
        if ready:
            yield _segment_batch(ready)
    if len(waiting):
        yield _segment_batch(_segments(shard, waiting))


def search(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(at, tag, seen) for probes (at BIGINT hash, tag BIGINT): is the hash in the index?"""
    return _laid(index, probes.select("at", "tag")).mapInArrow(_search, "at bigint, tag bigint, seen boolean")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, segment, base = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(1).to_numpy()
        seen = np.zeros(batch.num_rows, bool)
        for start, end in _runs(batch):
            here = batch.column(0)[start].as_py()
            if here != shard:
                shard, segment = here, None
            if batch.column(2)[start].as_py() == _SEGMENT:
                segment, base = _opened(batch, start), at[start]
                start += 1
            if start < end and segment is not None:
                asked = (at[start:end] - base).astype(np.uint64)
                found, there = segment.successor(asked)
                seen[start:end] = there & (found == asked)
        probe = pa.array(batch.column(2).to_numpy() == _PROBE)
        out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(7), pa.array(seen)], names=["at", "tag", "seen"])
        yield out.filter(probe)


# Streams of records


def seen_before(earlier: DataFrame | None, records: DataFrame, order: str, hashed: str, index: DataFrame | None = None) -> DataFrame:
    """The values of ``order`` of the records whose key occurred before, each once.

    "Before" is in ``earlier`` (a column of hashes), in ``index``, or in ``records`` with a
    smaller ``order``. Rows with one ``order`` are one record (repeats), which doesn't
    precede itself; should they differ in their hash, the smallest counts. A record with a
    NULL hash has no key and was not seen; a NULL ``order`` can't be placed and is left out.

    Each different hash of the records is searched once, tagged with the first record that
    has it; those it isn't found for are the first occurrences, and all other records have
    been seen. So a hot key is one probe, and its many records are never joined by the key.
    """
    if index is None:
        index = build(earlier)
    elif earlier is not None:
        index = extend(index, earlier)
    known = records.select(F.col(f"`{order}`").alias("tag"), F.col(f"`{hashed}`").alias("at")).where(F.col("tag").isNotNull() & F.col("at").isNotNull())
    known = known.groupBy("tag").agg(F.min("at").alias("at"))
    first = known.groupBy("at").agg(F.min("tag").alias("tag"))
    fresh = search(index, first).where(~F.col("seen")).select(F.col("tag").alias("__fresh"))
    return known.join(fresh, F.col("tag") == F.col("__fresh"), "left_anti").select(F.col("tag").alias(order))
