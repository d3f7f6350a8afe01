"""Packing any number of items into bins, in chunks that don't depend on how many items there are.

Every packing rule here is sequential: an item's bin depends on all larger items. So the
items are spread by hash over a fixed number of chunks, and each chunk is packed by one
task. The worst filled bins of every chunk are opened again and their items are packed
together in the next round, with fewer chunks, down to a single one. One more item changes
its own chunk and what that hands on, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.session import cut

#: Bins that a chunk hands on to the next round at most.
CARRY = 64


class Bins(Protocol):
    def place(self, size: int) -> int: ...


def pack_in_rounds(items: DataFrame, group: list[str], by: list[str], size: str, opened: Callable[[], Bins], capacity: int, rounds: tuple[int, ...], carry: int = CARRY) -> DataFrame:
    """``items`` with ``bin`` (BIGINT, unique within its group): every row in exactly one bin.

    ``rounds`` are the bits of the chunk number in each round, falling to 0. Items come to
    ``opened()`` in decreasing size, ties in the order of ``by``. A task holds the rows of
    one chunk. Which bins are handed on is a matter of quality only; every bin that isn't
    is final. Bins of a group never mix with those of another.
    """
    columns, out, waiting = items.columns, None, items
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    for number, bits in enumerate(rounds):
        last = number == len(rounds) - 1
        chunk = F.xxhash64(*[F.col(f"`{c}`") for c in by]).bitwiseAND(F.lit((1 << bits) - 1))
        key = [*[F.col(f"`{g}`") for g in group], F.col("__chunk")]
        laid = waiting.withColumn("__chunk", chunk).repartition(*key).sortWithinPartitions(*key, F.desc(size), *[F.col(f"`{c}`") for c in by])
        laid = laid.select(*[F.col(f"`{c}`") for c in columns], "__chunk", F.xxhash64(*key).alias("__at"))
        fill = _filler(columns.index(size), len(columns), opened, capacity, 0 if last else carry, number)
        packed = laid.mapInArrow(fill, f"{kinds}, bin bigint, __open boolean")
        if not last:
            packed = cut(packed)
        final = packed.where(~F.col("__open")).drop("__open")
        out = final if out is None else out.unionByName(final)
        waiting = packed.where("__open").select(*[F.col(f"`{c}`") for c in columns])
    return out


def _filler(size_at: int, width: int, opened: Callable[[], Bins], capacity: int, carry: int, number: int):
    def close(rows: list[pa.RecordBatch], sizes: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
        bins = opened()
        places = np.fromiter((bins.place(n) for n in sizes.tolist()), np.int64, len(sizes))
        filled = np.zeros(int(places.max()) + 1, np.int64)
        np.add.at(filled, places, sizes)
        again = np.zeros(len(filled), bool)
        if carry:
            low = np.flatnonzero(filled < capacity)
            again[low[np.argsort(filled[low], kind="stable")[:carry]]] = True
        label = places + ((number << 56) | (chunk << 40))
        at = 0
        for part in rows:
            upto = at + part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(label[at:upto]), pa.array(again[places[at:upto]])], names=[*part.schema.names[:width], "bin", "__open"])
            at = upto

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.concatenate([b.column(size_at).to_numpy() for b in held])
            yield from close(held, sizes, held[0].column(width)[0].as_py())

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(width + 1).to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for start, end in zip(borders, borders[1:], strict=False):
                if held and at[start] != current:
                    yield from flush()
                    held = []
                current = at[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield from flush()

    return fill
