"""Filling containers of a fixed number of tokens with texts of varying length.

Best-fit decreasing: in decreasing length every text goes into the open container with the
least free room that still holds it. A segment tree over the remaining capacities, from 0
to the full capacity, finds that room in logarithmic time. Containers are opened when no
open one fits; a text is cut only if it alone exceeds the capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.binpack import pack_in_rounds

#: Where the session sets no other (``siltbed.tokenizer``).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the public rank files.
TOKENIZER_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Bits of the chunk number in each round of packing.
ROUNDS = (12, 0)


class TightestFit:
    """Open containers by free room; ``place`` gives the number of the container an item goes to."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def tightest(self, size: int) -> int | None:
        """The least free room of ``size`` or more that an open container has."""
        filled, node = self.filled, self.leaves + size
        if filled[node]:
            return size
        while node > 1:
            if not node & 1 and filled[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not filled[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, size: int) -> int:
        room = self.tightest(size)
        if room is None:
            room, number = self.capacity, self.containers
            self.containers += 1
        else:
            here = self.open[room]
            number = here.pop()
            if not here:
                self._mark(room, 0)
        left = room - size
        here = self.open[left]
        here.append(number)
        if len(here) == 1:
            self._mark(left, 1)
        return number

    def _mark(self, room: int, value: int) -> None:
        filled, node = self.filled, self.leaves + room
        filled[node] = value
        while node > 1:
            node >>= 1
            above = filled[2 * node] | filled[2 * node + 1]
            if filled[node] == above:
                break
            filled[node] = above


def token_counts(documents: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, pattern: str = TOKENIZER_PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row; a NULL text has 0 tokens. ``tokenizer`` is a rank file all executors can read."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("siltbed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(value.as_py() or "")) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    return documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(count, f"id {kind}, n_tokens bigint").select(F.col("id").alias(doc_id), "n_tokens")


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(item, piece, start_at, size, container): every item in exactly one container, or cut into pieces.

    An item of at most ``capacity`` is one piece. A longer one is cut into pieces of the
    full capacity and a rest, ``start_at`` telling where each begins. Sizes that are NULL
    or negative count as 0 and still take a place. Every row is an item, repeated rows and
    NULL items too. Other columns are dropped; no rows: no containers.

    The pieces are packed in ``rounds`` (see ``binpack``): by hash in a number of chunks
    that doesn't depend on how many there are, and the worst filled containers of every
    chunk once more together, down to a single chunk. A task holds one chunk's pieces, a
    4,096th of all by default, and the waste doesn't depend on the number of chunks.
    """
    sized = items.select(F.col(f"`{item}`").alias("item"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = sized.select("item", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)))).alias("piece"))
    pieces = pieces.select("item", "piece", (F.col("piece") * capacity).alias("start_at"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("size"))
    packed = pack_in_rounds(pieces, [], ["item", "piece"], "size", lambda: TightestFit(capacity), capacity, rounds)
    return packed.select(F.col("item").alias(item), "piece", "start_at", F.col("size").alias(size), F.col("bin").alias("container"))


def containers(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(doc_id, piece, start_at, n_tokens, container) of all texts, measured with a public tokenizer.

    ``tokenizer`` is a rank file; without it the session's setting ``siltbed.tokenizer`` names it.
    """
    path = tokenizer or documents.sparkSession.conf.get("siltbed.tokenizer", TOKENIZER)
    return pack(token_counts(documents, doc_id, text, path), doc_id, "n_tokens", capacity, rounds)
