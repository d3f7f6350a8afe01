"""Evaluation texts that turn up in training texts.

A test item leaks into a document if a stretch of at least ``run`` consecutive words of it
occurs there. Every stretch of ``run`` words of every item is a pattern, and all patterns
are searched at once by Wu and Manber's method, over words as letters: a table of blocks
(pairs of words) tells how far the search may jump, since a block that is in no pattern can't
be inside an occurrence; where a block may end a pattern, the hash of the last ``run`` words
selects the few patterns that end so, and these are compared word by word.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm import mail_text
from siltbed.session import scratch
from siltbed.sources import storage

RUN_WORDS = 12
BLOCK_WORDS = 2
#: Items searched for in one pass over the documents, by the characters of their texts.
ITEMS_BLOCK_CHARS = 32_000_000


_BITS64 = (1 << 64) - 1
_BLOCK_FACTOR, _RUN_FACTOR = 1_000_003, 0x9E3779B97F4A7C15


class Patterns:
    """Shift table and suffix-hash buckets of all stretches of ``run`` words of the items (id, words).

    The shift table is a byte per hash of a block, as Wu and Manber's is; blocks with one
    hash share the smaller shift, which costs time and nothing else. The buckets are sorted
    arrays by the hash of the whole stretch, so one holds just the places of equal
    stretches, however often their last words occur. About 40 bytes per word of the items.
    """

    def __init__(self, items: list[tuple[object, list[str]]], run: int = RUN_WORDS):
        if run < BLOCK_WORDS:
            raise ValueError(f"a run of {run} words is shorter than a block")
        self.run = run
        lengths = np.array([len(words) if len(words) >= run else 0 for _, words in items], np.int64)
        self.words = [w for _, words in items if len(words) >= run for w in words]
        n = len(self.words)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), lengths)
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        code = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)
        self.mask = (1 << min(26, max(12, (8 * n).bit_length()))) - 1
        table = np.full(self.mask + 1, min(255, run - BLOCK_WORDS + 1), np.uint8)
        ends = np.flatnonzero(place > 0)
        if n:
            block = (code[ends - 1] * np.uint64(_BLOCK_FACTOR) ^ code[ends]) & np.uint64(self.mask)
            # The latest place in a stretch where this block can end.
            np.minimum.at(table, block.astype(np.int64), np.clip(run - 1 - place[ends], 0, 255).astype(np.uint8))
        self.shift = table.tobytes()
        starts = np.flatnonzero(place <= np.repeat(lengths, lengths) - run)
        stretch = np.zeros(len(starts), np.uint64)
        for i in range(run):
            stretch = stretch * np.uint64(_RUN_FACTOR) + code[starts + i]
        order = np.argsort(stretch, kind="stable")
        self.stretch, self.starts = stretch[order], starts[order]
        self.owner = owner[self.starts]

    def search(self, words: list[str]) -> set[int]:
        """Numbers of the items of which a stretch occurs in these words."""
        found: set[int] = set()
        compared: set[int] = set()
        run, shift, mask, codes, items = self.run, self.shift, self.mask, self.stretch, self.words
        at, n = run - 1, len(words)
        while at < n:
            jump = shift[(hash(words[at - 1]) * _BLOCK_FACTOR ^ hash(words[at])) & mask]
            if jump:
                at += jump
                continue
            window = words[at - run + 1 : at + 1]
            code = 0
            for word in window:
                code = (code * _RUN_FACTOR + hash(word)) & _BITS64
            bucket = int(np.searchsorted(codes, np.uint64(code)))
            if bucket not in compared and bucket < len(codes) and int(codes[bucket]) == code:
                whole = True
                last = int(np.searchsorted(codes, np.uint64(code), side="right"))
                for place in range(bucket, last):
                    start = int(self.starts[place])
                    if items[start : start + run] == window:
                        found.add(int(self.owner[place]))
                    else:
                        whole = False
                if whole:
                    compared.add(bucket)
            at += 1
        return found


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN_WORDS, texts_of: Callable[[str], list[str]] = mail_text.texts, block_chars: int = ITEMS_BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id), each pair once: some part of the document has ``run`` consecutive words of the item.

    Words are runs of letters and digits, whatever the case, punctuation, line breaks,
    encoding, markup, composition and invisible characters. ``texts_of`` gives the parts of
    a document; a stretch doesn't reach over two parts. Items with fewer than ``run`` words
    can't leak. NULL texts hold nothing; rows with a NULL document or item id that match
    come out with that NULL; repeated rows give one row. No items or no documents: no rows.

    The documents are read once for every ``block_chars`` characters of item texts or so,
    whole and where they lie: there is no shuffle but that of the pairs found. The items are
    written to the shared folder, and every worker process loads a block of them and builds
    its tables once, not per task; none of them goes through the driver.
    """
    spark = documents.sparkSession
    kinds = [documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t IS NOT NULL").distinct()
    shared = scratch(spark, "leak-items")
    chars = rows.agg(F.sum(F.length("t").cast("bigint"))).first()[0]
    blocks = max(1, -(-(chars or 0) // block_chars))
    rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(shared)
    out = spark.createDataFrame([], schema)
    picked = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    for name in storage.children(spark, shared):
        out = out.unionByName(picked.mapInArrow(_finder(f"{shared}/{name}", run, texts_of), schema))
    return out.distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))


def _loaded(path: str, run: int) -> tuple[Patterns, pa.Array]:
    """The tables of a block of items and the items' ids; a worker process keeps those it used last."""
    # Functions travel by value, so a process-wide memory must hang on something that outlives them.
    memory = sys.modules.setdefault("siltbed_worker_tables", types.ModuleType("siltbed_worker_tables")).__dict__
    if memory.get("key") != (path, run):
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow_fs

        memory.pop("tables", None)
        where, inner = arrow_fs.FileSystem.from_uri(path)
        block = pq.read_table(inner, filesystem=where, columns=["i", "t"], partitioning=None).combine_chunks()
        tables = Patterns([(None, mail_text.words(t)) for t in block.column("t").to_pylist()], run)
        memory["key"], memory["tables"] = (path, run), (tables, pa.concat_arrays(block.column("i").chunks) if block.num_rows else pa.array([]))
    return memory["tables"]


def _finder(path: str, run: int, texts_of: Callable[[str], list[str]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, ids = _loaded(path, run)
        for batch in batches:
            docs, found = [], []
            for place in range(batch.num_rows):
                text = batch.column(1)[place].as_py()
                hits: set[int] = set()
                for part in texts_of(text) if text else ():
                    hits |= patterns.search(mail_text.words(part))
                docs += [place] * len(hits)
                found += sorted(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), ids.take(pa.array(found, pa.int64()))], names=["doc_id", "item_id"])

    return find
