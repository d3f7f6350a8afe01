"""What an LRU cache would have hit in a trace of accesses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import cut

ACCESS, CACHED = 1, 0


def lru_trace(trace: DataFrame, key: str, order: str, capacity: int, chunks: int | None = None) -> DataFrame:
    """``trace`` with ``hit``: whether the key was among the ``capacity`` last used ones.

    ``order`` is a unique number per access; rows without it or without a key are no
    accesses and are left out. The trace is cut into ``chunks`` by order. What the cache
    holds before a chunk are the ``capacity`` keys used last in the chunks before: each
    chunk is first reduced to those, and these lists are merged along the chunks in
    log(chunks) rounds. Then all chunks are replayed side by side, each from its own state,
    so the result is exact and no task holds more than one cache.
    """
    spark = trace.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = trace.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{order}`").isNotNull())
    cuts = [i / chunks for i in range(1, chunks)]
    borders = (rows.agg(F.percentile_approx(f"`{order}`", cuts, 10_000).alias("b")).first().b or []) if cuts else []
    number = F.lit(0)
    for border in sorted(set(borders)):
        number = number + F.when(F.col(f"`{order}`") > border, 1).otherwise(0)
    at = rows.withColumn("__chunk", number)
    newest = Window.partitionBy("__chunk").orderBy(F.desc("__last"))

    def kept(state: DataFrame) -> DataFrame:
        merged = state.groupBy("__chunk", "__key").agg(F.max("__last").alias("__last"))
        return merged.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= capacity).drop("__n")

    # Lists at the end of a chunk, seen as states before the next.
    state = kept(at.select((F.col("__chunk") + 1).alias("__chunk"), F.col(f"`{key}`").alias("__key"), F.col(f"`{order}`").alias("__last")))
    reach = 1
    while reach < len(set(borders)):
        state = cut(kept(state.unionByName(state.withColumn("__chunk", F.col("__chunk") + reach)).where(F.col("__chunk") <= len(set(borders)))))
        reach *= 2
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in trace.schema.fields]
    cached = state.select(*blank, "__chunk", F.lit(CACHED).alias("__kind"), F.col("__key").cast("string").alias("__k"), F.col("__last").alias("__at"))
    accesses = at.select(*[F.col(f"`{c}`") for c in trace.columns], "__chunk", F.lit(ACCESS).alias("__kind"), F.col(f"`{key}`").cast("string").alias("__k"), F.col(f"`{order}`").alias("__at"))
    laid = cached.unionByName(accesses).repartition("__chunk").sortWithinPartitions("__chunk", "__kind", "__at")
    keep = len(trace.columns)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cache = None, OrderedDict()
        for batch in batches:
            hits = []
            columns = (batch.column(i).to_pylist() for i in (keep, keep + 1, keep + 2))
            for chunk, kind, name in zip(*columns, strict=True):
                if chunk != current:
                    current, cache = chunk, OrderedDict()
                hits.append(name in cache if kind == ACCESS else None)
                cache[name] = None
                cache.move_to_end(name)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            out = pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(hits, pa.bool_())], names=[*batch.schema.names[:keep], "hit"])
            yield out.filter(pc.is_valid(out.column(keep)))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in trace.schema.fields], "hit boolean"])
    return laid.mapInArrow(replay, schema)
