"""Session facts every operator needs: the shared folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting: there the driver and the executors are
    one process, so a temporary folder of this machine is shared. It is removed at exit.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "_local", None)
    if made is None:
        made = shared_dir._local = tempfile.mkdtemp(prefix="siltbed-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path of its own in the shared folder (nothing is created yet)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove what this process has written to the shared folder; results that still read it end."""
    from siltbed.sources import storage

    while _made:
        storage.delete(spark, _made.pop())


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written once to the shared folder and read from there.

    A table costs one computation of ``df`` (a checkpoint takes its last stage twice), is
    read by column, and tells the planner its size. Rows may come back in another order.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many plus one."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = 100_000, hot_rows: int = 1_000_000, salts: int = 64) -> DataFrame:
    """Join a table with a usually small one without gathering a hot key of ``big`` in one task.

    ``small`` is counted first. Up to ``rows`` rows of it are broadcast. Beyond that both
    sides are shuffled on the key, and keys with more than ``hot_rows`` rows in ``big``
    (found by a count with partial sums) are salted: their rows in ``big`` draw one of
    ``salts`` numbers by the hash of the whole row, their rows in ``small`` are repeated
    once per number, and all other keys stay as they are. Null keys are equal to null keys.
    ``how`` is inner, left, left_semi or left_anti.
    """
    names = {k: f"__js_{k}" for k in on}
    right = small.select([F.col(f"`{k}`").alias(v) for k, v in names.items()] + [F.col(f"`{c}`") for c in small.columns if c not in names])
    if within(small, rows):
        return _null_safe_join(big, F.broadcast(right), names, how).drop(*names.values())
    hot = big.groupBy(*[F.col(f"`{k}`") for k in on]).agg(F.count(F.lit(1)).alias("__js_n")).where(F.col("__js_n") > hot_rows)
    hot = hot.orderBy(F.desc("__js_n")).limit(rows)  # so many hot keys are spread well enough by their hash
    hot = hot.select(*[F.col(f"`{k}`").alias(f"__js_h{i}") for i, k in enumerate(on)], F.lit(True).alias("__js_hot"))
    hot = F.broadcast(hot)
    draw = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts))
    left = _null_safe_join(big, hot, {k: f"__js_h{i}" for i, k in enumerate(on)}, "left").withColumn("__js_salt", F.when(F.col("__js_hot"), draw).otherwise(0))
    left = left.select(*[F.col(f"`{c}`") for c in big.columns], "__js_salt")
    every = F.when(F.col("__js_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    spread = _null_safe_join(right, hot, {v: f"__js_h{i}" for i, v in enumerate(names.values())}, "left").withColumn("__js_right", F.explode(every))
    spread = spread.select(*[F.col(f"`{c}`") for c in right.columns], "__js_right")
    return _null_safe_join(left, spread, {**names, "__js_salt": "__js_right"}, how).drop(*names.values(), "__js_salt", "__js_right")


def _null_safe_join(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str) -> DataFrame:
    condition = None
    for a, b in pairs.items():
        one = left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
        condition = one if condition is None else condition & one
    return left.join(right, condition, how)
