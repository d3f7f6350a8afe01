"""Streams of writes kept as runs: every micro-batch becomes one level-0 run, and runs are compacted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltbed.operators.log import latest
from siltbed.operators.merge import LEVEL0_FILES
from siltbed.sources import storage


class UpsertSink:
    """Latest row per key of a stream, under ``home`` on shared storage.

    Layout: ``runs/<tier>.<first>-<last>``, the rows of the batches ``first`` to ``last``,
    and ``checkpoint``. A micro-batch first shrinks to one row per key and is written under
    its own number, so a batch that is repeated after a failure replaces itself. When a
    tier has more than ``runs_max`` runs they become one run of the next tier, so a row is
    written again only as often as there are tiers. Runs that a wider one has replaced are
    removed by the next compaction; until then readers that began before can go on. Late
    rows need no watermark: the order column decides, not the arrival. State is files, not
    executor memory.
    """

    def __init__(self, spark: SparkSession, home: str, key: str, order: list[str], deleted: str | None = None, runs_max: int = LEVEL0_FILES):
        self.spark, self.home, self.key, self.order, self.deleted, self.runs_max = spark, home.rstrip("/"), key, order, deleted, runs_max

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.home}/checkpoint")
        return writer.trigger(**trigger).start()

    def apply(self, batch: DataFrame, number: int) -> None:
        if any(tier and first <= number <= last for tier, first, last in self._runs()[0]):
            return
        self._write(latest(batch, self.key, self.order), (0, number, number))
        self.compact()

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        name = "{}.{:012d}-{:012d}".format(*run)
        rows.write.mode("overwrite").parquet(f"{self.home}/_staged/{name}")
        storage.delete(self.spark, f"{self.home}/runs/{name}")
        storage.publish(self.spark, f"{self.home}/_staged/{name}", f"{self.home}/runs/{name}")

    def _runs(self) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(live, replaced) runs in order of their batches; a run is replaced by one of a higher tier that has its batches."""
        names = (re.fullmatch(r"(\d+)\.(\d+)-(\d+)", n) for n in storage.children(self.spark, f"{self.home}/runs"))
        found = sorted((tuple(map(int, n.groups())) for n in names if n), key=lambda r: (r[1], -r[0]))
        replaced = [r for r in found if any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        return [r for r in found if r not in replaced], replaced

    def _read(self, runs: list[tuple[int, int, int]]) -> DataFrame | None:
        return self.spark.read.parquet(*["{}/runs/{}.{:012d}-{:012d}".format(self.home, *r) for r in runs]) if runs else None

    def compact(self, everything: bool = False) -> None:
        """Merge tiers that have too many runs; deletes stay, so that late older writes lose to them."""
        live, replaced = self._runs()
        full = {tier for tier, _, _ in live if sum(r[0] == tier for r in live) > self.runs_max}
        if not full and not (everything and len(live) > 1):
            return
        for run in replaced:
            storage.delete(self.spark, "{}/runs/{}.{:012d}-{:012d}".format(self.home, *run))
        tier = max(r[0] for r in live) if everything else min(full)
        picked = live if everything else [r for r in live if r[0] == tier]
        self._write(latest(self._read(picked), self.key, self.order), (tier + 1, min(r[1] for r in picked), max(r[2] for r in picked)))
        self.compact()

    def table(self) -> DataFrame | None:
        """The present state; None before the first batch."""
        rows = self._read(self._runs()[0])
        return None if rows is None else latest(rows, self.key, self.order, self.deleted)
