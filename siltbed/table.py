"""A stored key-value table: puts and deletes as immutable sorted runs behind a manifest."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.status import InvalidKey, InvalidPath, NotFound
from siltbed.operators import cursor, layout, log, merge
from siltbed.sources import storage
from siltbed.sources.states import NumberedState

ORDER = ["version", "seq"]
SCHEMA = "key binary, value binary, version bigint, seq bigint, deleted boolean"


class RunCache:
    """The files used last, persisted by Spark; the one used longest ago goes when there are more than ``capacity``."""

    def __init__(self, spark: SparkSession, capacity: int = 1024):
        self.spark, self.capacity, self.hits, self.misses = spark, capacity, 0, 0
        self.held: OrderedDict[str, DataFrame] = OrderedDict()

    def read(self, path: str) -> DataFrame:
        if path in self.held:
            self.hits += 1
            self.held.move_to_end(path)
        else:
            self.misses += 1
            self.held[path] = self.spark.read.parquet(path).persist()
            if len(self.held) > self.capacity:
                self.held.popitem(last=False)[1].unpersist()
        return self.held[path]

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


class KvTable:
    """put, delete, get, scan, seek, flush and compact over files in ``home`` (one writer).

    The files of level 0 are what single calls wrote; those of a higher level have disjoint
    ranges of keys. A manifest names the live files with their level, range of keys, number
    of rows and highest version. Manifests are numbered and never overwritten: a new one is
    published by one rename after the files it names are written, under names that no other
    call uses, and the highest one counts. A call that stops anywhere leaves the old state
    and doesn't hinder the next one. The winner of a key is its write of the highest
    (version, seq); ``seq`` is the number of the call that wrote it, and ``version`` is that
    too where the caller gives none. Writes of one key, version and call are decided by the
    larger value.

    A lookup opens only the files whose range can hold the key, and of these only the row
    groups that their Bloom filters don't rule out. When level 0 has more than
    ``level0_files`` files, a write merges them into level 1, in files of about
    ``file_rows`` rows.
    """

    def __init__(self, spark: SparkSession, home: str, create: bool = True, level0_files: int | None = merge.LEVEL0_FILES, cache: RunCache | None = None, file_rows: int = 10_000_000):
        self.spark, self.home, self.level0_files, self.cache, self.file_rows = spark, home.rstrip("/"), level0_files, cache, file_rows
        self.manifest = NumberedState(spark, f"{self.home}/manifest", {"seq": 0, "files": [], "checkpoint": [0, 0, 0], "counters": {}})
        if not self.manifest.number and not create:
            raise InvalidPath(home)

    @property
    def state(self) -> dict:
        return self.manifest.value

    def _commit(self, files: list[dict], seq: int, checkpoint: int | None, **counted: int) -> None:
        triple = self.state["checkpoint"] if checkpoint is None else [self.checkpoint, checkpoint, checkpoint]
        counters = {k: self.state["counters"].get(k, 0) + counted.get(k, 0) for k in {*self.state["counters"], *counted}}
        self.manifest.commit({"seq": seq, "files": files, "checkpoint": triple, "counters": counters})

    @property
    def counters(self) -> dict[str, int]:
        """What this table has done: rows put and deleted, calls that wrote, flushes, compactions, rows they merged."""
        return dict(self.state["counters"])

    @property
    def key_version(self) -> int:
        """The highest version of a stored write."""
        return max((f["version"] for f in self.state["files"]), default=0)

    @property
    def record_count(self) -> int:
        """How many writes are stored, deletes and older ones included."""
        return sum(f["rows"] for f in self.state["files"])

    @property
    def checkpoint(self) -> int:
        """The last lsn that ``recover`` has taken over: of (previous, new, copy) the new one if both its copies agree."""
        previous, new, copy = self.state["checkpoint"]
        return copy if new == copy else previous

    def recover(self, log: DataFrame) -> int:
        """Take over the records (lsn, kind, key, value) of a log that lie beyond the checkpoint; the new checkpoint.

        ``kind`` is put or delete, other records only move the checkpoint. The run and the
        checkpoint are committed together, so a repeat after a failure takes over nothing
        twice. The lsn is the version of what is written.
        """
        new = log.where(F.col("lsn") > self.checkpoint)
        last = new.agg(F.max("lsn")).first()[0]
        if last is None:
            return self.checkpoint
        writes = new.where(F.col("kind").isin("put", "delete")).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("lsn").alias("version"), (F.col("kind") == "delete").alias("deleted"))
        self._write(writes.withColumn("value", F.when(~F.col("deleted"), F.coalesce("value", F.unhex(F.lit(""))))), last)
        return last

    def _write(self, rows: DataFrame, checkpoint: int | None = None) -> None:
        bad = log.invalid_keys(rows, "key")
        if not bad.isEmpty():
            raise InvalidKey(f"a key must have 1 to 64 bytes: {bad.first()['key']!r}")
        seq = self.state["seq"] + 1
        run = log.latest(rows.withColumn("seq", F.lit(seq).cast("bigint")).withColumn("version", F.coalesce("version", "seq")).select(*SCHEMA_COLUMNS), "key", ["version", "seq"])
        files = self._store(run, seq, 0)
        gone = sum(f.pop("deleted") for f in files)
        put = sum(f["rows"] for f in files) - gone
        self._commit([*self.state["files"], *files], seq, checkpoint, writes=1, rows_put=put, rows_deleted=gone)
        if self.level0_files is not None and self.needs_flush():
            self.flush()

    def _store(self, rows: DataFrame, seq: int, level: int, files: int | None = None) -> list[dict]:
        """Write sorted files with Bloom filters on the key; what the manifest says of them."""
        folder = f"runs/{seq}-{uuid.uuid4().hex}"
        written = merge.write_run(rows, "key", f"{self.home}/{folder}", files, bloom=True)
        facts = layout.key_ranges(written.withColumn("path", F.element_at(F.split("_metadata.file_path", "/"), -1)), ["path"], "key", [F.max("version").alias("version"), F.sum(F.col("deleted").cast("bigint")).alias("deleted")])
        return [
            {"path": f"{folder}/{r.path}", "level": level, "lo": bytes(r.min_key).hex(), "hi": bytes(r.max_key).hex(), "rows": r.records, "version": r.version, "deleted": r.deleted} for r in sorted(facts.collect(), key=lambda r: r.path)
        ]

    def put(self, rows: DataFrame) -> None:
        """Store (key, value[, version]) rows; other columns are ignored. Raises InvalidKey."""
        version = F.col("version").cast("bigint") if "version" in rows.columns else F.lit(None).cast("bigint")
        self._write(rows.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.unhex(F.lit(""))).alias("value"), version.alias("version"), F.lit(False).alias("deleted")))

    def write(self, rows: DataFrame) -> None:
        """Puts and deletes in one call: (key, value, version, deleted) rows."""
        deleted = F.coalesce(F.col("deleted"), F.lit(False))
        value = F.when(~deleted, F.coalesce(F.col("value").cast("binary"), F.unhex(F.lit(""))))
        self._write(rows.select(F.col("key").cast("binary").alias("key"), value.alias("value"), F.col("version").cast("bigint").alias("version"), deleted.alias("deleted")))

    def delete(self, keys: DataFrame) -> None:
        """Delete the keys of ``keys`` (key[, version])."""
        version = F.col("version").cast("bigint") if "version" in keys.columns else F.lit(None).cast("bigint")
        self._write(keys.select(F.col("key").cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"), version.alias("version"), F.lit(True).alias("deleted")))

    def _read(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], "key_bytes int, " + SCHEMA)
        paths = [f"{self.home}/{f['path']}" for f in files]
        return self.spark.read.parquet(*paths) if self.cache is None else reduce(DataFrame.unionByName, map(self.cache.read, paths))

    def writes(self) -> DataFrame:
        """All stored writes, with the bytes of their key in ``key_bytes``."""
        return self._read(self.state["files"])

    def files(self) -> DataFrame:
        """(path, level, min_key, max_key, rows, version) of the live files."""
        listed = [(f["path"], f["level"], bytes.fromhex(f["lo"]), bytes.fromhex(f["hi"]), f["rows"], f["version"]) for f in self.state["files"]]
        return self.spark.createDataFrame(listed, "path string, level int, min_key binary, max_key binary, rows bigint, version bigint")

    def files_for(self, key: bytes) -> list[str]:
        """The files whose range of keys can hold this one."""
        return [f["path"] for f in self._holding(key)]

    def _holding(self, key: bytes) -> list[dict]:
        at = (len(key), key)
        order = lambda text: (len(text) // 2, bytes.fromhex(text))
        return [f for f in self.state["files"] if order(f["lo"]) <= at <= order(f["hi"])]

    def rows(self) -> DataFrame:
        """The live rows: key, value, version, seq."""
        return log.latest(self.writes().select(*SCHEMA_COLUMNS), "key", ORDER, "deleted").drop("deleted")

    def get(self, key: bytes) -> DataFrame:
        """0 or 1 row; only files that can hold the key are opened, and the filter reaches them."""
        mine = self._read(self._holding(key)).where((F.col("key_bytes") == len(key)) & (F.col("key") == F.lit(key)))
        return log.latest(mine.select(*SCHEMA_COLUMNS), "key", ORDER, "deleted").drop("deleted")

    def value(self, key: bytes) -> bytes:
        """The value of a key; raises NotFound."""
        row = self.get(key).first()
        if row is None:
            raise NotFound(repr(key))
        return bytes(row["value"])

    def multi_get(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """Every row of ``keys`` with ``found``, ``value`` and ``version``."""
        kept = keys.drop("found", "value", "version")
        return log.probe(self.rows(), "key", kept, key, ["value", "version"])

    def exists(self, keys: DataFrame, key: str = "key") -> DataFrame:
        return log.exists(keys, key, self.rows(), "key")

    def scan(self) -> DataFrame:
        return cursor.scan(self.rows(), "key")

    def range(self, low: Column | None = None, high: Column | None = None) -> DataFrame:
        return cursor.range_scan(self.rows(), "key", low, high)

    def seek(self, target: bytes, n: int = 1) -> DataFrame:
        return cursor.seek(self.rows(), "key", F.lit(target), n)

    def seek_for_prev(self, target: bytes, n: int = 1) -> DataFrame:
        return cursor.seek_for_prev(self.rows(), "key", F.lit(target), n)

    def size(self) -> int:
        return self.rows().count()

    def flush(self) -> None:
        """Merge level 0 into level 1; what is visible doesn't change."""
        self.compact(0)

    def compact(self, level: int | None = None) -> None:
        """Merge the files of ``level`` and those of the next one that overlap them into new files of the next level.

        Files that don't overlap stay as they are. Of the files merged the last write of
        every key is kept, deletes too, so that late writes of older versions lose to them.
        Without ``level`` everything is merged into level 2 and deletes go. What is visible
        doesn't change.
        """
        if level is None:
            picked, target = self.state["files"], 2
        else:
            chosen = {r.path for r in merge.pick_overlapping(self.files(), level, level + 1).select("path").toLocalIterator()}
            picked, target = [f for f in self.state["files"] if f["path"] in chosen], level + 1
        if not picked:
            return
        kept = [f for f in self.state["files"] if f not in picked]
        seq = self.state["seq"] + 1
        merged = log.latest(self.spark.read.parquet(*[f"{self.home}/{f['path']}" for f in picked]).select(*SCHEMA_COLUMNS), "key", ORDER, "deleted" if level is None else None)
        files = self._store(merged, seq, target, -(-sum(f["rows"] for f in picked) // self.file_rows))
        for f in files:
            f.pop("deleted")
        counted = {"flushes": 1} if level == 0 else {"compactions": 1}
        self._commit([*kept, *files], seq, None, **counted, rows_merged=sum(f["rows"] for f in picked))

    def clear(self) -> None:
        """Forget every key; the files stay until ``vacuum``."""
        self._commit([], self.state["seq"] + 1, None)

    def needs_flush(self) -> bool:
        return sum(f["level"] == 0 for f in self.state["files"]) > (merge.LEVEL0_FILES if self.level0_files is None else self.level0_files)

    def vacuum(self) -> list[str]:
        """Remove the runs of which the manifest names no file, and all older manifests; the runs' names."""
        named = {f["path"].split("/")[1] for f in self.state["files"]}
        gone = [n for n in storage.children(self.spark, f"{self.home}/runs") if n not in named]
        for n in gone:
            storage.delete(self.spark, f"{self.home}/runs/{n}")
        self.manifest.forget()
        return gone


SCHEMA_COLUMNS = ["key", "value", "version", "seq", "deleted"]
