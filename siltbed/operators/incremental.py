"""Processing only new or changed inputs, once each, across failures.

The rule is one anti-join: what is listed now (identity, size, checksum) minus what the
manifest says was processed (same columns). A batch freezes what is pending, writes its
output under the batch's own identifier (a repeat overwrites it) and then publishes its
part of the manifest by one rename. A batch that failed at any point is repeated with the
same identifier and the same frozen listing, so nothing is skipped or taken twice. Readers
see committed batches only. It is done at two grains:

* ``RecordRun`` - the records of a log;
* ``IncrementalRun`` - the files of a folder; of each file readers see only what its last
  committed version gave.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.session import cut, join_small
from siltbed.sources import storage

#: Column of a record's file in the input of a transform and in the output files.
SOURCE_FILE = "source_file__"


def fingerprint(content: Column) -> Column:
    """Checksum of a payload: the first 128 bits of its SHA-256, NULL for NULL."""
    return F.unhex(F.left(F.sha2(content, 256), F.lit(32)))


def pending(listing: DataFrame, manifest: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``listing`` that ``manifest`` has no equal for in the columns ``by``.

    NULL equals NULL. Other columns of the manifest are never looked at, so their names may
    clash; other columns of the listing are kept. Repeated rows stay repeated. An empty
    manifest leaves everything pending.
    """
    done = manifest.select([F.col(f"`{c}`").alias(f"__done_{i}") for i, c in enumerate(by)])
    condition = None
    for i, c in enumerate(by):
        one = listing[f"`{c}`"].eqNullSafe(done[f"__done_{i}"])
        condition = one if condition is None else condition & one
    return listing.join(done, condition, "left_anti")


def record_contents(deliveries: DataFrame, identity: list[str], content: str, received: str) -> DataFrame:
    """One row per record and distinct content: size, checksum, first and last time it came.

    Repeated deliveries are combined before the shuffle. A delivery without a time counts
    as older than any other.
    """
    start = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    keyed = deliveries.select(
        *[F.col(f"`{c}`") for c in identity],
        F.octet_length(content).cast("bigint").alias("size"),
        fingerprint(F.col(f"`{content}`")).alias("checksum"),
        F.coalesce(F.col(f"`{received}`"), start).alias("__at"),
    )
    return keyed.groupBy(*identity, "size", "checksum").agg(F.min("__at").alias("first_at"), F.max("__at").alias("last_at"))


def present_contents(contents: DataFrame, identity: list[str]) -> DataFrame:
    """Of each record the content that came last; equal times: the larger checksum.

    It asks for all columns of ``contents``, so that a plan that uses those too shuffles them once for both.
    """
    newest = F.max(F.struct("last_at", "checksum", "size", "first_at")).alias("__newest")
    return contents.groupBy(*identity).agg(newest).select(*identity, F.col("__newest.size").alias("size"), F.col("__newest.checksum").alias("checksum"))


# Batches


class StoppedOnPurpose(RuntimeError):
    """Raised by a run that was told to fail, for tests and drills."""


class Batches:
    """The batches of a job in ``home``, one writer at a time.

    Layout: ``intent.json`` (the batch under way), ``frozen/<batch>`` (its listing),
    ``output/batch_id=<batch>``, ``manifest/batch_id=<batch>`` (committed).
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def committed(self) -> list[str]:
        return storage.children(self.spark, f"{self.home}/manifest")

    def manifest(self, schema: str) -> DataFrame:
        """What all committed batches took, with ``batch_id``."""
        schema += ", batch_id bigint"
        return self.spark.read.schema(schema).parquet(f"{self.home}/manifest") if self.committed() else self.spark.createDataFrame([], schema)

    def open(self) -> tuple[str, DataFrame | None]:
        """The batch to run and, if it was begun before, its frozen listing."""
        intent = json.loads(storage.read_text(self.spark, f"{self.home}/intent.json") or "{}")
        batch = intent.get("batch_id")
        if batch and not storage.exists(self.spark, f"{self.home}/manifest/batch_id={batch}"):
            return batch, self.spark.read.parquet(f"{self.home}/frozen/{batch}")
        return f"{len(self.committed()):08d}", None

    def freeze(self, batch: str, waiting: DataFrame) -> DataFrame | None:
        """The rows of ``waiting``, written down for this batch; None if there are none."""
        path = f"{self.home}/frozen/{batch}"
        waiting.write.mode("overwrite").parquet(path)
        frozen = self.spark.read.parquet(path)
        if frozen.isEmpty():
            storage.delete(self.spark, path)
            return None
        storage.write_text(self.spark, f"{self.home}/intent.json", json.dumps({"batch_id": batch}))
        return frozen

    def thaw(self) -> None:
        """Give up the batch under way; nothing of it can be seen yet."""
        storage.delete(self.spark, f"{self.home}/intent.json")

    def write(self, batch: str, made: DataFrame) -> None:
        made.write.mode("overwrite").parquet(f"{self.home}/output/batch_id={batch}")

    def commit(self, batch: str, taken: DataFrame) -> None:
        staged = f"{self.home}/_staged/{batch}"
        taken.write.mode("overwrite").parquet(staged)
        storage.publish(self.spark, staged, f"{self.home}/manifest/batch_id={batch}")

    def output(self) -> DataFrame | None:
        paths = [f"{self.home}/output/{b}" for b in self.committed()]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.home}/output").parquet(*paths).withColumn("batch_id", F.col("batch_id").cast("bigint"))


# Records


class RecordRun:
    """Takes records of a listing that no committed batch has taken, and keeps count of them in ``home``.

    A record is new if its columns ``by`` (identity, size, checksum; NULL equals NULL) are
    in no manifest. ``process`` makes the output of a batch from its frozen listing.
    """

    def __init__(self, spark: SparkSession, home: str, by: list[str], process: Callable[[DataFrame], DataFrame] = lambda frozen: frozen):
        self.batches, self.by, self.process = Batches(spark, home), by, process
        self.schema = ""

    def run(self, listing: DataFrame, handled: DataFrame | None = None, fail_after: str | None = None) -> str | None:
        """One batch; its identifier, or None if nothing is pending.

        ``handled`` is a manifest from elsewhere, of what was taken before this job began.
        ``fail_after`` is freeze or output.
        """
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)
        batch, frozen = self.batches.open()
        if frozen is None:
            waiting = listing if handled is None else pending(listing, handled, self.by)
            if self.batches.committed():
                waiting = pending(waiting, self.batches.manifest(self.schema), self.by)
            frozen = self.batches.freeze(batch, waiting)
            if frozen is None:
                return None
        if fail_after == "freeze":
            raise StoppedOnPurpose(batch)
        self.batches.write(batch, self.process(frozen))
        if fail_after == "output":
            raise StoppedOnPurpose(batch)
        self.batches.commit(batch, frozen)
        return batch

    def output(self) -> DataFrame:
        """The committed output with ``batch_id``; before the first batch, no rows of the listing's columns."""
        made = self.batches.output()
        return self.batches.manifest(self.schema) if made is None else made


# Files


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, size, modified) of every file under ``folder`` (or of one file); no file is opened.

    ``path`` is the URI as Spark's ``_metadata.file_path`` has it, with blanks and the like escaped.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def with_checksums(files: DataFrame) -> DataFrame:
    """``files`` (path, size, modified) with the SHA-256 of their content, taken by the executors in pieces of 8 MiB; a file that is gone has none."""
    spread = files.select("path", "size", "modified").repartition("path")
    return spread.mapInArrow(_checksums, "path string, size bigint, modified timestamp, checksum string")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from pyarrow import fs as arrow_fs

    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            where, inner = arrow_fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            try:
                with where.open_input_stream(inner) as stream:
                    while piece := stream.read(8 << 20):
                        digest.update(piece)
            except FileNotFoundError:
                digest = None
            sums.append(digest and digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "size", "modified", "checksum"])


class SourceChanged(RuntimeError):
    """A file changed while its batch was being read; the batch was given up, and the next run begins anew."""


class IncrementalRun:
    """Runs ``transform`` over the new or changed files of ``source`` and keeps count of them in ``home``.

    One writer at a time. A batch takes at most ``files_per_batch`` files; ``drain`` repeats
    until none is pending, so the bound defers files and never drops them.

    A run lists names, sizes and times of change; only files of which the manifest doesn't
    know these three are opened and hashed, so what a run reads is in proportion to what is
    new. A time younger than ``settle_seconds`` when it is listed isn't trusted, as the file
    may still change within the clock's resolution: such a file is hashed again by the next
    run. A file that was touched but has its old checksum isn't transformed again.

    A file that changed is transformed again as a whole, and its new output takes the place
    of its old one. For that ``transform`` gets the rows with their file in the column
    ``source_file__`` and must keep it (ValueError if it doesn't). The output of a file that
    was deleted stays. If a frozen file changes or disappears before its batch is committed,
    the batch is given up: SourceChanged is raised, or a batch left by a failure is frozen
    anew. Partition columns in folder names are read as columns.
    """

    def __init__(self, spark: SparkSession, source: str, home: str, transform: Callable[[DataFrame], DataFrame], pattern: str = "*.parquet", files_per_batch: int = 50_000, settle_seconds: int = 10):
        self.spark, self.source, self.transform = spark, source, transform
        self.batches, self.pattern, self.files_per_batch, self.settle_seconds = Batches(spark, home), pattern, files_per_batch, settle_seconds

    _SCHEMA = "path string, size bigint, modified timestamp, checksum string"

    def manifest(self) -> DataFrame:
        """(path, size, modified, checksum) of each file as it was when it was last processed; ``modified`` is NULL where it isn't trusted."""
        newest = F.max_by(F.struct("size", "modified", "checksum"), "batch_id").alias("__newest")
        return self.batches.manifest(self._SCHEMA).groupBy("path").agg(newest).select("path", "__newest.*")

    def output(self) -> DataFrame:
        """The committed output of the last version of every file, with its ``batch_id``."""
        rows = self.batches.output()
        if rows is None:
            raise FileNotFoundError("nothing is committed yet")
        versions = self.batches.manifest(self._SCHEMA).groupBy("path").agg(F.sort_array(F.collect_set("batch_id"), False).alias("v")).where(F.size("v") > 1)
        replaced = versions.select(F.col("path").alias(SOURCE_FILE), F.explode(F.slice("v", F.lit(2), F.size("v"))).alias("batch_id"))
        return join_small(rows, replaced, [SOURCE_FILE, "batch_id"], "left_anti").drop(SOURCE_FILE)

    def _waiting(self) -> DataFrame:
        """The files to be processed, hashed; at most those of one batch."""
        manifest, listed_at = self.manifest(), time.time()
        listed = pending(list_files(self.spark, self.source, self.pattern), manifest, ["path", "size", "modified"])
        hashed = cut(with_checksums(listed))
        young = F.unix_micros("modified") > int((listed_at - self.settle_seconds) * 1_000_000)
        changed = pending(hashed.where("checksum IS NOT NULL"), manifest, ["path", "size", "checksum"])
        return changed.orderBy("path").limit(self.files_per_batch).select("path", "size", F.when(~young, F.col("modified")).alias("modified"), "checksum")

    def _moved(self, frozen: DataFrame) -> DataFrame:
        """The frozen files that aren't any more what they were."""
        now = list_files(self.spark, self.source, self.pattern).join(frozen.select("path"), "path", "left_semi")
        doubtful = cut(with_checksums(pending(now, frozen, ["path", "size", "modified"])))
        same = now.join(frozen, ["path", "size", "modified"], "left_semi").select("path")
        still = same.unionByName(doubtful.join(frozen, ["path", "size", "checksum"], "left_semi").select("path"))
        return frozen.join(still, "path", "left_anti")

    def run(self, fail_after: str | None = None) -> str | None:
        """One batch; its identifier, or None if nothing is pending. ``fail_after`` is freeze or output."""
        batch, frozen = self.batches.open()
        if frozen is None or not self._moved(frozen).isEmpty():
            frozen = self.batches.freeze(batch, self._waiting())
            if frozen is None:
                self.batches.thaw()
                return None
        if fail_after == "freeze":
            raise StoppedOnPurpose(batch)
        # The reader takes names, not URIs, and would take some characters of a name for a pattern.
        names = [re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(r.path)) for r in frozen.select("path").toLocalIterator()]
        read = self.spark.read.option("basePath", self.source) if storage.is_folder(self.spark, self.source) else self.spark.read
        made = self.transform(read.parquet(*names).withColumn(SOURCE_FILE, F.col("_metadata.file_path")))
        if SOURCE_FILE not in made.columns:
            raise ValueError(f"the transform must keep the column {SOURCE_FILE}")
        self.batches.write(batch, made)
        if fail_after == "output":
            raise StoppedOnPurpose(batch)
        if not (moved := self._moved(frozen)).isEmpty():
            self.batches.thaw()
            raise SourceChanged(f"{batch}: {[r.path for r in moved.limit(3).collect()]}")
        self.batches.commit(batch, frozen)
        return batch

    def drain(self) -> list[str]:
        done = []
        while (batch := self.run()) is not None:
            done.append(batch)
        return done


# The log reader of the test tables: what its checkpoints say it has handled.


def last_success(checkpoints: DataFrame) -> DataFrame:
    """(db_name, checkpoint_, read_at) of the successful run written last in each database.

    A run succeeded if ``lsn_new`` and ``lsn_copy`` are set and equal; ``outcome`` isn't
    trusted. Runs without ``written_at`` come first; equal times: the larger ``ckpt_id``.
    """
    good = checkpoints.where(F.col("lsn_new") == F.col("lsn_copy"))
    newest = F.max_by(F.struct("checkpoint_", "read_at"), F.struct("written_at", "ckpt_id")).alias("__run")
    return good.groupBy("db_name").agg(newest).select("db_name", "__run.checkpoint_", "__run.read_at")


_RECORD = ["db_name", "lsn", "size", "checksum"]


def unhandled_records(wal: DataFrame, checkpoints: DataFrame, home: str) -> DataFrame:
    """(db_name, lsn, size, checksum, batch_id) of the records whose present content no successful run has handled, taken in one batch in ``home``.

    The listing is the present content of every record that has a whole delivery. The
    manifest is every content that the last successful run of the database had seen
    (received up to ``read_at``) at or below its checkpoint, and what earlier batches in
    ``home`` took. Rows without an lsn are records of their own kind (NULL equals NULL); a
    run without a checkpoint or read time has handled nothing.
    """
    from siltbed.functions.wal import whole

    complete = wal.select("db_name", "lsn", "log_size", "log_data", "received_at").where(whole(F.col("log_data"), F.col("log_size")))
    contents = record_contents(complete, ["db_name", "lsn"], "log_data", "received_at")
    listing = present_contents(contents, ["db_name", "lsn"])
    runs = last_success(checkpoints)
    # Both sides ask for the same columns of `contents` and infer no filter on them, so that it is shuffled once for both.
    handled = F.coalesce((F.col("lsn") <= F.col("checkpoint_")) & (F.col("first_at") <= F.col("read_at")) & F.col("last_at").isNotNull(), F.lit(False))
    seen = join_small(contents, runs, ["db_name"], "inner").where(handled)
    job = RecordRun(wal.sparkSession, home, _RECORD)
    job.run(listing, seen)
    return job.output()


def incremental_table(spark: SparkSession, source: str, home: str, identity: str) -> DataFrame:
    """Load ``source`` from a folder of files that changes between runs; the committed rows, cut off from the files.

    At first a third of the rows is missing and one file is an older version, which lacks
    half of its records and has some that are gone later (with other values of the integer
    column ``identity``). Then the missing rows come in new files and the file becomes what
    it is in ``source``. Both times two runs fail before the good ones.
    """
    rows, folder = spark.read.parquet(source), f"{home}/source"
    share = lambda n: F.pmod(F.xxhash64(f"`{identity}`"), F.lit(n))
    for third in (0, 1):
        rows.where(share(3) == third).write.mode("append").parquet(folder)
    changing = f"{folder}/{storage.children(spark, folder)[0]}"
    half = spark.read.parquet(changing).where(share(6) < 3)
    half.unionByName(half.withColumn(identity, -F.col(f"`{identity}`") - 1)).coalesce(1).write.parquet(f"{home}/older")
    storage.publish(spark, changing, f"{home}/newer")
    storage.publish(spark, f"{home}/older/{storage.children(spark, f'{home}/older')[0]}", changing)
    job = IncrementalRun(spark, folder, f"{home}/run", lambda r: r, files_per_batch=4)
    _load(job)
    storage.delete(spark, changing)
    storage.publish(spark, f"{home}/newer", changing)
    rows.where(share(3) == 2).write.mode("append").parquet(folder)
    _load(job)
    return cut(job.output().drop("batch_id"))


def _load(job: IncrementalRun) -> None:
    for point in ("freeze", "output"):
        try:
            job.run(fail_after=point)
        except StoppedOnPurpose:
            pass
    job.drain()
