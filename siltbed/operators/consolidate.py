"""Turning very many small files into fewer well-sized ones, without losing or doubling a record.

Steps: freeze a listing of the files and their sizes; pack the small ones into bins of a
target size by first-fit decreasing; rewrite each bin; compare row counts and checksums of
what was read and what was written; publish the new files and the snapshot that names them
by one rename. Until the rename readers see the old state, and a failed run leaves only
staged files behind that the next run overwrites.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from siltbed.functions.keys import true_key
from siltbed.operators.binpack import pack_in_rounds
from siltbed.session import cut, join_small
from siltbed.sources import storage

RECORD_HEAD_BYTES = 45
SMALL_BYTES = 32_768
TARGET_BYTES = 128 << 20
#: Column of a record's bin in the files written.
BIN = "bin__"


def first_fit_decreasing(items: DataFrame, item: str, size: str, group: list[str], target: int = TARGET_BYTES, rounds: tuple[int, ...] = (8, 0)) -> DataFrame:
    """``items`` (item, size, group columns) with ``bin``, the name of the bin.

    Items are never split and bins never mix groups. In decreasing size every item goes to
    the first bin that has room, found by a segment tree over the bins' free space in
    logarithmic time; an item larger than ``target`` has a bin of its own. A group is packed
    in ``rounds`` (see ``binpack``), so that no task holds more than one chunk of it and a
    hot group is spread. Ties are ordered by item. Sizes that are NULL or negative count as
    0; repeated items are packed once (the largest size counts); a NULL item is left out.
    Other columns are dropped. No items: no bins.
    """
    names = [f"__g{i}" for i in range(len(group))]
    rows = items.select(*[F.col(f"`{g}`").alias(n) for n, g in zip(names, group, strict=True)], F.col(f"`{item}`").alias("__item"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("__size"))
    rows = rows.where(F.col("__item").isNotNull()).groupBy(*names, "__item").agg(F.max("__size").alias("__size"))
    packed = pack_in_rounds(rows, names, ["__item"], "__size", lambda: FirstFit(target), target, rounds)
    label = F.concat_ws("-", *[F.coalesce(F.col(n).cast("string"), F.lit("none")) for n in names], F.hex("bin"))
    return packed.select(*[F.col(n).alias(g) for n, g in zip(names, group, strict=True)], F.col("__item").alias(item), F.col("__size").alias(size), label.alias("bin"))


class FirstFit:
    """Bins in order of opening, with the leftmost one that has room found in a tree of maxima."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.tree = [0, capacity]

    def place(self, size: int) -> int:
        if size > self.capacity:
            return self._open(-1)  # nothing may join it, not even an empty item
        tree, node = self.tree, 1
        if tree[1] < size:
            return self._open(self.capacity - size)
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        number = node - self.leaves
        if number >= self.used:
            return self._open(self.capacity - size)
        self._set(number, tree[node] - size)
        return number

    def _open(self, room: int) -> int:
        number = self.used
        if number == self.leaves:
            old, self.leaves = self.tree[self.leaves :], self.leaves * 2
            self.tree = [0] * self.leaves + old + [self.capacity] * (self.leaves - len(old))
            for node in range(self.leaves - 1, 0, -1):
                self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])
        self.used += 1
        self._set(number, room)
        return number

    def _set(self, number: int, room: int) -> None:
        tree, node = self.tree, number + self.leaves
        tree[node] = room
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best


# The frozen listing of the test tables


def present_files(file_infos: DataFrame, more: list[str] | None = None) -> DataFrame:
    """One row per file with its present record, the one with the highest ``manifest_no``, and ``more`` columns of that.

    Records without a file id are left out; records without a number come first, and equal
    numbers are decided by the rest of the record.
    """
    state = F.struct("db_name", "file_size_", "file_type", "file_status", "file_level", *(more or []))
    rows = file_infos.where(F.col("file_id").isNotNull()).select("file_id", state.alias("__s"), F.struct("manifest_no", state).alias("__o"))
    return rows.groupBy("file_id").agg(F.max_by("__s", "__o").alias("__s")).select("file_id", "__s.*")


def record_bytes(key: Column, value: Column) -> Column:
    return F.lit(RECORD_HEAD_BYTES) + F.octet_length(key).cast("bigint") + F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def frozen_listing(file_infos: DataFrame, slices: DataFrame) -> DataFrame:
    """(file_id, db_name, file_level, size) of the live files of level 1 and above.

    The size is the recorded one if it is positive, else the sum over the file's different
    records of 45 + key + value bytes (no records: 0; no key or value: 0 bytes of it).
    """
    live = present_files(file_infos).where((F.col("file_status") == 0) & (F.col("file_level") >= 1))
    unknown = live.where(~F.coalesce(F.col("file_size_") > 0, F.lit(False))).select("file_id")
    rows = slices.select(F.col("file_id_").alias("file_id"), "rec_id", "key_", "key_length_", "value_").where(F.col("file_id").isNotNull())
    rows = join_small(rows, unknown, ["file_id"], "left_semi")
    key = F.coalesce(true_key(F.col("key_"), F.col("key_length_")), F.unhex(F.lit("")))
    per_record = rows.select("file_id", "rec_id", record_bytes(key, F.col("value_")).alias("n")).groupBy("file_id", "rec_id").agg(F.max("n").alias("n"))
    measured = per_record.groupBy("file_id").agg(F.sum("n").alias("__measured"))
    size = F.when(F.col("file_size_") > 0, F.col("file_size_")).otherwise(F.coalesce(F.col("__measured"), F.lit(0)))
    return live.join(measured, "file_id", "left").select("file_id", "db_name", F.col("file_level").cast("int").alias("file_level"), size.cast("bigint").alias("size"))


def pack_small(listing: DataFrame, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> DataFrame:
    """The files of a listing (file_id, db_name, file_level, size) that are too small, in bins by database and level."""
    return first_fit_decreasing(listing.where(F.col("size") < small), "file_id", "size", ["db_name", "file_level"], target)


# Rewriting


class VerificationFailed(RuntimeError):
    pass


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _has_map(kind.elementType))


def row_digest(records: DataFrame) -> Column:
    """64 bits over all columns of a row; maps, which can't be hashed, count as JSON text."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in records.schema.fields])


def _sum(digest: Column | str) -> Column:
    """A sum of digests that doesn't depend on the order of rows and can't overflow."""
    return F.sum((F.col(digest) if isinstance(digest, str) else digest).cast("decimal(20,0)"))


def _free(name: str, taken: list[str]) -> str:
    """``name``, or a longer one if a column is called that."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def consolidate(records: DataFrame, file_of: str, plan: DataFrame, home: str, version: str, repeats: bool = True) -> DataFrame:
    """Rewrite the planned files into their bins under ``home``; the committed snapshot's records.

    ``plan`` has ``file_id``, ``bin`` and ``records``, the number of records the file must
    give as counted when the listing was frozen. ``records`` have their file in the column
    ``file_of``; without ``repeats`` repeated rows are one record. Written below
    ``home/snapshots/<version>``: ``plan``, ``data/bin__=<bin>`` (one file each) and
    ``tally``. The records are read and shuffled once. What is compared with what was
    written: per bin the number of records that the plan promises, and over all bins the
    sum of the digests taken where the old files were read. Raises VerificationFailed, and
    publishes nothing, if any differs. A version that is published already isn't written
    again. Returns the columns of ``records`` and ``bin__``.
    """
    final, staged = f"{home}/snapshots/{version}", f"{home}/_staged/{version}"
    if not storage.exists(records.sparkSession, final):
        storage.delete(records.sparkSession, staged)
        plan.select("file_id", "bin", F.coalesce("records", F.lit(0)).cast("bigint").alias("records")).write.parquet(f"{staged}/plan")
        _rewrite(records, file_of, staged, repeats)
        storage.publish(records.sparkSession, staged, final)
    return _written(records, final)


def _written(records: DataFrame, snapshot: str) -> DataFrame:
    schema = StructType([*records.schema.fields, StructField(_free(BIN, records.columns), StringType())])
    return records.sparkSession.read.schema(schema).parquet(f"{snapshot}/data")


def _rewrite(records: DataFrame, file_of: str, staged: str, repeats: bool) -> None:
    spark = records.sparkSession
    frozen = spark.read.parquet(f"{staged}/plan")
    bins = _free(BIN, records.columns)
    digest = _free("digest__", records.columns)
    moved = join_small(records, frozen.select(F.col("file_id").alias(file_of), F.col("bin").alias(bins)), [file_of], "inner")
    laid = moved.withColumn(digest, row_digest(records)).repartition(F.col(f"`{bins}`"))
    if not repeats:
        laid = laid.dropDuplicates()
    read = Observation()
    laid = laid.observe(read, F.count(F.lit(1)).alias("records"), _sum(digest).alias("checksum"))
    laid.drop(digest).sortWithinPartitions(F.col(f"`{bins}`")).write.partitionBy(bins).parquet(f"{staged}/data")
    written = _written(records, staged)
    tally = written.groupBy(F.col(f"`{bins}`").alias("bin")).agg(F.count(F.lit(1)).alias("written"), _sum(row_digest(records)).alias("checksum"))
    tally.write.parquet(f"{staged}/tally")
    tally = spark.read.parquet(f"{staged}/tally")
    promised = frozen.groupBy("bin").agg(F.sum("records").alias("promised"))
    wrong = promised.join(tally, "bin", "full_outer").where(F.coalesce("promised", F.lit(0)) != F.coalesce("written", F.lit(0)))
    if not wrong.isEmpty():
        raise VerificationFailed(f"bins with another number of records than their files have: {wrong.select('bin', 'promised', 'written').limit(3).collect()}")
    total = tally.agg(F.sum("written"), F.sum("checksum")).first()
    if total[0] is not None and (total[0], total[1]) != (read.get["records"], read.get["checksum"]):
        raise VerificationFailed(f"read {read.get}, but written {total}")


# Folders of Parquet files


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of rows that the footer of each file states."""
    import pyarrow.parquet as pq
    from pyarrow import fs as arrow_fs

    for batch in batches:
        counts = []
        for uri in batch.column(0).to_pylist():
            where, inner = arrow_fs.FileSystem.from_uri(uri)
            counts.append(pq.read_metadata(inner, filesystem=where).num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "records"])


def _version_of(path: Column | str, size: Column | str, modified: Column | str) -> Column:
    """A file as it was: where, how large and since when. A URI has no ``#`` of its own in a path."""
    return F.concat_ws("#", path, F.col(size).cast("string") if isinstance(size, str) else size.cast("string"), F.unix_micros(modified).cast("string"))


def consolidate_folder(spark: SparkSession, folder: str, home: str, version: str, small: int = 32 << 20, target: int = TARGET_BYTES, pattern: str = "*.parquet") -> DataFrame:
    """Consolidate the small Parquet files of a folder; the rows of the snapshot ``version``.

    The listing is frozen with the plan: path, size, time of change and the number of rows
    in the footer of every file. Files below ``small`` bytes are rewritten, in bins that
    don't mix folders; larger ones stay where they are. Columns are those of all files (one
    that a file lacks is NULL there), the partition columns in folder names included. A
    frozen file that is gone or changed raises VerificationFailed; files that come later
    aren't part of the snapshot. The old files stay until the caller removes them. No
    files at all: FileNotFoundError, as nothing tells the columns.

    No list of paths goes to the driver's Python. The small files' rows meet their bins in
    a join; the large ones are read as a folder, less the files that came later.
    """
    from siltbed.operators.incremental import list_files

    frozen = f"{home}/frozen/{version}"
    if not storage.exists(spark, f"{frozen}/_SUCCESS"):
        listed = list_files(spark, folder, pattern)
        listed.mapInArrow(_row_counts, "path string, size bigint, modified timestamp, records bigint").write.mode("overwrite").parquet(frozen)
    listing = spark.read.parquet(frozen).withColumn("file_id", _version_of("path", "size", "modified"))
    if listing.isEmpty():
        raise FileNotFoundError(folder)
    whole = spark.read.option("mergeSchema", "true").option("basePath", folder).option("pathGlobFilter", pattern).parquet(folder)
    file_of = _free("source_file__", whole.columns)
    meta = F.col("_metadata")
    named = whole.withColumn(file_of, _version_of(meta["file_path"], meta["file_size"], meta["file_modification_time"]))
    tiny = listing.where(F.col("size") < small)
    plan = first_fit_decreasing(tiny.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")), "file_id", "size", ["dir"], target)
    # A folder's name may be longer than that of a file can be.
    plan = plan.select("file_id", F.md5("bin").alias("bin")).join(tiny.select("file_id", "records"), "file_id")
    rewritten = consolidate(named.where(meta["file_size"] < small), file_of, plan, home, version)
    moved = rewritten.select(*[F.col(f"`{c}`") for c in whole.columns])
    large = listing.where(F.col("size") >= small)
    if large.isEmpty():
        return moved
    now = list_files(spark, folder, pattern).where(F.col("size") >= small).withColumn("file_id", _version_of("path", "size", "modified"))
    lost = large.join(now, "file_id", "left_anti")
    if not lost.isEmpty():
        raise VerificationFailed(f"gone or changed since the listing: {lost.select('path').limit(3).collect()}")
    kept = named.where(meta["file_size"] >= small)
    later = cut(now.join(large, "file_id", "left_anti").select(F.col("file_id").alias(file_of)))
    if not later.isEmpty():
        kept = join_small(kept, later, [file_of], "left_anti")
    return moved.unionByName(kept.select(*[F.col(f"`{c}`") for c in whole.columns]))


# The record copies of the test tables


def consolidate_slices(slices: DataFrame, file_infos: DataFrame, home: str, version: str, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(listing, rewritten): the frozen listing of the live sealed files above level 0, and the records of the small ones after the rewrite.

    Different rows are different records. The listing is written to the shared folder
    first, so that all that follows sees the same files, whatever is added to the tables
    meanwhile. What each file must give is counted from it by (file, digest of the row).
    """
    listing = cut(frozen_listing(file_infos, slices))
    rows = slices.where(F.col("file_id_").isNotNull())
    mine = listing.where(F.col("size") < small).select(F.col("file_id").alias("file_id_"))
    named = join_small(rows.select("file_id_", row_digest(slices).alias("__digest")), mine, ["file_id_"], "left_semi")
    counts = named.distinct().groupBy(F.col("file_id_").alias("file_id")).agg(F.count(F.lit(1)).alias("records"))
    plan = pack_small(listing, small, target).join(counts, "file_id", "left")
    return listing, consolidate(rows, "file_id_", plan, home, version, repeats=False)


def consolidated_files(slices: DataFrame, file_infos: DataFrame, home: str, version: str, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> DataFrame:
    """(file_id, bin) of the files that the committed snapshot replaces."""
    consolidate_slices(slices, file_infos, home, version, small, target)
    return slices.sparkSession.read.parquet(f"{home}/snapshots/{version}/plan").select("file_id", "bin")


def consolidated_layout(slices: DataFrame, file_infos: DataFrame, home: str, version: str, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> DataFrame:
    """(rec_id, db_name, file_level, file) of every record in live sealed files above level 0, each once.

    Small files are rewritten first, with every column of ``slices``; ``file`` is the bin's
    name for their records and the old file id for the others.
    """
    listing, rewritten = consolidate_slices(slices, file_infos, home, version, small, target)
    levels = listing.select(F.col("file_id").alias("file_id_"), "file_level", (F.col("size") >= small).alias("__large"))
    rows = slices.where(F.col("file_id_").isNotNull()).select("rec_id", "db_name", "file_id_", row_digest(slices).alias("__digest"))
    large = join_small(rows, levels.where("__large").drop("__large"), ["file_id_"], "inner").distinct()
    moved = join_small(rewritten.select("rec_id", "db_name", "file_id_", F.col(rewritten.columns[-1]).alias("file")), levels.drop("__large"), ["file_id_"], "inner")
    kept = large.select("rec_id", "db_name", "file_level", F.col("file_id_").cast("string").alias("file"))
    return kept.unionByName(moved.select("rec_id", "db_name", "file_level", "file"))
