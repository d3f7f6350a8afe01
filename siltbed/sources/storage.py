"""Files of the shared storage through Hadoop's FileSystem, so any scheme Spark reads works."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible entries of a folder, sorted; none if it doesn't exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, staged: str, final: str) -> bool:
    """Rename ``staged`` to ``final`` in one step; False if ``final`` is there already."""
    fs, source = _fs(spark, staged)
    target = spark._jvm.org.apache.hadoop.fs.Path(final)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"can't rename {staged} to {final}")
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: beside it first, then renamed over it in one step where the file system can.

    Where it can't, the old file goes before the new one comes, so a reader may find neither:
    state that must not be lost belongs in numbered files that are never overwritten.
    """
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.staged")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(staged, p):
        raise OSError(f"can't rename {staged} to {path}")


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that isn't there yet, whole or not at all; False if it is there already."""
    staged = f"{path}.{uuid.uuid4().hex}.staged"
    fs, p = _fs(spark, staged)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return publish(spark, staged, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def tables(spark: SparkSession, folder: str):
    """A reader of the Parquet tables of a folder: ``tables(spark, d)("slices")``."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
