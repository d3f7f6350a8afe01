"""A write-ahead log on shared storage: appended batches of records, each with its lsn."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.status import LogError
from siltbed.operators import wal
from siltbed.sources.states import NumberedState

START = 1 << 32


class StoredLog:
    """append, read_after, truncate, reset and reset_write over a log in ``home`` (one writer).

    A batch is written under a name of its own and then named by a numbered state, so a
    batch that fails isn't part of the log. The writer stands behind the lsn ``last``; a
    record that doesn't fit in what is left of a log file begins the next one.
    """

    def __init__(self, spark: SparkSession, home: str, file_bytes: int = 64 << 20):
        self.spark, self.home, self.file_bytes = spark, home.rstrip("/"), file_bytes
        self.states = NumberedState(spark, f"{self.home}/state", {"last": START, "floor": 0, "parts": []})

    @property
    def last(self) -> int:
        return self.states.value["last"]

    def append(self, records: DataFrame, order: list[Column], data_size: Column) -> int:
        """Write a batch in ``order``; the lsn of its last record. No records: nothing happens."""
        path = f"{self.home}/parts/{uuid.uuid4().hex}"
        wal.append(records, [], order, data_size, self.file_bytes, self.last).write.parquet(path)
        bounds = self.spark.read.parquet(path).agg(F.min("lsn").alias("lo"), F.max("lsn").alias("hi")).first()
        if bounds.hi is not None:
            part = {"path": path.removeprefix(self.home + "/"), "lo": bounds.lo, "hi": bounds.hi}
            self.states.commit({**self.states.value, "last": bounds.hi, "parts": [*self.states.value["parts"], part]})
        return self.last

    def read_after(self, lsn: int) -> DataFrame:
        """The records behind ``lsn``, with ``size`` and ``lsn``; only batches that have such are opened."""
        parts = [p for p in self.states.value["parts"] if p["hi"] > lsn]
        if not parts:
            raise LogError(f"nothing is logged behind {lsn}")
        out = None
        for p in parts:
            rows = self.spark.read.parquet(f"{self.home}/{p['path']}").where((F.col("lsn") > max(lsn, self.states.value["floor"])) & (F.col("lsn") <= p["hi"]))
            out = rows if out is None else out.unionByName(rows)
        return out

    def truncate(self, flushed: int) -> None:
        """Forget the log files before that of the lsn ``flushed``."""
        floor = (flushed >> 32) << 32
        self.states.commit({**self.states.value, "floor": floor, "parts": [p for p in self.states.value["parts"] if p["hi"] > floor]})

    def reset(self, lsn: int) -> None:
        """Forget everything; the writer begins a file of its own at or behind ``lsn``."""
        file_no = (lsn >> 32) + (1 if lsn & 0xFFFFFFFF else 0)
        self.states.commit({"last": file_no << 32, "floor": 0, "parts": []})

    def reset_write(self, lsn: int) -> None:
        """Take the writer back to ``lsn``: the records behind it are no longer part of the log."""
        parts = [{**p, "hi": min(p["hi"], lsn)} for p in self.states.value["parts"] if p["lo"] <= lsn]
        self.states.commit({**self.states.value, "last": lsn, "parts": parts})
