"""Small states that are never lost: numbered files, of which the highest counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from siltbed.sources import storage


class ConcurrentWrite(RuntimeError):
    """Another writer has committed meanwhile; open the state anew."""


class NumberedState:
    """A JSON state in ``folder``. Each commit publishes a new file by one rename; none is ever overwritten."""

    def __init__(self, spark: SparkSession, folder: str, first: dict):
        self.spark, self.folder = spark, folder
        numbers = self.numbers()
        self.number = numbers[-1] if numbers else 0
        self.value = json.loads(storage.read_text(spark, self._path(self.number))) if numbers else first

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in storage.children(self.spark, self.folder) if n.endswith(".json"))

    def commit(self, value: dict) -> None:
        if not storage.publish_text(self.spark, self._path(self.number + 1), json.dumps(value)):
            raise ConcurrentWrite(self.folder)
        self.number, self.value = self.number + 1, value

    def forget(self) -> None:
        """Remove all files but the last."""
        for number in self.numbers():
            if number < self.number:
                storage.delete(self.spark, self._path(number))
