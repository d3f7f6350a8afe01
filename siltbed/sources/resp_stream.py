"""Requests of the key-value protocol as a source of writes and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions.resp import bulk, decode_requests, simple, split_requests


def from_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (at, source, request_no, data) from files that hold what clients sent, one request behind the other.

    ``ORDER`` is the order of the requests: the file's time of change, its path, the place in it.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    sent = split_requests(files.select(F.unix_micros("modificationTime").alias("at"), F.col("path").alias("source"), "content"), "content")
    return sent.select("at", "source", F.col("request_no").cast("bigint").alias("request_no"), F.col("request").alias("data"))


def from_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of (at, source, request_no, data) from a Kafka topic, one request per message.

    ``ORDER`` is the message's time, its partition and its offset, so requests for one key
    must go to one partition. Needs Spark's Kafka package on the class path.
    """
    messages = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return messages.select(F.unix_micros("timestamp").alias("at"), F.col("partition").cast("string").alias("source"), F.col("offset").alias("request_no"), F.col("value").alias("data"))


#: What ranks the requests of a stream.
ORDER = ["at", "source", "request_no"]


def writes(requests: DataFrame, data: str, order: list[str]) -> DataFrame:
    """(order columns, key, value, deleted) of the SET and DEL requests; works on streams too."""
    kept = [F.col(f"`{c}`") for c in order]
    decoded = decode_requests(requests.select(*kept, F.col(f"`{data}`").alias("data")), "data")
    return decoded.where(F.col("verb").isin("SET", "DEL")).select(*kept, "key", "value", (F.col("verb") == "DEL").alias("deleted"))


def replies(requests: DataFrame, data: str, order: list[str], table: DataFrame) -> DataFrame:
    """(order columns, reply): OK for writes, the value or the null reply for reads, an error for the rest.

    A read sees the last write of its key before it in the batch, else ``table`` (key,
    value), the state before the batch. The requests of one key are answered in order by
    one task, which holds the last write only.
    """
    kept = [F.col(f"`{c}`") for c in order]
    decoded = decode_requests(requests.select(*kept, F.col(f"`{data}`").alias("__data")), "__data").drop("__data")
    stored = table.select(F.col("key").alias("__key"), F.col("value").alias("__stored"))
    above = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("verb").isin("SET", "DEL"), F.struct("value"))
    seen = decoded.withColumn("__written", F.last(written, ignorenulls=True).over(above))
    joined = seen.join(stored, seen["key"] == stored["__key"], "left")
    error = F.concat(F.lit("-ERR "), F.col("problem"), F.lit("\r\n")).cast("binary")
    value = F.when(F.col("__written").isNotNull(), F.col("__written.value")).otherwise(F.col("__stored"))
    reply = F.when(F.col("problem").isNotNull(), error).when(F.col("verb") == "GET", bulk(value)).otherwise(simple("OK"))
    return joined.select(*kept, reply.alias("reply"))
