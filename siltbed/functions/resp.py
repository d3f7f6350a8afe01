"""The request and reply format of the key-value protocol: arrays of bulk strings.

Requests are parsed by the lengths they state, so arguments may hold any bytes, line ends
included, and may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
MAX_ARGUMENT_BYTES = 8 * 1024 * 1024
_LINE = re.compile(rb"([*$])(\d{1,18})\r\n")


def bulk(value: Column) -> Column:
    """A bulk string as bytes; NULL is the null reply."""
    raw = value.cast("binary")
    head = F.concat(F.lit("$"), F.octet_length(raw).cast("string"), F.lit(CRLF)).cast("binary")
    return F.coalesce(F.concat(head, raw, F.lit(CRLF).cast("binary")), F.lit(f"$-1{CRLF}").cast("binary"))


def request(*arguments: Column) -> Column:
    """A request as bytes; a NULL argument is sent empty."""
    head = F.lit(f"*{len(arguments)}{CRLF}").cast("binary")
    return F.concat(head, *[bulk(F.coalesce(a.cast("binary"), F.unhex(F.lit("")))) for a in arguments])


def simple(text: str) -> Column:
    return F.lit(f"+{text}{CRLF}").cast("binary")


def parse(data: bytes) -> tuple[list[bytes] | None, str | None]:
    """(arguments, None), or (None, what is wrong)."""

    def line(at: int, mark: bytes) -> tuple[int, int] | None:
        end = data.find(b"\r\n", at)
        if data[at : at + 1] != mark or end < 0 or not data[at + 1 : end].isdigit():
            return None
        return int(data[at + 1 : end]), end + 2

    head = line(0, b"*")
    if head is None:
        return None, "no array"
    count, at = head
    if not count:
        return None, "no argument"
    out = []
    for _ in range(count):
        size = line(at, b"$")
        if size is None:
            return None, "no bulk string"
        n, at = size
        if n >= MAX_ARGUMENT_BYTES:
            return None, "argument too long"
        if data[at + n : at + n + 2] != b"\r\n":
            return None, "cut off"
        out.append(data[at : at + n])
        at += n + 2
    return (out, None) if at == len(data) else (None, "bytes behind the request")


def parse_stream(data: bytes) -> tuple[list[bytes], bytes]:
    """The whole requests at the beginning of ``data``, as bytes, and what is left (a request not yet complete, or broken).

    A request with an argument that is too long is whole too: it is skipped by the length it states.
    """
    out, at = [], 0
    while at < len(data):
        end = _request_end(data, at)
        if end is None:
            break
        out.append(data[at:end])
        at = end
    return out, data[at:]


def _request_end(data: bytes, at: int) -> int | None:
    head = _LINE.match(data, at)
    if head is None or head[1] != b"*" or not int(head[2]):
        return None
    at = head.end()
    for _ in range(int(head[2])):
        size = _LINE.match(data, at)
        if size is None or size[1] != b"$":
            return None
        at = size.end() + int(size[2]) + 2
        if at > len(data) or data[at - 2 : at] != b"\r\n":
            return None
    return at


def split_requests(rows: DataFrame, data: str) -> DataFrame:
    """One row per request that was sent one behind the other in ``data``: all columns, ``request_no`` (from 0) and ``request``.

    What isn't a whole request at the end comes out as a last row, to be judged by
    ``decode_requests``. NULL and empty data have no request.
    """
    kept = [c for c in rows.columns if c not in {data, "request_no", "request"}]
    source = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{data}`").cast("binary").alias("__resp")).where(F.octet_length("__resp") > 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, requests = [], [], []
            for place, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found, rest = parse_stream(raw)
                for number, one in enumerate([*found, rest] if rest else found):
                    at.append(place)
                    numbers.append(number)
                    requests.append(one)
            taken = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(numbers, pa.int32()), pa.array(requests, pa.binary())], names=[*kept, "request_no", "request"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__resp"]
    return source.mapInArrow(split, ", ".join([*fields, "request_no int", "request binary"]))


def decode_requests(rows: DataFrame, data: str) -> DataFrame:
    """``rows`` with ``verb`` (upper case), ``key``, ``value`` (BINARY) and ``problem``.

    GET takes a key, SET a key and a value, DEL a key; another verb, or another number of
    arguments, is a problem. NULL data is the problem "no data". The four columns replace
    ones of the same name.
    """
    added = ["verb", "key", "value", "problem"]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in added or c == data]
    source = rows.select(*kept, F.col(f"`{data}`").cast("binary").alias("__resp"))
    names = [c for c in source.columns if c != "__resp" and c not in added]
    source = source.select(*[F.col(f"`{c}`") for c in names], "__resp")
    wanted = {b"GET": 2, b"SET": 3, b"DEL": 2}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verbs, keys, values, problems = [], [], [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                arguments, problem = parse(raw) if raw is not None else (None, "no data")
                if arguments is not None:
                    verb = arguments[0].upper()
                    if verb not in wanted:
                        problem = "unknown verb"
                    elif len(arguments) != wanted[verb]:
                        problem = "wrong number of arguments"
                good = arguments if problem is None else None
                verbs.append(good[0].upper().decode() if good else None)
                keys.append(good[1] if good else None)
                values.append(good[2] if good and len(good) > 2 else None)
                problems.append(problem)
            columns = [*batch.columns[:-1], pa.array(verbs, pa.string()), pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__resp"]
    return source.mapInArrow(decode, ", ".join([*fields, "verb string", "key binary", "value binary", "problem string"]))
