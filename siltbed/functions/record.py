"""Sizes, addresses and the byte layout of records."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a record's head and of the key's length and hash; sizes of blocks and of what a sorted block keeps for its header.
HEAD_BYTES, KEY_HEAD_BYTES = 33, 12
BLOCK_BYTES, BLOCK_HEADER_BYTES, FILE_HEADER_BYTES = 65_536, 256, 1_048_576
WAL_HEAD_BYTES = 13
RESTART_EVERY, RESTARTS_MAX = 16, 32
KEEP_FREE_BYTES = 128

_HEAD = struct.Struct("<IQQIBQIq")


def record_size(key: Column, value: Column) -> Column:
    """Encoded bytes of a record: 33 + (key + 12) + value; an unset value has 0 bytes."""
    return F.octet_length(key).cast("bigint") + F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + F.lit(HEAD_BYTES + KEY_HEAD_BYTES)


def cache_key(file_id: Column, block_id: Column) -> Column:
    """The decimal text of file << 32 | block; NULL if either is negative or doesn't fit its half."""
    fits = file_id.between(0, (1 << 31) - 1) & block_id.between(0, (1 << 32) - 1)
    return F.when(fits, _cache_key(file_id, block_id))


def _cache_key(file_id: Column, block_id: Column) -> Column:
    return F.shiftleft(file_id.cast("bigint"), 32).bitwiseOR(block_id.cast("bigint")).cast("string")


def block_of(offset: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    return F.floor(offset.cast("bigint") / block_bytes).cast("bigint")


def offset_in_block(offset: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    return offset.cast("bigint") % block_bytes


def is_full(offset: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether a block with so many bytes used counts as full."""
    return offset + KEEP_FREE_BYTES >= block_bytes


def wal_file_name(number: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(".wal"))


def sst_file_name(number: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(".sst"))


def _little(value: Column, size: int) -> Column:
    """The low ``size`` bytes of a whole number, little endian."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.concat(*[F.unhex(F.substr(digits, F.lit(15 - 2 * i), F.lit(2))) for i in range(size)])


def encode_record(key: Column, value: Column, version: Column, file_id: Column, block_id: Column, block_type: Column, offset: Column, key_hash: Column) -> Column:
    """The record as bytes: length, version, file, block, type, offset, key length, key hash, key, value."""
    head = [(record_size(key, value), 4), (version, 8), (file_id, 8), (block_id, 4), (block_type, 1), (offset, 8), (F.octet_length(key), 4), (key_hash, 8)]
    return F.concat(*[_little(c, n) for c, n in head], key.cast("binary"), F.coalesce(value.cast("binary"), F.unhex(F.lit(""))))


def _number(digits: Column, at: int, size: int) -> Column:
    """The little-endian number in ``size`` bytes from byte ``at`` (from 0) of hexadecimal text."""
    byte = lambda i: F.substr(digits, F.lit(2 * (at + i) + 1), F.lit(2))
    part = lambda first, n: F.conv(F.concat(*[byte(first + i) for i in reversed(range(n))]), 16, 10).cast("bigint")
    return part(0, size) if size < 8 else F.shiftleft(part(4, 4), 32).bitwiseOR(part(0, 4))


def decode_columns(data: Column) -> Column:
    """What ``encode_record`` wrote, as a struct of version, file_id, block_id, block_type, offset, key_hash, key and value.

    NULL for NULL and where the lengths in the head don't fit the data.
    """
    digits, n = F.hex(F.substr(data, F.lit(1), F.lit(_HEAD.size))), F.octet_length(data)
    key_length = _number(digits, 33, 4)
    fits = (n >= _HEAD.size) & (_number(digits, 0, 4) == n) & (key_length <= n - _HEAD.size)
    fields = F.struct(
        _number(digits, 4, 8).alias("version"),
        _number(digits, 12, 8).alias("file_id"),
        _number(digits, 20, 4).alias("block_id"),
        _number(digits, 24, 1).cast("int").alias("block_type"),
        _number(digits, 25, 8).alias("offset"),
        _number(digits, 37, 8).alias("key_hash"),
        F.substr(data, F.lit(_HEAD.size + 1), key_length.cast("int")).alias("key"),
        F.substr(data, key_length.cast("int") + (_HEAD.size + 1), n).alias("value"),
    )
    return F.when(fits, fields)


def decode_record(data: bytes) -> dict:
    """What ``encode_record`` wrote; raises ValueError if the lengths don't fit the data."""
    if len(data) < _HEAD.size:
        raise ValueError("shorter than a record's head")
    length, version, file_id, block_id, kind, offset, key_length, key_hash = _HEAD.unpack_from(data)
    body = data[_HEAD.size :]
    if length != len(data) or key_length > len(body):
        raise ValueError("the lengths in the head don't fit the data")
    return {"version": version, "file_id": file_id, "block_id": block_id, "block_type": kind, "offset": offset, "key_hash": key_hash, "key": body[:key_length], "value": body[key_length:]}
