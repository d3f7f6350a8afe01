"""Log records: type names, keys inside the payload, sequence numbers, checkpoint triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUT, DELETE, FLUSH, NONE = "put", "delete", "flush", "none"

# Spellings of a record type after trimming and lower-casing, the numbers included.
TYPE_SPELLINGS = {
    PUT: ["put", "p", "1"],
    DELETE: ["delete", "del", "d", "2"],
    FLUSH: ["flush", "f", "3"],
}


def record_type(spelling: Column) -> Column:
    """``put``, ``delete``, ``flush`` or ``none``; anything unknown and NULL are ``none``."""
    plain = F.lower(F.regexp_replace(spelling, r"^\s+|\s+$", ""))
    out = F
    for name, forms in TYPE_SPELLINGS.items():
        out = out.when(plain.isin(forms), name)
    return out.otherwise(NONE)


def u32(data: Column, at: int) -> Column:
    """The little-endian unsigned number in bytes ``at`` to ``at + 3`` (from 1) as BIGINT; NULL if they aren't all there."""
    byte = lambda i: F.hex(F.substr(data, F.lit(at + i), F.lit(1)))
    number = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("bigint")
    return F.when(F.octet_length(data) >= at + 3, number)


def payload_key(data: Column) -> Column:
    """The key of a Put or Delete payload: length (4 bytes, little endian), key, value.

    NULL if the payload is too short for the length it states, or that isn't 1 to 64.
    """
    n = u32(data, 1)
    fits = n.between(1, 64) & (F.octet_length(data) >= n + 4)
    return F.when(fits, F.substr(data, F.lit(5), n.cast("int")))


def payload_value(data: Column) -> Column:
    n = u32(data, 1)
    fits = n.between(1, 64) & (F.octet_length(data) >= n + 4)
    return F.when(fits, F.substr(data, (n + 5).cast("int"), F.greatest(F.octet_length(data) - n.cast("int") - 4, F.lit(0))))


def whole(data: Column, size: Column) -> Column:
    """Whether a delivery came complete: its payload has exactly the stated size."""
    return F.coalesce(F.octet_length(data).cast("bigint") == size, F.lit(False))


def lsn_pack(file_no: Column, offset: Column) -> Column:
    return F.shiftleft(file_no.cast("bigint"), 32).bitwiseOR(offset.cast("bigint"))


def lsn_file(lsn: Column) -> Column:
    return F.shiftright(lsn, 32)


def lsn_offset(lsn: Column) -> Column:
    return lsn.bitwiseAND(F.lit(4294967295))


def checkpoint_lsn(previous: Column, new: Column, copy: Column) -> Column:
    """The checkpoint to trust: the new one if both its copies agree, else the previous one."""
    return F.when(new == copy, copy).otherwise(previous)
