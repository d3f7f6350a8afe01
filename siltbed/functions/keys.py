"""Keys: total order, hashing, partition numbers, and the key inside a stored buffer.

A key is 1 to 64 bytes. The order is shortlex: shorter keys first, equal lengths by
unsigned bytes. NULL stands for "no key" and "no bound"; the empty key does not exist.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY_BYTES = 64
#: xxhash64 with this literal first leaves the state 0, so the key is hashed with seed 0.
_SEED_ZERO = -365884300664092260
RING_BITS = 12


def key_length(key: Column) -> Column:
    return F.octet_length(key).cast("bigint")


def shortlex(key: Column) -> Column:
    """An orderable struct; ``min``, ``max`` and ``sort`` over it follow the key order."""
    return F.struct(F.octet_length(key).alias("n"), key.alias("k"))


def shortlex_sort(key: Column, descending: bool = False) -> list[Column]:
    parts = [F.octet_length(key), key]
    return [c.desc() for c in parts] if descending else [c.asc() for c in parts]


def key_less(a: Column, b: Column) -> Column:
    na, nb = F.octet_length(a), F.octet_length(b)
    return (na < nb) | ((na == nb) & (a < b))


def key_at_least(a: Column, b: Column) -> Column:
    na, nb = F.octet_length(a), F.octet_length(b)
    return (na > nb) | ((na == nb) & (a >= b))


def compare3(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NULL if either key is NULL."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(key_less(a, b), -1).when(a == b, 0).otherwise(1).cast("int")


def compare_range(key: Column, low: Column, high: Column) -> Column:
    """-1 below [low, high), 0 inside, 1 at or above high; a NULL bound is open."""
    return (
        F.when(key.isNull(), F.lit(None)).when(low.isNotNull() & key_less(key, low), -1).when(high.isNotNull() & key_at_least(key, high), 1).otherwise(0).cast("int")
    )


def valid_key(key: Column) -> Column:
    return F.coalesce(F.octet_length(key).between(1, MAX_KEY_BYTES), F.lit(False))


def hash0(key: Column) -> Column:
    """XXH64 with seed 0 as a signed BIGINT; NULL for NULL."""
    return F.when(key.isNotNull(), F.xxhash64(F.lit(_SEED_ZERO).cast("bigint"), key.cast("binary")))


def shard8(h: Column, shards: int = 8) -> Column:
    """abs(h % 8) with the remainder of the sign of ``h``."""
    return F.abs(h % F.lit(shards)).cast("int")


def ring_bucket(h: Column, bits: int = RING_BITS) -> Column:
    """The top ``bits`` bits of the hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def sub_bucket(h: Column, level: Column | int, bits: int = RING_BITS) -> Column:
    """The ``level`` bits of the hash below the ring bits."""
    level = F.lit(level) if isinstance(level, int) else level
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - F.lit(1)
    return F.call_function("shiftrightunsigned", h, F.lit(64 - bits) - level).bitwiseAND(mask)


def hash_parts(h: Column) -> Column:
    """(h1, h2): the upper 57 bits of the hash, which choose where to look, and the lower 7, which mark a slot."""
    return F.struct(F.shiftrightunsigned(h, 7).alias("h1"), h.bitwiseAND(F.lit(127)).cast("int").alias("h2"))


def fast_mod(x: Column, n: int) -> Column:
    """A number below ``n`` from the low 32 bits of ``x``: multiplied by ``n``, the upper half taken."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(low * F.lit(n), 32).cast("int")


def key_text(key: Column) -> Column:
    """A key as text; no key and the key beyond all others have names of their own."""
    n = F.octet_length(key)
    return F.when(key.isNull() | (n == 0), "MIN_BYTE").when(n > MAX_KEY_BYTES, "MAX_BYTE").otherwise(key.cast("binary").cast("string"))


def true_key(stored: Column, length: Column, buffer_bytes: int = MAX_KEY_BYTES) -> Column:
    """The key inside a stored buffer.

    A positive ``length`` says how many bytes count. Without it (NULL, 0 or negative) the
    writer's trailer is taken off: CR LF or LF at the end, the fill of a whole buffer of
    ``buffer_bytes`` with zero bytes, or one closing zero byte of a shorter one. Zero bytes
    inside stay. No key is left (NULL buffer, only fill): NULL.
    """
    n = F.octet_length(stored)
    head = lambda drop: F.substr(stored, F.lit(1), n - F.lit(drop))
    tail = lambda size: F.substr(stored, F.greatest(n - F.lit(size - 1), F.lit(1)), F.lit(size))
    unfilled = F.unhex(F.regexp_replace(F.hex(stored), "(?:00)+$", ""))
    bare = (
        F.when(tail(2) == F.unhex(F.lit("0D0A")), head(2))
        .when(tail(1) == F.unhex(F.lit("0A")), head(1))
        .when((tail(1) == F.unhex(F.lit("00"))) & (n >= buffer_bytes), unfilled)
        .when(tail(1) == F.unhex(F.lit("00")), head(1))
        .otherwise(stored)
    )
    key = F.when(length > 0, F.substr(stored, F.lit(1), length.cast("int"))).otherwise(bare)
    return F.when(F.octet_length(key) > 0, key)
