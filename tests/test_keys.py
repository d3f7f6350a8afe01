import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from siltbed.functions import keys, record, status, wal
from tests.conftest import rows


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


KEYS = [b"a", b"", b"key0", b"\x00", b"\xff\x00\x80", bytes(range(64)), "schlüssel".encode()]


def test_hash_is_xxh64_of_seed_0(spark):
    got = {bytes(k): h for k, h in spark.createDataFrame([(k,) for k in KEYS], "k binary").select("k", keys.hash0(F.col("k"))).collect()}
    assert got == {k: signed(xxhash.xxh64(k, seed=0).intdigest()) for k in KEYS}
    assert got[b""] == signed(0xEF46DB3751D8E999) and got[b"a"] == signed(0xD24EC4F1A98C6E5B)


def test_partition_numbers(spark):
    hashes = [signed(xxhash.xxh64(str(i).encode()).intdigest()) for i in range(300)] + [-(1 << 63), (1 << 63) - 1, -1, 0]
    df = spark.createDataFrame([(h,) for h in hashes], "h bigint").select("h", keys.shard8(F.col("h")), keys.ring_bucket(F.col("h")), keys.sub_bucket(F.col("h"), 3))
    for h, shard, bucket, part in df.collect():
        u = h & (2**64 - 1)
        assert (shard, bucket, part) == (abs(h) % 8, u >> 52, (u >> 49) & 7)


def test_order_is_shortlex(spark):
    words = [b"a" * 10, b"a" * 9, b"b" * 10, b"9", b"10", b"\x80", b"\x7f"]
    got = [bytes(r.k) for r in spark.createDataFrame([(w,) for w in words], "k binary").orderBy(*keys.shortlex_sort(F.col("k"))).collect()]
    assert got == sorted(words, key=lambda w: (len(w), w))
    pairs = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, b"a")], "a binary, b binary").select("a", "b", keys.compare3(F.col("a"), F.col("b"))).collect()
    for a, b, c in pairs:
        if a is None:
            assert c is None
            continue
        x, y = (len(a), bytes(a)), (len(b), bytes(b))
        assert c == (x > y) - (x < y)


def test_compare_range(spark):
    data = [("1", "2", "4", -1), ("2", "2", "4", 0), ("4", "2", "4", 1), ("9", None, None, 0), ("10", "2", None, 0), (None, "2", "4", None)]
    df = spark.createDataFrame(data, "k string, lo string, hi string, want int")
    assert all(g == w for g, w in df.select(keys.compare_range(F.col("k"), F.col("lo"), F.col("hi")), "want").collect())


@pytest.mark.parametrize(
    ("stored", "length", "want"),
    [
        (b"key1\x00\x00garbage", 4, b"key1"),
        (b"key1", None, b"key1"),
        (b"key1\r\n", None, b"key1"),
        (b"key1\n", 0, b"key1"),
        (b"key1\x00", None, b"key1"),
        (b"ke\x00y1" + bytes(59), None, b"ke\x00y1"),
        (b"ab\x10" + bytes(61), -1, b"ab\x10"),
        (bytes(64), None, None),
        (b"k\x00\x00", None, b"k\x00"),
        (b"x" * 64, None, b"x" * 64),
        (b"key", 10, b"key"),
        (b"", None, None),
        (None, 3, None),
    ],
)
def test_true_key(spark, stored, length, want):
    got = spark.createDataFrame([(stored, length)], "k binary, n bigint").select(keys.true_key(F.col("k"), F.col("n"))).first()[0]
    assert (bytes(got) if got is not None else None) == want


def test_record_codec(spark):
    data = [(b"key0", b"value", 7, 1, 2, 1, 99), (b"k", None, (1 << 40), 3, 0, 0, 0)]
    df = spark.createDataFrame(data, "k binary, v binary, ver bigint, f bigint, b bigint, t bigint, o bigint")
    c = {n: F.col(n) for n in df.columns}
    out = df.select(record.encode_record(c["k"], c["v"], c["ver"], c["f"], c["b"], c["t"], c["o"], keys.hash0(c["k"])), record.record_size(c["k"], c["v"])).collect()
    for (k, v, ver, f, b, t, o), (raw, size) in zip(data, out, strict=True):
        # The size counts 12 bytes for the key's length and hash, which are written before the key.
        assert size == 45 + len(k) + len(v or b"") == len(raw)
        got = record.decode_record(bytes(raw))
        assert got == {"version": ver, "file_id": f, "block_id": b, "block_type": t, "offset": o, "key_hash": signed(xxhash.xxh64(k).intdigest()), "key": k, "value": v or b""}
        with pytest.raises(ValueError):
            record.decode_record(bytes(raw)[:-1])
    assert out[0][1] == 54


def test_addresses(spark):
    got = spark.range(1).select(record.cache_key(F.lit(1), F.lit(2)), wal.lsn_pack(F.lit(1), F.lit(13)), wal.lsn_file(F.lit((5 << 32) + 7)), wal.lsn_offset(F.lit((5 << 32) + 7)), record.wal_file_name(F.lit(3)), record.sst_file_name(F.lit(4))).first()
    assert tuple(got) == ("4294967298", 4294967309, 5, 7, "3.wal", "4.sst")
    meta = spark.createDataFrame([(5, 7, 7), (5, 7, 6), (5, None, None)], "a bigint, b bigint, c bigint").select(wal.checkpoint_lsn(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in meta.collect()] == [7, 5, 5]


def test_log_payloads(spark):
    put = struct.pack("<I", 3) + b"keyvalue"
    data = [(put, b"key", b"value"), (struct.pack("<I", 3) + b"key", b"key", b""), (b"\x03\x00", None, None), (struct.pack("<I", 9) + b"key", None, None), (struct.pack("<I", 0), None, None), (struct.pack("<I", 65) + b"k" * 65, None, None), (None, None, None)]
    got = spark.createDataFrame([(d,) for d, _, _ in data], "d binary").select(wal.payload_key(F.col("d")), wal.payload_value(F.col("d"))).collect()
    assert [tuple(None if x is None else bytes(x) for x in r) for r in got] == [(k, v) for _, k, v in data]


def test_record_types(spark):
    said = {" Put ": "put", "1": "put", "PUT": "put", "del": "delete", "DELETE ": "delete", "2": "delete", "Flush": "flush", "3": "flush", "0": "none", None: "none", "x": "none"}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", wal.record_type(F.col("t"))).collect()
    assert dict(map(tuple, got)) == said


def test_status_texts(spark):
    data = [(None, "x", "OK"), (0, "", "OK "), (40003, "k", "Not found: k"), (1, "boom", "Error code(1): boom"), (40002, None, "Error: ")]
    got = spark.createDataFrame([(c, m) for c, m, _ in data], "c int, m string").select(status.status_text(F.col("c"), F.col("m"))).collect()
    assert [r[0] for r in got] == [t for _, _, t in data]
    assert str(status.NotFound("k")) == "Not found: k"
    areas = spark.createDataFrame([(c,) for c in (0, 30004, 40001, 60001, 70001)], "c int").select(status.code_area(F.col("c")))
    assert [r[0] for r in areas.collect()] == ["general", "server", "db", "wal", "sst"]
    assert rows(spark.createDataFrame([(70001,)], "c int").select(status.code_area(F.col("c")))) == [("sst",)]


def test_decoding_in_columns(spark):
    data = [(b"key0", b"value", 7, 1, 2, 1, 99), (b"k", None, (1 << 40), 3, 0, 0, 0), (b"z", b"", -5, -1, (1 << 31), 1, (1 << 62))]
    df = spark.createDataFrame(data, "k binary, v binary, ver bigint, f bigint, b bigint, t bigint, o bigint")
    c = {n: F.col(n) for n in df.columns}
    raw = df.select(record.encode_record(c["k"], c["v"], c["ver"], c["f"], c["b"], c["t"], c["o"], keys.hash0(c["k"])).alias("r"))
    got = raw.select(record.decode_columns(F.col("r")).alias("d")).select("d.*").collect()
    for (k, v, ver, f, b, t, o), r in zip(data, got, strict=True):
        assert (bytes(r.key), bytes(r.value), r.version, r.file_id, r.block_id, r.block_type, r.offset) == (k, v or b"", ver, f, b, t, o)
        assert r.key_hash == signed(xxhash.xxh64(k).intdigest())
    bad = raw.select(F.expr("substr(r, 1, length(r) - 1)").alias("r")).unionByName(spark.createDataFrame([(None,), (b"",), (bytes(45),)], "r binary"))
    assert {r[0] for r in bad.select(record.decode_columns(F.col("r"))).collect()} == {None}


def test_names_and_hash_parts(spark):
    got = spark.createDataFrame([(None,), (b"",), (b"k",), (b"k" * 65,)], "k binary").select(keys.key_text(F.col("k"))).collect()
    assert [r[0] for r in got] == ["MIN_BYTE", "MIN_BYTE", "k", "MAX_BYTE"]
    for h in (-1, 0, 12345678901234567, -(1 << 63)):
        u = h & (2**64 - 1)
        parts = keys.hash_parts(F.lit(h).cast("bigint"))
        assert tuple(spark.range(1).select(parts["h1"], parts["h2"], keys.fast_mod(parts["h1"], 64)).first()) == (u >> 7, u & 127, ((u >> 7) & 0xFFFFFFFF) * 64 >> 32)
    assert spark.range(1).select(record.cache_key(F.lit(1 << 32), F.lit(2))).first()[0] is None
    assert status.code_table(spark).count() == status.code_table(spark).select("code").distinct().count()
