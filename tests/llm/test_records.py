"""Survivors and the index of seen keys against plain Python."""

import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.llm import seen, survivors
from tests.conftest import rows

SLICES = "rec_id bigint, db_name string, key_ binary, key_length_ bigint, version_ bigint, file_id_ bigint, block_id_ bigint, offset_ bigint, data_length_ bigint, value_ binary, seq_ bigint, stored_at timestamp_ntz"
FILES = "manifest_no bigint, db_name string, file_id bigint, file_size_ bigint, file_type tinyint, file_status tinyint, file_level tinyint"


# p1


def voted(records, half_life):
    """{key: value} by the rule, in exact fractions: votes halve with age; then rank; then the larger value as text."""
    groups = {}
    for key, ident, value, trust, age, rank in records:
        if key is not None:
            best = groups.setdefault(key, {})
            ballot = (rank, value, trust, age)
            if ident not in best or best[ident] < ballot:
                best[ident] = ballot
    out = {}
    for key, copies in groups.items():
        tally = {}
        for rank, value, trust, age in copies.values():
            if value is not None:
                n, r = tally.get(value, (0, -1))
                whole, rest = divmod(max(age, 0), half_life)
                tally[value] = (n + Fraction(trust * round(2 ** (20 - rest / half_life)), 1 << (20 + whole)), max(r, rank))
        winner = max(tally, key=lambda v: (*tally[v], str(v))) if tally else None
        out[key] = (winner, len(copies) > 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_votes_equal_the_model(spark, seed):
    rng = random.Random(seed)
    records = []
    for i in range(400):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "d", None])
        records.append((key, i, rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.randrange(30), i % 50))
    records += rng.sample(records, 60)
    df = spark.createDataFrame(records, "k string, i bigint, v bigint, t int, age int, r bigint").withColumn("votes", F.lit("clash")).repartition(5)
    field = survivors.Field("v", F.col("v"), F.col("t"))
    out = survivors.survivors(df, {"k": F.col("k")}, F.col("i"), [field], [F.col("r")], F.col("age"), 7)
    assert {r.k: (r.v, r.copies_differ) for r in out.collect()} == voted(records, 7)
    assert survivors.survivors(df.limit(0), {"k": F.col("k")}, F.col("i"), [field], [F.col("r")]).count() == 0


def test_votes_of_any_age_still_count(spark):
    """Old votes decide as young ones do: by trust and by their differences in age, thousands of half-lives ago too."""
    records = []
    for key, age in (("young", 0), ("old", 21 * 7), ("older", 60 * 7), ("ancient", 3000 * 7)):
        # Two newer copies of value 1 outweigh three of value 2 that are a half-life older; by rank value 2 would win.
        records += [(key, i, 1, 1, age, 1) for i in range(2)] + [(key, 10 + i, 2, 1, age + 7, 5) for i in range(3)]
    records += [("trusted", 1, 1, 3, 5000, 1), ("trusted", 2, 2, 2, 5000, 9), ("even", 1, 1, 2, 7, 1), ("even", 2, 2, 1, 0, 0), ("part", 1, 1, 1, 3, 1), ("part", 2, 2, 1, 4, 9)]
    df = spark.createDataFrame(records, "k string, i bigint, v bigint, t int, age int, r bigint")
    out = survivors.survivors(df, {"k": F.col("k")}, F.col("i"), [survivors.Field("v", F.col("v"), F.col("t"))], [F.col("r")], F.col("age"), 7)
    got = {r.k: r.v for r in out.collect()}
    assert got == {**{r[0]: r[1] for r in voted(records, 7).items() for r in [(r[0], r[1][0])]}} == {"young": 1, "old": 1, "older": 1, "ancient": 1, "trusted": 1, "even": 1, "part": 1}


def test_votes_overrule_the_rank(spark, sf):
    from siltbed.llm import queries_records

    told = queries_records.p1_overruled(spark, sf).agg(F.sum("keys"), F.sum("overruled")).first()
    assert 0 < told[1] < told[0]


def test_fields_are_decided_apart_and_keep_their_types(spark):
    data = [("k", 1, b"\x00\xff", None, None), ("k", 2, None, dt.date(2025, 1, 2), 5), ("k", None, b"z", None, None), ("one", 3, None, None, None), ("one", 3, None, None, None)]
    df = spark.createDataFrame(data, "k string, i bigint, b binary, d date, t int")
    fields = [survivors.Field("b", F.col("b"), F.lit(1)), survivors.Field("d", F.col("d"), F.col("t"))]
    got = {r.k: (r.b and bytes(r.b), r.d, r.copies_differ) for r in survivors.survivors(df, {"k": F.col("k")}, F.col("i"), fields, [F.col("i")]).collect()}
    assert got == {"k": (b"\x00\xff", dt.date(2025, 1, 2), True), "one": (None, None, False)}


def test_best_copies(spark):
    t = dt.datetime(2025, 1, 1)
    def copy(rec, key, version, seq, value, size, file, length=None, db="d"):
        return (rec, db, key, length, version, file, 1, 2, size, value, seq, t)

    slices = [
        copy(1, b"k\n", 5, 1, b"v", 47, 1),  # complete, live: best for both but for newer ones
        copy(2, b"kXX", 9, 1, None, 0, 2, length=1),  # newest, no value, file deleted
        copy(3, b"k", 7, 1, b"vv", 47, 1),  # size doesn't fit
        copy(4, b"k", None, 9, b"v", 0, 1),  # version 0
        copy(5, b"m", 1, 1, None, 0, None),
        copy(6, b"m", 1, 2, b"v", 99, 3),  # none complete, no live file: first copy
        copy(7, b"alone", 1, 1, b"v", 0, 1),
        copy(7, b"alone", 1, 1, b"v", 0, 1),  # a repeated row is no second copy
        copy(8, None, 1, 1, b"v", 0, 1),
        copy(9, b"k", 1, 1, b"v", 47, 1, db="e"),
        copy(10, b"k", 1, 2, b"w", None, 1, db="e"),  # unset size: not complete
    ]
    files = [(1, "d", 1, 9, 1, 1, 1), (2, "d", 1, 9, 1, 0, 1), (3, "d", 2, 9, 1, 1, 1)]
    s, f = spark.createDataFrame(slices, SLICES), spark.createDataFrame(files, FILES)
    got = rows(survivors.best_copies(s, f))
    assert got == sorted([("d", b"k", 1, 3), ("d", b"m", 6, 6), ("e", b"k", 9, 10)], key=str)
    assert survivors.best_copies(s.limit(0), f).count() == 0
    assert survivors.best_copies(s, f.limit(0)).count() == 3
    assert survivors.fused_records(s, f, "2025-06-01").count() == 3


# p4


@pytest.mark.parametrize("seed", range(5))
def test_elias_fano_round_trip_and_successors(seed):
    rng = np.random.default_rng(seed)
    for n, top in ((1, 0), (1, 2**51), (2, 5), (700, 800), (1000, 2**52 - 1), (1024, 10**7)):
        offsets = np.unique(np.append(rng.integers(0, top, n, dtype=np.uint64, endpoint=True), np.uint64(0)))
        width, low, high = seen.encode(offsets)
        segment = seen.Segment(len(offsets), width, low, high)
        assert (segment.all() == offsets).all()
        probes = np.unique(np.concatenate((offsets, offsets + np.uint64(1), rng.integers(0, 2 * top + 9, 50, dtype=np.uint64))))
        found, there = segment.successor(probes)
        at = np.searchsorted(offsets, probes)
        assert (there == (at < len(offsets))).all()
        assert (found[there] == offsets[at[there]]).all()


def model(history, records):
    known, out = set(history), []
    for order, h in sorted(records):
        if h in known:
            out.append(order)
        known.add(h)
    return out


@pytest.mark.parametrize("bits", [64, 14])
def test_seen_before_equals_a_set(spark, bits):
    rng = random.Random(bits)
    keys = [f"key{i}".encode() for i in range(3000)]
    history = [rng.choice(keys[:2000]) for _ in range(2500)] + [b"hot"] * 400
    records = [(i, b"hot" if rng.random() < 0.3 else rng.choice(keys)) for i in range(1500)]
    hashed = lambda d: d.select("*", seen.key_hash(F.col("k"), bits).alias("h"))
    h = hashed(spark.createDataFrame([(k,) for k in history] + [(None,)], "k binary")).select("h")
    r = hashed(spark.createDataFrame(records + records[:40] + [(None, b"x"), (5000, None)], "i bigint, k binary")).withColumn("at", F.lit("clash"))
    code = {bytes(x.k): x.h for x in hashed(spark.createDataFrame([(k,) for k in {*keys, b"hot"}], "k binary")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = [x.i for x in seen.seen_before(h, r, "i", "h").collect()]
        assert sorted(got) == model([code[k] for k in history], [(i, code[k]) for i, k in records])
        # The same through an index that grows batch by batch.
        index, out = seen.build(h), []
        for low in (0, 500, 1000):
            part = r.where((F.col("i") >= low) & (F.col("i") < low + 500))
            out += [x.i for x in seen.seen_before(None, part, "i", "h", index).collect()]
            index = seen.extend(index, part.select("h"))
        assert sorted(out) == sorted(got)
        stored = {v for row in index.collect() for v in (seen.Segment(row.n, row.width, bytes(row.low), bytes(row.high)).all().astype(np.int64) + row.base).tolist()}
        assert stored == {code[k] for k in history} | {code[k] for _, k in records}
        assert index.agg(F.sum("n")).first()[0] == len(stored)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen.seen_before(h.limit(0), r.limit(0), "i", "h").count() == 0
    assert sorted(x.i for x in seen.seen_before(h.limit(0), r, "i", "h").collect()) == model([], [(i, code[k]) for i, k in records])


def test_index_is_small(spark):
    """About 2 + log2(2^64 / n) bits a key, against 64 for the hashes themselves."""
    n = 200_000
    index = seen.build(spark.range(n).select(seen.key_hash(F.col("id").cast("string").cast("binary")).alias("h")))
    bits = index.agg(F.sum((F.octet_length("low") + F.octet_length("high")) * 8)).first()[0] / n
    assert bits < 2.7 + 64 - np.log2(n)
