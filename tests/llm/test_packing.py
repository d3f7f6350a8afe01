"""Packing against a plain best fit, and what must hold of any packing."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from siltbed.llm import packing


@pytest.mark.parametrize("seed", range(5))
def test_tightest_fit_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 63, 64, 100])
    sizes = sorted((rng.randrange(capacity + 1) for _ in range(500)), reverse=True)
    fit, rooms = packing.TightestFit(capacity), {}
    for s in sizes:
        best = min((r for r in rooms.values() if r >= s), default=None)
        assert fit.tightest(s) == best
        number = fit.place(s)
        assert (rooms[number] == best) if best is not None else number not in rooms
        rooms[number] = rooms.get(number, capacity) - s
    assert min(rooms.values()) >= 0


def packed(spark, items, **options):
    df = spark.createDataFrame(items, "d bigint, n bigint").withColumn("container", F.lit("clash"))
    return packing.pack(df, "d", "n", **options).collect()


@pytest.mark.parametrize("rounds", [(0,), (3, 0), (6, 3, 0), (12, 6, 0)])
def test_everything_is_packed_once_and_well(spark, rounds):
    rng = random.Random(8)
    items = [(i, min(int(rng.lognormvariate(4, 1.2)), 900)) for i in range(1500)] + [(2000, 0), (2001, None), (2002, -3), (2003, 250), (2004, 100), (2005, 101)]
    out = packed(spark, items, capacity=100, rounds=rounds)
    per = {}
    for r in out:
        per.setdefault(r.d, []).append((r.piece, r.start_at, r.n))
    for d, n in items:
        n = max(n or 0, 0)
        pieces = sorted(per.pop(d))
        assert [p for p, _, _ in pieces] == list(range(max(1, -(-n // 100))))
        assert [a for _, a, _ in pieces] == [100 * p for p, _, _ in pieces] and sum(s for _, _, s in pieces) == n
        assert all(s == 100 for _, _, s in pieces[:-1])
    assert not per
    fill = {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n
    assert max(fill.values()) <= 100
    total = sum(fill.values())
    assert len(fill) <= -(-total // 100) * 1.03 + 1


def test_one_more_item_leaves_most_where_they_are(spark):
    rng = random.Random(9)
    items = [(i, rng.randrange(1, 60)) for i in range(8000)]
    before, after = ({r.d: r.container for r in packed(spark, more, capacity=100, rounds=(6, 0))} for more in (items, [*items, (9000, 40)]))
    assert sum(before[d] != after[d] for d, _ in items) < len(items) / 2


def test_small_cases(spark):
    assert packed(spark, []) == []
    assert len({r.container for r in packed(spark, [(1, 60), (1, 60), (None, 40), (None, 40)], capacity=100)}) == 2
    assert len({r.container for r in packed(spark, [(1, 0), (2, None)], capacity=5)}) == 1


def test_tokens_of_texts(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    texts = [(1, "abab"), (2, ""), (3, None), (4, "é"), (5, "x" * 5000), (6, "<|endoftext|>")]
    df = spark.createDataFrame(texts, "d bigint, t string").withColumn("id", F.lit(0))
    got = {r.d: r.n_tokens for r in packing.token_counts(df, "d", "t", str(path)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 2, 5: 5000, 6: 13}
    spark.conf.set("siltbed.tokenizer", str(path))
    try:
        out = packing.containers(df, "d", "t", 2048).collect()
    finally:
        spark.conf.unset("siltbed.tokenizer")
    assert sorted((r.piece, r.n_tokens) for r in out if r.d == 5) == [(0, 2048), (1, 2048), (2, 904)]
    assert {r.d for r in out} == {1, 2, 3, 4, 5, 6}
