"""Key-value operators against plain Python."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from siltbed.functions import resp, status
from siltbed.operators import cache, cursor, layout, log, merge
from siltbed.operators import wal as wal_ops
from siltbed.session import join_small
from siltbed.functions.status import LogError
from siltbed.sources import resp_stream, storage
from siltbed.streaming.upsert import UpsertSink
from siltbed.sources.states import ConcurrentWrite
from siltbed.sources.stored_log import StoredLog
from siltbed.table import KvTable, RunCache
from tests.conftest import rows

shortlex = lambda k: (len(k), k)


def test_latest_and_first(spark):
    data = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "n"), ("b", 0, "m"), (None, 9, "q"), ("a", 3, "z")]
    df = spark.createDataFrame(data, "k string, s int, v string")
    assert rows(log.latest(df, "k", ["s"])) == [("a", 3, "z"), ("b", 0, "m")]
    assert rows(log.first_write_wins(df, "k", ["s"])) == [("a", 1, "x"), ("b", None, "n")]
    assert log.latest(df.limit(0), "k", ["s"]).count() == 0
    gone = df.withColumn("gone", F.col("v") == "z")
    assert rows(log.latest(gone, "k", ["s"], "gone").select("k", "v")) == [("b", "m")]


def test_lookups(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    probes = spark.createDataFrame([("a",), ("c",), (None,), ("a",)], "p string")
    assert rows(log.probe(table, "k", probes, "p", ["v"])) == sorted([("a", 1, True), ("a", 1, True), ("c", None, False), (None, None, False)], key=lambda r: [(v is None, str(v)) for v in r])
    assert rows(log.exists(probes, "p", table, "k")) == [("a",), ("a",)]
    assert rows(log.multi_get(table, "k", probes, "p")) == [("a", 1)]
    assert rows(log.delete(table, "k", probes, "p")) == [("b", 2)]
    assert rows(log.delete_range(table, F.col("k"), F.lit("b"), F.lit(None).cast("string"))) == [("a", 1)]


def test_seek_follows_key_order(spark):
    keys = [f"key{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    one = lambda d: [r.k for r in d.collect()]
    assert one(cursor.seek(df, "k", F.lit("keya"))) == ["key10"]
    assert one(cursor.seek(df, "k", F.lit("key499"))) == ["key499"]
    assert one(cursor.seek(df, "k", F.lit("key500"))) == []
    assert one(cursor.seek_for_prev(df, "k", F.lit("keya"), 2)) == ["key9", "key8"]
    assert one(cursor.first(df, "k")) == ["key0"] and one(cursor.last(df, "k")) == ["key499"]
    got = set(one(cursor.range_scan(df, "k", F.lit("key9"), F.lit("key12"))))
    assert got == {"key9", "key10", "key11"}


def test_scan_and_neighbours(spark):
    rng = random.Random(1)
    keys = sorted({str(rng.randrange(10**6)) for _ in range(400)}, key=shortlex)
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))], "k string").repartition(3)
    assert {r.k: r["rank"] for r in cursor.scan(df, "k").collect()} == {k: i + 1 for i, k in enumerate(keys)}
    got = {r.k: (r.prev_key, r.next_key) for r in cursor.neighbours(df, "k", block=7).collect()}
    assert got == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    assert cursor.scan(df.limit(0), "k").count() == 0


def test_locate(spark):
    rng = random.Random(2)
    keys = sorted({str(rng.randrange(10**5)) for _ in range(300)}, key=shortlex)
    ranges = [(keys[i], keys[i + 9], i // 15) for i in range(0, 285, 15)]
    probes = [str(rng.randrange(10**5)) for _ in range(300)] + [r[0] for r in ranges] + [r[1] for r in ranges] + [None]
    p, r = spark.createDataFrame([(x,) for x in probes], "p string"), spark.createDataFrame(ranges, "lo string, hi string, f bigint")
    key = lambda row: [(v is None, str(v)) for v in row]
    want = [(x, next((f for lo, hi, f in ranges if x is not None and shortlex(lo) <= shortlex(x) <= shortlex(hi)), None)) for x in probes]
    above = [(x, next((f for lo, _, f in reversed(ranges) if x is not None and shortlex(lo) < shortlex(x)), None)) for x in probes]
    for few in (100_000, 3):  # by halving in every task, and by laying out both
        assert rows(cursor.locate(p, "p", r, "lo", "hi", "f", rows=few)) == sorted(want, key=key)
        assert rows(cursor.locate(p, "p", r, "lo", None, "f", strict=True, rows=few)) == sorted(above, key=key)
    assert rows(cursor.locate(p, "p", r.limit(0), "lo", "hi", "f")) == sorted([(x, None) for x in probes], key=key)
    points = spark.createDataFrame([("b", 0), ("d", 1), ("aa", 2)], "k string, restart_no int")
    got = {x.p: x.restart and x.restart.restart_no for x in layout.seek_restart(spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("zz",)], "p string"), "p", points, "k").collect()}
    assert got == {"a": None, "b": None, "c": 0, "d": 0, "zz": 2}


def test_contiguity_over_many_tasks(spark):
    bounds = [(chr(97 + i), chr(98 + i)) for i in range(20)] + [("v", "w"), ("x", "z")]
    df = spark.createDataFrame(random.Random(3).sample(bounds, len(bounds)), "low string, high string").repartition(5)
    got = {r.low: r.contiguous for r in layout.contiguous(df, "low", "high").collect()}
    assert got == {lo: lo not in ("v", "x") for lo, _ in bounds}


def test_blocks_and_restarts(spark):
    df = spark.createDataFrame([("x", i, 40) for i in range(5)], "f string, i int, n int")
    packed = layout.assign_blocks(df, ["f"], [F.col("i")], F.col("n"), 100)
    assert layout.block_counts(packed, ["f"], "block_id").first().blocks == 3
    assert layout.free_space(packed, ["f"], "n", 5, 100).first().room == 60 + 2 * 100
    block = spark.range(600)
    assert layout.restart_points(block, F.col("id")).count() == 32 and layout.restart_points(block, F.col("id"), None).count() == 38


def test_merge_keeps_duplicates_and_compact_drops_them(spark):
    runs = [spark.createDataFrame(d, "k string, v int, ver int") for d in ([("b", 1, 1), ("aa", 1, 1)], [("b", 2, 2)], [("b", 0, 0), ("c", 3, 3)])]
    merged = merge.merge_runs(runs, "k").orderBy("rank").collect()
    assert [(r.k, r.run_no) for r in merged] == [("b", 0), ("b", 1), ("b", 2), ("c", 2), ("aa", 0)]
    assert rows(merge.compact(runs, "k", ["ver"]).select("k", "v")) == [("aa", 1), ("b", 2), ("c", 3)]
    assert [r.k for r in merge.merge_last(runs, "k").collect()] == ["aa"]


def test_overlap_is_closed(spark):
    files = [(1, "b", "d", 0), (2, "a", "b", 1), (3, "d", "f", 1), (4, "aa", "ab", 1), (5, None, None, 1), (6, "a", "a", 1)]
    df = spark.createDataFrame(files, "file_id int, min_key string, max_key string, level int")
    assert {r.file_id for r in merge.pick_overlapping(df, 0, 1).collect()} == {1, 2, 3}
    assert merge.needs_compaction(df, 1, 4).first().needed and not merge.needs_compaction(df, 0).first().needed


@pytest.mark.parametrize("seed", range(3))
def test_block_packing(spark, seed):
    rng = random.Random(seed)
    items = [(f, i, rng.choice([0, 1, 5, 30, 120])) for f in ("x", "y", None) for i in range(150)]
    want, state = {}, {}
    for f, i, n in items:
        block, used = state.get(f, (0, 0))
        if used and used + n > 100:
            block, used = block + 1, 0
        want[f, i] = (block, used)
        state[f] = (block, used + n)
    df = spark.createDataFrame(rng.sample(items, len(items)), "f string, i int, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    read = lambda d: {(r.f, r.i): (r.block_id, r.offset) for r in d.collect()}
    try:
        got = read(layout.assign_blocks(df, ["f"], [F.col("i")], F.col("n"), 100))
        # The same in stretches that all tasks share, as a file with more than 20 records is.
        shared = read(layout.assign_blocks(df.repartition(7), ["f"], [F.col("i")], F.col("n"), 100, hot_rows=20, plain_bytes=0))
        one = layout.assign_blocks(df.where("f = 'x'").repartition(9), [], [F.col("i")], F.col("n"), 100, (3, 40), hot_rows=20, plain_bytes=0)
        plain = layout.assign_blocks(df.where("f = 'x'"), [], [F.col("i")], F.col("n"), 100, (3, 40))
        assert read(one) == read(plain) and min(b for b, _ in read(one).values()) in (3, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want == shared


def test_splits(spark):
    keys = [str(i) for i in range(11)]
    df = spark.createDataFrame([(k, "g") for k in keys], "k string, g string")
    assert layout.median_split(df, "k").first()["key"] == "5"
    assert layout.median_split(df, "k", ["g"]).first()["key"] == "5"
    groups = [(k, g) for g, n in (("a", 1), ("b", 4), (None, 7), ("c", 30)) for k in map(str, range(n))]
    several = spark.createDataFrame(random.Random(1).sample(groups, len(groups)), "k string, g string").repartition(5)
    assert {r.g: (r.key, r.records) for r in layout.median_split(several, "k", ["g"]).collect()} == {"a": ("0", 1), "b": ("2", 4), None: ("3", 7), "c": ("15", 30)}
    assert layout.median_split(df.limit(0), "k").count() == 0
    rng = random.Random(5)
    hashes = [(7 << 52) | rng.randrange(1 << 52) for _ in range(100)] + [(9 << 52) | 1] * 60
    got = {r.bucket: (r.level, r.records, r.largest) for r in layout.hash_split(spark.createDataFrame([(h,) for h in hashes], "h bigint"), "h", limit=40).collect()}
    sizes = lambda level: [sum(((h >> (52 - level)) & ((1 << level) - 1)) == p for h in hashes[:100]) for p in range(1 << level)]
    level = next(n for n in range(6) if max(sizes(n)) < 40)
    # Equal hashes can't be parted; the search goes down to the last bit.
    assert got[7] == (level, 100, max(sizes(level))) and got[9] == (52, 60, 60)
    near = [(5 << 52) | i for i in range(8)]
    df = spark.createDataFrame([(h,) for h in near], "h bigint")
    found = layout.hash_split(df, "h", limit=2)
    assert rows(found) == [(5, 52, 8, 1)]
    assert sorted((r.h, r.part) for r in layout.split_parts(df, "h", found).collect()) == [(h, h & ((1 << 52) - 1)) for h in near]


@pytest.mark.parametrize("chunks", [1, 3, 9])
def test_lru_trace(spark, chunks):
    rng = random.Random(chunks)
    trace = [(i, rng.randrange(40) if rng.random() < 0.7 else 5) for i in range(600)]
    held, want = OrderedDict(), {}
    for i, k in trace:
        want[i] = k in held
        held[k] = None
        held.move_to_end(k)
        if len(held) > 12:
            held.popitem(last=False)
    df = spark.createDataFrame(rng.sample(trace, 600) + [(None, 1), (700, None)], "i bigint, k bigint")
    got = cache.lru_trace(df, "k", "i", 12, chunks).collect()
    assert {r.i: r.hit for r in got} == want
    assert cache.lru_trace(df.limit(0), "k", "i", 12, chunks).count() == 0


def test_wal_numbers(spark):
    df = spark.createDataFrame([("d", i, 37) for i in range(10)], "db string, i int, n int")
    out = {r.i: r.lsn for r in wal_ops.append(df, ["db"], [F.col("i")], F.col("n"), 120).collect()}
    assert [out[i] for i in range(4)] == [(1 << 32) + 50, (1 << 32) + 100, (2 << 32) + 50, (2 << 32) + 100]
    logged = spark.createDataFrame([(n,) for n in out.values()], "lsn bigint")
    assert wal_ops.replay_after(logged, "lsn", F.lit((1 << 32) + 50), F.lit((2 << 32) + 50)).count() == 2
    assert wal_ops.truncate(logged, "lsn", F.lit((3 << 32) + 50)).count() == 6


def test_resp_requests(spark):
    good = [([b"SET", b"k\r\n", b""], None), ([b"GET", b"key"], None), ([b"DEL", bytes(range(256))], None)]
    for arguments, _ in good:
        raw = b"*%d\r\n" % len(arguments) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in arguments)
        assert resp.parse(raw) == (arguments, None)
        for end in range(len(raw)):
            assert resp.parse(raw[:end])[0] is None
    for raw in (b"", b"+OK\r\n", b"*x\r\n", b"*0\r\n", b"*1\r\n$-1\r\n", b"*1\r\n$99999999\r\n", b"*1\r\n$1\r\nab\r\n", b"*1\r\n$1\r\na\r\nmore"):
        assert resp.parse(raw)[0] is None
    sent = spark.createDataFrame([(1, "set", "k", "v"), (2, "get", "k", None), (3, "nope", "k", None)], "i int, verb string, key string, value string")
    raw = sent.select("i", F.when(F.col("i") == 1, resp.request(F.col("verb"), F.col("key"), F.col("value"))).otherwise(resp.request(F.col("verb"), F.col("key"))).alias("data"), F.lit("clash").alias("problem"))
    out = {r.i: (r.verb, r.problem) for r in resp.decode_requests(raw.unionByName(spark.createDataFrame([(4, None, "c")], "i int, data binary, problem string")), "data").collect()}
    assert out == {1: ("SET", None), 2: ("GET", None), 3: (None, "unknown verb"), 4: (None, "no data")}
    table = spark.createDataFrame([(b"k", b"old\r\n")], "key binary, value binary")
    replies = {r.i: bytes(r.reply) for r in resp_stream.replies(raw, "data", ["i"], table).collect()}
    assert replies == {1: b"+OK\r\n", 2: b"$1\r\nv\r\n", 3: b"-ERR unknown verb\r\n"}
    late = {r.i: bytes(r.reply) for r in resp_stream.replies(raw.where("i > 1"), "data", ["i"], table).collect()}
    assert late[2] == b"$5\r\nold\r\n\r\n"
    assert rows(resp_stream.writes(raw, "data", ["i"])) == [(1, b"k", b"v", False)]


def test_join_small_both_ways(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, v int")
    small = spark.createDataFrame([("a", "x"), (None, "n"), ("z", "y")], "k string, w string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(join_small(big, small, ["k"], how)) == rows(join_small(big, small, ["k"], how, rows=2, hot_rows=9, salts=5))
    assert join_small(big, small, ["k"], "inner").count() == 51


def test_table_equals_a_dict(spark, tmp_path):
    rng = random.Random(7)
    table, model = KvTable(spark, f"file://{tmp_path}/t"), {}
    for step in range(9):
        what = rng.choice(["put", "put", "delete", "flush", "compact"]) if step else "put"
        before = rows(table.rows().select("key", "value"))
        if what == "put":
            new = {str(rng.randrange(30)).encode(): f"{step}.{i}".encode() for i in range(12)}
            table.put(spark.createDataFrame(list(new.items()), "key binary, value binary"))
            model |= new
        elif what == "delete":
            gone = [str(rng.randrange(30)).encode() for _ in range(6)]
            table.delete(spark.createDataFrame([(k,) for k in gone], "key binary"))
            model = {k: v for k, v in model.items() if k not in gone}
        else:
            getattr(table, what)()
            assert rows(table.rows().select("key", "value")) == before
        assert dict(rows(table.rows().select("key", "value"))) == model
    order = sorted(model, key=shortlex)
    assert [bytes(r.key) for r in table.scan().orderBy("rank").collect()] == order
    assert [bytes(r.key) for r in table.seek(b"1a", 3).collect()] == [k for k in order if shortlex(k) >= (2, b"1a")][:3]
    again = KvTable(spark, f"file://{tmp_path}/t", create=False)
    assert again.size() == len(model)
    some = order[0]
    assert again.value(some) == model[some]
    with pytest.raises(status.NotFound):
        again.value(b"nothing")
    with pytest.raises(status.InvalidKey):
        again.put(spark.createDataFrame([(b"k" * 65, b"v")], "key binary, value binary"))
    with pytest.raises(status.InvalidPath):
        KvTable(spark, f"file://{tmp_path}/none", create=False)
    found = again.multi_get(spark.createDataFrame([(some, 1), (b"nothing", 2)], "key binary, found int"))
    assert sorted((bytes(r.key), r.found) for r in found.collect()) == sorted([(some, True), (b"nothing", False)])
    assert again.size() == len(model) and again.vacuum() is not None


def test_a_stop_anywhere_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    home = f"file://{tmp_path}/t"
    table = KvTable(spark, home)
    one = spark.createDataFrame([(b"a", b"1"), (b"b", b"1")], "key binary, value binary")
    two = spark.createDataFrame([(b"a", b"2"), (b"c", b"2")], "key binary, value binary")
    table.put(one)
    table.put(spark.createDataFrame([(b"b", b"old")], "key binary, value binary"))
    calls = {"put": lambda t: t.put(two), "delete": lambda t: t.delete(one.select("key")), "flush": lambda t: t.flush(), "compact": lambda t: t.compact()}

    class Stopped(Exception):
        pass

    for name, call in calls.items():
        done, step = False, 0
        while not done:
            before = rows(KvTable(spark, home, create=False).rows().select("key", "value"))
            left = step
            # Every file operation in turn is the last one that happens, or the first that doesn't.
            for target in ("_fs", "publish"):
                real = getattr(storage, target)

                def counting(*arguments, real=real):
                    nonlocal left
                    left -= 1
                    if left < 0:
                        raise Stopped
                    return real(*arguments)

                monkeypatch.setattr(storage, target, counting)
            try:
                call(KvTable(spark, home, create=False))
                done = True
            except Stopped:
                pass
            monkeypatch.undo()
            after = rows(KvTable(spark, home, create=False).rows().select("key", "value"))
            if done or name in ("flush", "compact"):
                assert name not in ("flush", "compact") or after == before
            else:
                assert after == before
            step += 1
        assert step > 5
        want = {"put": [(b"a", b"2"), (b"b", b"old"), (b"c", b"2")]}.get(name, [(b"c", b"2")])
        assert after == want
    other = KvTable(spark, home)
    KvTable(spark, home).put(one)
    with pytest.raises(ConcurrentWrite):
        other.put(two)
    fresh = KvTable(spark, home)
    assert fresh.vacuum() and rows(fresh.rows().select("key")) == [(b"a",), (b"b",), (b"c",)] and len(fresh.manifest.numbers()) == 1


def test_lookups_open_only_files_that_can_hold_the_key(spark, tmp_path):
    cache = RunCache(spark, 2)
    table = KvTable(spark, f"file://{tmp_path}/t", level0_files=None, cache=cache, file_rows=100)
    for low in (0, 200, 100):
        table.put(spark.createDataFrame([(f"{i:03d}".encode(), b"v%d" % i) for i in range(low, low + 100)], "key binary, value binary"))
    assert len(table.state["files"]) >= 3 and len(table.files_for(b"150")) == 1 and table.files_for(b"9") == []
    table.flush()
    before = {f["path"]: f for f in table.state["files"]}
    assert {f["level"] for f in before.values()} == {1} and len(before) > 1
    # Only the files of level 1 that the new one overlaps are merged again.
    table.put(spark.createDataFrame([(b"000", b"new"), (b"001", b"new")], "key binary, value binary"))
    table.delete(spark.createDataFrame([(b"002",)], "key binary"))
    table.flush()
    assert {f["path"] for f in table.state["files"]} & set(before) and table.files_for(b"000")[0] not in before
    assert table.size() == 299 and table.value(b"000") == b"new" and table.counters["flushes"] == 2
    ranges = sorted(((len(f["lo"]), f["lo"]), (len(f["hi"]), f["hi"])) for f in table.state["files"])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    misses = cache.misses
    assert table.value(b"250") == table.value(b"250") and cache.hits and len(cache.held) <= 2 and cache.misses <= misses + 1
    cache.clear()
    plain = KvTable(spark, f"file://{tmp_path}/t")
    assert len(plain.get(b"150").inputFiles()) == 1
    import pyarrow.parquet as pq

    path = str(tmp_path / "t" / table.files_for(b"150")[0])
    assert pq.ParquetFile(path).metadata.row_group(0).column(1).path_in_schema == "key"
    for _ in range(10):
        plain.put(spark.createDataFrame([(b"k", b"v")], "key binary, value binary"))
    assert sum(f["level"] == 0 for f in plain.state["files"]) < 10 and plain.size() == 300
    plain.clear()
    assert plain.size() == 0


def test_late_versions_lose(spark, tmp_path):
    table = KvTable(spark, f"file://{tmp_path}/t")
    table.put(spark.createDataFrame([(b"k", b"new", 9)], "key binary, value binary, version bigint"))
    table.put(spark.createDataFrame([(b"k", b"late", 3)], "key binary, value binary, version bigint"))
    assert table.value(b"k") == b"new"
    table.delete(spark.createDataFrame([(b"k", 10)], "key binary, version bigint"))
    table.flush()
    assert table.size() == 0
    table.put(spark.createDataFrame([(b"k", b"late", 4)], "key binary, value binary, version bigint"))
    assert table.size() == 0


def test_stream_equals_batch(spark, tmp_path):
    data = [(str(i % 17), i, f"v{i}", i % 13 == 0) for i in range(400)]
    random.Random(4).shuffle(data)
    schema = "k string, ver bigint, v string, gone boolean"
    for i in range(12):
        spark.createDataFrame(data[i::12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = UpsertSink(spark, f"file://{tmp_path}/out", "k", ["ver"], "gone", runs_max=3)
    assert sink.table() is None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sink.start(stream, availableNow=True).awaitTermination()
    want = rows(log.latest(spark.createDataFrame(data, schema), "k", ["ver"], "gone"))
    assert rows(sink.table()) == want
    live, replaced = sink._runs()
    assert len(live) <= 2 * 3 and max(r[0] for r in live) == 1 and {r[1:] for r in live}.isdisjoint({r[1:] for r in replaced})
    sink.compact(everything=True)
    assert len(sink._runs()[0]) == 1
    sink.apply(spark.createDataFrame([("0", 10**6, "repeated batch", False)], schema), 0)
    assert rows(sink.table()) == want


def test_recovery_from_a_log(spark, tmp_path):
    schema = "lsn bigint, kind string, key binary, value binary"
    records = [(1, "put", b"a", b"1"), (2, "put", b"b", b"1"), (3, "delete", b"a", None), (4, "none", None, None)]
    table = KvTable(spark, f"file://{tmp_path}/t")
    assert table.recover(spark.createDataFrame(records[:2], schema)) == 2
    assert table.recover(spark.createDataFrame(records[:2], schema)) == 2
    assert table.counters["writes"] == 1 and table.key_version == 2 and table.record_count == 2
    assert table.recover(spark.createDataFrame(records, schema)) == 4
    again = KvTable(spark, f"file://{tmp_path}/t", create=False)
    assert again.checkpoint == 4 and rows(again.rows().select("key", "value")) == [(b"b", b"1")]
    again.manifest.value["checkpoint"] = [2, 9, 4]
    assert again.checkpoint == 2


def test_requests_from_files(spark, tmp_path):
    encode = lambda *a: b"*%d\r\n" % len(a) + b"".join(b"$%d\r\n%s\r\n" % (len(x), x) for x in a)
    sent = [encode(b"SET", b"a", b"1\r\n*1"), encode(b"SET", b"b", b""), encode(b"DEL", b"a"), encode(b"GET", b"b")]
    assert resp.parse_stream(b"".join(sent) + b"*1\r\n$5\r\nab") == (sent, b"*1\r\n$5\r\nab")
    assert resp.parse_stream(b"junk") == ([], b"junk")
    # An argument that is too long is refused; what stands behind it is still read.
    long = encode(b"SET", b"long", b"x" * resp.MAX_ARGUMENT_BYTES)
    assert resp.parse_stream(long + b"".join(sent)) == ([long, *sent], b"")
    assert resp.parse(long) == (None, "argument too long")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "client1").write_bytes(b"".join(sent) + b"junk")
    stream = resp_stream.writes(resp_stream.from_files(spark, str(tmp_path / "in")), "data", resp_stream.ORDER)
    sink = UpsertSink(spark, f"file://{tmp_path}/out", "key", resp_stream.ORDER, "deleted")
    sink.start(stream, availableNow=True).awaitTermination()
    assert rows(sink.table().select("key", "value")) == [(b"b", b"")]


def test_stored_log(spark, tmp_path):
    home = f"file://{tmp_path}/log"
    record = lambda low, high: spark.createDataFrame([(i,) for i in range(low, high)], "i bigint")
    size = F.lit(37)  # 50 bytes with its head, two to a file
    at = lambda i: ((1 + i // 2) << 32) + 50 * (1 + i % 2)
    log = StoredLog(spark, home, 120)
    with pytest.raises(LogError):
        log.read_after(0)
    assert log.append(record(0, 3), [F.col("i")], size) == at(2)
    assert StoredLog(spark, home, 120).append(record(3, 6), [F.col("i")], size) == at(5)
    with pytest.raises(ConcurrentWrite):
        log.append(record(3, 6), [F.col("i")], size)
    log = StoredLog(spark, home, 120)
    assert {r.i: r.lsn for r in log.read_after(0).collect()} == {i: at(i) for i in range(6)}
    log.reset_write(at(3))
    assert rows(log.read_after(at(1)).select("i")) == [(2,), (3,)]
    assert log.append(record(7, 8), [F.col("i")], size) == at(4)
    assert log.append(record(0, 0), [F.col("i")], size) == at(4)
    log.truncate(at(3))
    assert rows(log.read_after(0).select("i")) == [(2,), (3,), (7,)]
    log.reset(at(4))
    assert log.last == 4 << 32 and log.append(record(1, 2), [F.col("i")], size) == (4 << 32) + 50
