"""Incremental runs, change feed and consolidation on small hand-made and random inputs."""

import datetime as dt
import os
import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltbed.operators import binpack, changefeed, consolidate, incremental
from siltbed.sources import storage
from tests.conftest import rows

T0 = dt.datetime(2025, 1, 1)
WAL = "delivery_id bigint, db_name string, lsn bigint, log_type string, log_size bigint, log_data binary, received_at timestamp_ntz"
CKPT = "ckpt_id bigint, db_name string, written_at timestamp_ntz, read_at timestamp_ntz, checkpoint_ bigint, lsn_new bigint, lsn_copy bigint"


def put(key, value=b"v"):
    return struct.pack("<I", len(key)) + key + value


# p2


def test_pending_is_null_safe_and_keeps_clashing_columns(spark):
    listing = spark.createDataFrame([("a", 1, "x", 5), ("b", None, "y", 6), (None, 2, "z", 7), ("c", 3, "new", 8), ("c", 3, "new", 8)], "path string, size bigint, checksum string, __done_0 int")
    manifest = spark.createDataFrame([("a", 1, "x", "m"), ("b", None, "y", "m"), (None, 2, "z", "m"), ("c", 3, "old", "m")], "path string, size bigint, checksum string, other string")
    out = incremental.pending(listing.drop("__done_0"), manifest, ["path", "size", "checksum"])
    assert rows(out) == [("c", 3, "new")] * 2
    assert incremental.pending(listing, manifest.limit(0), ["path", "size", "checksum"]).count() == 5
    assert incremental.pending(listing.limit(0), manifest, ["path"]).count() == 0


def test_unhandled_records(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    good = lambda i, db, lsn, data, at: (i, db, lsn, "Put", len(data), data, at)
    wal = [
        good(1, "a", 10, put(b"k1"), h(1)),  # handled
        good(2, "a", 20, put(b"k2"), h(9)),  # came after the run read
        good(3, "a", 30, put(b"k3"), h(1)),  # beyond the checkpoint
        good(4, "a", 12, put(b"k4"), h(1)),
        good(5, "a", 12, put(b"k4", b"new"), h(8)),  # rewritten after
        good(6, "a", 13, put(b"k5"), h(1)),
        good(7, "a", 13, put(b"k5"), h(9)),  # only delivered again
        good(8, "a", 14, put(b"k6"), h(1)),
        good(9, "a", 14, put(b"k6", b"x"), h(2)),
        good(10, "a", 14, put(b"k6"), h(9)),  # written back to what was seen
        (11, "a", 15, "Put", 99, put(b"cut"), h(1)),  # not whole
        good(12, "b", 1, put(b"k"), h(1)),  # no successful run
        good(13, None, 1, put(b"k"), h(1)),
        (14, "a", 16, None, None, None, None),
        good(15, "a", 17, put(b"t"), None),  # no time: older than any
    ]
    ckpt = [
        (1, "a", h(5), h(4), 25, 25, 25),
        (2, "a", h(7), h(6), 40, 40, 39),  # half written
        (3, "a", h(8), h(6), None, None, None),
        (4, "a", h(4), h(3), 99, 99, 99),  # earlier
        (5, "b", h(9), h(9), 99, 99, None),
    ]
    w, c = spark.createDataFrame(wal + wal[:3], WAL), spark.createDataFrame(ckpt + ckpt[:1], CKPT)
    new = lambda wal, ckpt, home: incremental.unhandled_records(wal, ckpt, f"file://{tmp_path}/{home}")
    want = sorted([("a", 12), ("a", 20), ("a", 30), ("b", 1), (None, 1)], key=lambda r: [(v is None, str(v)) for v in r])
    assert rows(new(w, c, "1").select("db_name", "lsn")) == want
    assert new(w.limit(0), c, "2").count() == 0
    assert new(w, c.limit(0), "3").count() == 9
    # The same records again: they are in the manifest now, and the first batch stays what it was.
    assert rows(new(w, c, "1").select("db_name", "lsn", "batch_id")) == [(*r, 0) for r in want]
    # A new record and a rewritten one come in a batch of their own.
    more = w.unionByName(spark.createDataFrame([good(20, "b", 2, put(b"n"), h(9)), good(21, "b", 1, put(b"k", b"rewritten"), h(10))], WAL))
    again = rows(new(more, c, "1").select("db_name", "lsn", "batch_id"))
    assert [r for r in again if r[2] == 1] == [("b", 1, 1), ("b", 2, 1)] and [r[:2] for r in again if r[2] == 0] == want


def test_record_run_survives_failures(spark, tmp_path):
    by = ["i", "size", "checksum"]
    listing = lambda *r: spark.createDataFrame(list(r), "i bigint, size bigint, checksum string")
    job = incremental.RecordRun(spark, f"file://{tmp_path}/home", by)
    for point in ("freeze", "output"):
        with pytest.raises(incremental.StoppedOnPurpose):
            job.run(listing((1, 1, "a"), (None, 2, None)), fail_after=point)
        assert job.output().count() == 0
    # The batch under way keeps its frozen listing, whatever is listed now.
    assert job.run(listing((1, 1, "a"), (3, 3, "c"))) == "00000000"
    assert rows(job.output().select("i")) == [(1,), (None,)]
    assert job.run(listing((1, 1, "a"), (None, 2, None), (3, 3, "c")), handled=listing((4, 4, "d"))) == "00000001"
    assert rows(job.output().select("i", "batch_id")) == [(1, 0), (3, 1), (None, 0)]
    assert job.run(listing((1, 1, "a"), (3, 3, "c"), (4, 4, "d")), handled=listing((4, 4, "d"))) is None


def test_incremental_run_survives_failures(spark, tmp_path):
    source, home = tmp_path / "in", f"file://{tmp_path}/home"
    for i in range(3):
        spark.createDataFrame([(i, f"r{i}")], "id bigint, t string").coalesce(1).write.mode("append").parquet(str(source))
    job = incremental.IncrementalRun(spark, f"file://{source}", home, lambda d: d, files_per_batch=2)
    for point in ("freeze", "output"):
        with pytest.raises(incremental.StoppedOnPurpose):
            job.run(fail_after=point)
    assert job.batches.committed() == []
    # New files while the batch is open don't get into its frozen listing.
    spark.createDataFrame([(3, "r3")], "id bigint, t string").coalesce(1).write.mode("append").parquet(str(source))
    assert len(job.drain()) == 2
    assert sorted(r.id for r in job.output().collect()) == [0, 1, 2, 3]
    assert job.drain() == [] and job.run() is None
    # A changed file counts as new, and its old rows go.
    pq_ids = {p.name: pq.read_table(p).column("id")[0].as_py() for p in source.iterdir() if p.name.endswith(".parquet")}
    changed = next(p for p in source.iterdir() if p.name.endswith(".parquet"))
    spark.createDataFrame([(9, "changed")], "id bigint, t string").coalesce(1).write.parquet(str(tmp_path / "other"))
    fresh = next(p for p in (tmp_path / "other").iterdir() if p.name.endswith(".parquet"))
    changed.write_bytes(fresh.read_bytes())
    for crc in source.glob(f".{changed.name}.crc"):
        crc.unlink()
    assert len(job.drain()) == 1
    gone = int(pq_ids[changed.name])
    assert sorted(r.id for r in job.output().collect()) == sorted({0, 1, 2, 3} - {gone} | {9})
    with pytest.raises(FileNotFoundError):
        incremental.IncrementalRun(spark, f"file://{source}", f"{home}-none", lambda d: d).output()


def test_a_changed_file_replaces_its_output(spark, tmp_path):
    source, home = tmp_path / "a+c", f"file://{tmp_path}/home"
    source.mkdir()

    def put_file(name, ids):
        spark.createDataFrame([(i,) for i in ids], "id bigint").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "made"))
        made = next(p for p in (tmp_path / "made").iterdir() if p.name.endswith(".parquet"))
        (source / name).write_bytes(made.read_bytes())

    job = incremental.IncrementalRun(spark, f"file://{source}", home, lambda d: d, files_per_batch=2)
    ids = lambda: sorted(r.id for r in job.output().collect())
    for name, content in (("grows.parquet", [1, 2]), ("rewritten.parquet", [3, 4]), ("stays.parquet", [5, 5])):
        put_file(name, content)
    assert len(job.drain()) == 2 and ids() == [1, 2, 3, 4, 5, 5]
    put_file("grows.parquet", [1, 2, 6])
    put_file("rewritten.parquet", [7])
    with pytest.raises(incremental.StoppedOnPurpose):
        job.run(fail_after="output")
    assert ids() == [1, 2, 3, 4, 5, 5]
    assert len(job.drain()) == 1 and ids() == [1, 2, 5, 5, 6, 7]
    # Back to what it was once: that counts as changed too.
    put_file("rewritten.parquet", [3, 4])
    assert len(job.drain()) == 1 and ids() == [1, 2, 3, 4, 5, 5, 6]
    assert job.drain() == [] and job.output().columns == ["id", "batch_id"]
    with pytest.raises(ValueError, match="source_file__"):
        incremental.IncrementalRun(spark, f"file://{source}", f"{home}-other", lambda d: d.select("id")).run()


def parquet_file(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_a_run_reads_only_what_is_new(spark, tmp_path, monkeypatch):
    source, opened = tmp_path / "in", []
    real = incremental.with_checksums

    def counting(files):
        opened.append(sorted(r.path.rsplit("/", 1)[1] for r in files.collect()))
        return real(files)

    monkeypatch.setattr(incremental, "with_checksums", counting)
    job = incremental.IncrementalRun(spark, f"file://{source}", f"file://{tmp_path}/home", lambda d: d)
    for i in range(4):
        parquet_file(source / f"p={i % 2}" / f"f {i}%[1].parquet", id=[i])
        os.utime(source / f"p={i % 2}" / f"f {i}%[1].parquet", (10**9, 10**9))
    assert job.drain() == ["00000000"] and [len(o) for o in opened] == [4, 0, 0]
    assert rows(job.output().select("id", "p")) == [(i, i % 2) for i in range(4)]
    opened.clear()
    parquet_file(source / "p=0" / "new.parquet", id=[9])
    os.utime(source / "p=1" / "f 1%[1].parquet", (10**9 + 5, 10**9 + 5))  # touched, not changed
    assert job.drain() == ["00000001"]
    assert opened[0] == ["f%201%25%5B1%5D.parquet", "new.parquet"] and rows(job.output().select("id")) == [(0,), (1,), (2,), (3,), (9,)]
    opened.clear()
    assert job.drain() == [] and "new.parquet" in opened[0]  # its time is too young to be trusted


def test_a_file_that_changes_under_way_is_not_committed(spark, tmp_path):
    source = tmp_path / "in"
    parquet_file(source / "a.parquet", id=[1])
    parquet_file(source / "b.parquet", id=[2])
    changes = [lambda: parquet_file(source / "a.parquet", id=[1, 5]), lambda: None]

    def transform(read):
        changes.pop(0)()
        return read.sparkSession.createDataFrame([tuple(r) for r in read.collect()], read.schema) if changes else read

    job = incremental.IncrementalRun(spark, f"file://{source}", f"file://{tmp_path}/home", transform)
    with pytest.raises(incremental.SourceChanged):
        job.run()
    with pytest.raises(FileNotFoundError):
        job.output()
    changes[:] = [lambda: None] * 9
    assert job.drain() == ["00000000"] and rows(job.output().select("id")) == [(1,), (2,), (5,)]
    # A file that disappears between a failure and its repeat doesn't block the batch.
    parquet_file(source / "c.parquet", id=[3])
    parquet_file(source / "d.parquet", id=[4])
    with pytest.raises(incremental.StoppedOnPurpose):
        job.run(fail_after="output")
    (source / "c.parquet").unlink()
    assert job.drain() == ["00000001"] and rows(job.output().select("id")) == [(1,), (2,), (4,), (5,)]


# p3


def model(changes):
    """Ordered replay, one row at a time."""
    state, seen = {}, {}
    for key, seq, op, a, b in sorted((c for c in changes if c[1] is not None and c[2] in (0, 1, 2)), key=lambda c: (c[1], c[2])):
        if seen.get(key) == seq:
            continue
        seen[key] = seq
        row = state.get(key)
        if op == 0:
            state[key] = (True, a, b)
        elif op == 2:
            state[key] = (False, None, None)
        else:
            live, x, y = row or (False, None, None)
            state[key] = (True, a if a is not None else x, b if b is not None else y) if live else (True, a, b)
    return sorted(((k, seen[k], *v) for k, v in state.items()), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_the_model(spark, seed):
    rng = random.Random(seed)
    keys = [None, "hot", *"abcdef"]
    changes, used = [], set()
    for _ in range(900):
        key = "hot" if rng.random() < 0.4 else rng.choice(keys)
        seq = rng.randrange(4000)
        if (key, seq) in used:
            continue
        used.add((key, seq))
        changes.append((key, seq, rng.choice([0, 1, 1, 1, 2]), rng.choice([None, rng.randrange(99)]), rng.choice([None, f"s{rng.randrange(9)}"])))
    changes += rng.sample(changes, 100) + [("x", None, 0, 1, "n"), ("y", 5, 7, 1, "n"), ("z", 5, None, 1, "n")]
    rng.shuffle(changes)
    df = spark.createDataFrame([(*c, "clash") for c in changes], "k string, s bigint, o int, a bigint, b string, live string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = changefeed.replay(df, ["k"], "s", F.col("o"), ["a", "b"])
        assert rows(out.select("k", "s", "live", "a", "b")) == model(changes)
        # In two steps, the second on the state of the first, with old changes delivered again.
        middle = 2000
        first = changefeed.replay(df.where(F.col("s") < middle), ["k"], "s", F.col("o"), ["a", "b"])
        both = changefeed.replay(df, ["k"], "s", F.col("o"), ["a", "b"], state=first)
        assert rows(both.select("k", "s", "live", "a", "b")) == model(changes)
        assert changefeed.replay(df.limit(0), ["k"], "s", F.col("o"), ["a"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_live_keys(spark):
    at = lambda n: T0 + dt.timedelta(minutes=n)
    def row(i, lsn, kind, data, minute, size=None, db="d"):
        return (i, db, lsn, kind, len(data) if size is None else size, data, at(minute))

    wal = [
        row(1, 1, "Put", put(b"a", b"1"), 1),
        row(2, 5, "del", put(b"a", b""), 0),  # received first, later in the log
        row(3, 2, "1", put(b"b", b"1"), 1),
        row(4, 3, " PUT ", put(b"b", b"2"), 2),
        row(5, 4, "Delete", put(b"b", b""), 3, size=99),  # not whole
        row(6, 6, "Put", put(b"c", b"1"), 1),
        row(7, 6, "2", put(b"c", b""), 2),  # rewritten into a delete
        row(8, 7, "Put", put(b"x", b"1"), 1),
        row(9, 7, "Put", put(b"y", b"2"), 2),  # rewritten to another key
        row(10, 8, "Flush", b"", 2),
        row(11, 9, None, put(b"n"), 2),
        row(12, 10, "Put", b"\x05\x00\x00\x00k", 2),  # no key in it
        row(13, 1, "Put", put(b"a", b"other"), 1, db="e"),
    ]
    df = spark.createDataFrame(wal + wal[:4], WAL)
    got = rows(changefeed.live_keys(df).select("db_name", "key", "lsn", "value"))
    assert got == sorted([("d", b"b", 3, b"2"), ("d", b"y", 7, b"2"), ("e", b"a", 1, b"other")], key=str)
    assert changefeed.live_keys(df.limit(0)).count() == 0


# p5


def test_first_fit_takes_the_leftmost_bin_with_room():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([1, 7, 100])
        sizes = sorted((rng.randrange(0, capacity + capacity // 3 + 1) for _ in range(rng.randrange(0, 90))), reverse=True)
        bins, tree, free = [], consolidate.FirstFit(capacity), []
        for s in sizes:
            spot = next((i for i, f in enumerate(free) if f >= s), None) if s <= capacity else None
            if spot is None:
                spot = len(free)
                free.append(capacity - s if s <= capacity else -1)
            else:
                free[spot] -= s
            bins.append(spot)
            assert tree.place(s) == spot


@pytest.mark.parametrize("rounds", [(0,), (2, 0), (6, 3, 0)])
def test_first_fit_decreasing(spark, rounds):
    items = [(f"f{i}", "g1" if i % 3 else None, i * 7 % 50) for i in range(200)] + [("f1", "g1", 7), ("null", "g1", None), (None, "g1", 5), ("neg", "g1", -4), ("big", "g1", 1000)]
    df = spark.createDataFrame(items, "f string, g string, size bigint").withColumn("bin", F.lit("clash"))
    got = consolidate.first_fit_decreasing(df, "f", "size", ["g"], target=100, rounds=rounds).collect()
    assert len(got) == len({r.f for r in got}) == 203
    bins = {}
    for r in got:
        bins.setdefault((r.g, r.bin), []).append(r.size)
    assert len({r.bin for r in got}) == len(bins)
    assert all(sum(b) <= 100 or len(b) == 1 for b in bins.values())
    # Two bins of a group are never both at most half full.
    for group in {k[0] for k in bins}:
        assert sum(sum(b) <= 50 for k, b in bins.items() if k[0] == group) <= 1
    assert consolidate.first_fit_decreasing(df.limit(0), "f", "size", ["g"]).count() == 0


def test_rounds_pack_well_and_one_more_item_changes_little(spark):
    rng = random.Random(11)
    items = [(i, rng.randrange(1, 70)) for i in range(6000)]

    def bins(rows, carry=8):
        df = spark.createDataFrame(rows, "i bigint, n bigint")
        return {r.i: r.bin for r in binpack.pack_in_rounds(df, [], ["i"], "n", lambda: consolidate.FirstFit(100), 100, (5, 2, 0), carry).collect()}

    before, after = bins(items), bins([*items, (6000, 33)])
    assert len(set(before.values())) <= 1.03 * -(-sum(n for _, n in items) // 100)
    assert sum(before[i] != after[i] for i in before) < len(items) / 4


FILES = "manifest_no bigint, db_name string, file_id bigint, file_size_ bigint, file_type tinyint, file_status tinyint, file_level tinyint"
SLICES = "rec_id bigint, db_name string, key_ binary, key_length_ bigint, version_ bigint, file_id_ bigint, value_ binary, seq_ bigint"


def small_store(spark):
    files = [
        (1, "d", 1, 100, 1, 0, 1), (2, "d", 1, None, 1, 0, 1),  # unknown now: measured
        (3, "d", 2, 40_000, 1, 0, 1),  # large
        (4, "d", 3, 50, 1, 1, 1),  # deleted
        (5, "d", 4, 50, 0, 0, 0),  # level 0
        (6, "d", 5, 50, 1, 0, None),  # no level
        (7, "d", 6, -1, 1, 0, 2), (8, "d", 7, 0, 1, 0, 2),  # measured: large; no records
        (None, "d", 8, 10, 1, 0, 1), (9, "d", None, 10, 1, 0, 1),
    ]
    slices = [
        (1, "d", b"k1\n", None, 1, 1, b"v" * 10, 1),
        (2, "d", b"k2", 2, 1, 1, None, 2),
        (3, "d", b"k3", 2, 1, 6, b"v" * 40_000, 3),
        (4, "d", b"k4", 2, 1, 2, b"v", 4),
        (5, "d", b"k5", 2, 1, 3, b"v", 5),
        (6, "d", b"k6", 2, 1, None, b"v", 6),
        (7, "d", b"k7", 2, 1, 8, b"", 7),
        (8, "d", None, None, 1, 1, b"vv", 8),
    ]
    return spark.createDataFrame(files + files[:2], FILES), spark.createDataFrame(slices + slices[:3], SLICES)


def test_listing_and_plan(spark, tmp_path):
    files, slices = small_store(spark)
    sizes = {r.file_id: r.size for r in consolidate.frozen_listing(files, slices).collect()}
    assert sizes == {1: 45 + 2 + 10 + 45 + 2 + 45 + 2, 2: 40_000, 6: 45 + 2 + 40_000, 7: 0, 8: 10}
    planned = lambda f, s, home: {r.file_id for r in consolidate.consolidated_files(s, f, f"file://{tmp_path}/{home}", "v1", target=200).collect()}
    assert planned(files, slices, "a") == {1, 7, 8}
    assert planned(files.limit(0), slices, "b") == set()
    assert planned(files, slices.limit(0), "c") == {1, 6, 7, 8}


def test_consolidate_keeps_every_record_once(spark, tmp_path):
    files, slices = small_store(spark)
    home = f"file://{tmp_path}"
    layout = consolidate.consolidated_layout(slices, files, home, "v1", target=300)
    assert sorted(r.rec_id for r in layout.collect()) == [1, 2, 3, 4, 7, 8]
    assert {r.rec_id for r in layout.collect() if "-" in r.file} == {1, 2, 7, 8}
    # Published once: a second call doesn't write again.
    before = storage.children(spark, f"{home}/snapshots/v1/data")
    assert consolidate.consolidated_layout(slices, files, home, "v1", target=300).count() == 6
    assert storage.children(spark, f"{home}/snapshots/v1/data") == before


def test_consolidate_carries_every_column(spark, tmp_path):
    files, slices = small_store(spark)
    whole = slices.withColumns({"block_id_": F.col("rec_id") * 3, "bin__": F.lit(1).cast("tinyint"), "digest__": F.col("rec_id") * 7, "data_length_": F.col("rec_id") + 45, "stored_at": F.lit(T0).cast("timestamp_ntz")})
    _, rewritten = consolidate.consolidate_slices(whole, files, f"file://{tmp_path}", "v1", target=300)
    assert rewritten.columns == [*whole.columns, "bin___"]
    assert rows(rewritten.select(*whole.columns)) == rows(whole.where(F.col("rec_id").isin(1, 2, 7, 8)).distinct())


@pytest.mark.parametrize("fault", ["lost row", "doubled row", "lost file", "changed value"])
def test_consolidate_publishes_nothing_that_differs(spark, tmp_path, monkeypatch, fault):
    """What goes wrong between reading and writing is found, whichever way."""
    files, slices = small_store(spark)
    real = consolidate.join_small

    def broken(big, small, on, how="left", **options):
        out = real(big, small, on, how, **options)
        if how != "inner" or "value_" not in out.columns:
            return out
        lose = {"lost row": F.col("rec_id") == 2, "lost file": F.col("file_id_") == 1}.get(fault)
        if lose is not None:
            return out.where(~lose)
        return out.unionByName(out.where("rec_id = 2").withColumn("seq_", F.lit(99).cast("bigint"))) if fault == "doubled row" else out

    monkeypatch.setattr(consolidate, "join_small", broken)
    if fault == "changed value":
        written = consolidate._written
        monkeypatch.setattr(consolidate, "_written", lambda records, at: written(records, at).withColumn("seq_", F.when(F.col("rec_id") == 1, 5).otherwise(F.col("seq_"))))
    with pytest.raises(consolidate.VerificationFailed):
        consolidate.consolidated_layout(slices, files, f"file://{tmp_path}", "v1")
    assert not storage.exists(spark, f"file://{tmp_path}/snapshots/v1")
    monkeypatch.undo()
    assert consolidate.consolidated_layout(slices, files, f"file://{tmp_path}", "v1").count() == 6


def folder_of(spark, path):
    """Small files whose names have blanks, signs of patterns and escapes, in partition folders, one with a column more, one large."""
    for i in range(9):
        parquet_file(path / f"p={i % 3}" / f"part #{i} %20[a]*?{{x}}+.parquet", id=[i] * (i + 1), bin=pa.array([None if i % 2 else b"x"] * (i + 1), pa.binary()))
    parquet_file(path / "p=1" / "more.parquet", id=[50, 51], bin=[b"y", None], bin__=["clash", None])
    parquet_file(path / "p=2" / "empty.parquet", id=pa.array([], pa.int64()), bin=pa.array([], pa.binary()))
    parquet_file(path / "p=__HIVE_DEFAULT_PARTITION__" / "null.parquet", id=[60])
    parquet_file(path / "p=0" / "large.parquet", id=list(range(100, 30_100)), bin=[os.urandom(8) for _ in range(30_000)])


def test_consolidate_folder(spark, tmp_path):
    source, home = tmp_path / "in put", f"file://{tmp_path}/home"
    folder_of(spark, source)
    read = lambda: spark.read.option("mergeSchema", "true").parquet(str(source))
    want = rows(read().select("id", "bin", "bin__", "p"))
    assert len(want) == 45 + 2 + 1 + 30_000
    once = lambda version="v1": consolidate.consolidate_folder(spark, str(source), home, version, small=100_000, target=4_000)
    assert rows(once().select("id", "bin", "bin__", "p")) == want
    assert len(storage.children(spark, f"{home}/snapshots/v1/data")) < 9
    # Files that come later aren't in the frozen listing, be they small or large.
    parquet_file(source / "p=0" / "later.parquet", id=[777])
    parquet_file(source / "p=0" / "later large.parquet", id=list(range(200_000, 230_000)), bin=[os.urandom(8) for _ in range(30_000)])
    assert rows(once().select("id", "bin", "bin__", "p")) == want
    # A consolidated folder can be consolidated again.
    again = consolidate.consolidate_folder(spark, f"{tmp_path}/home/snapshots/v1/data", home, "v2", small=100_000)
    assert rows(again.select("id", "bin")) == [r[:2] for r in rows(read().where("id < 100").select("id", "bin"))]
    (source / "p=0" / "large.parquet").unlink()
    with pytest.raises(consolidate.VerificationFailed):
        once()
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        consolidate.consolidate_folder(spark, str(tmp_path / "none"), home, "v3")


@pytest.mark.parametrize("fault", ["gone", "grown", "unknown"])
def test_consolidate_folder_misses_no_file(spark, tmp_path, monkeypatch, fault):
    source, home = tmp_path / "in", f"file://{tmp_path}/home"
    folder_of(spark, source)
    victim = source / "p=1" / "more.parquet"
    real = consolidate.first_fit_decreasing

    def meanwhile(*args, **options):
        out = real(*args, **options)
        if fault == "gone":
            victim.unlink()
        elif fault == "grown":
            parquet_file(victim, id=[50, 51, 52], bin=[b"y", None, None])
        return out

    monkeypatch.setattr(consolidate, "first_fit_decreasing", meanwhile)
    if fault == "unknown":  # the reader calls a file otherwise than the listing does
        named = consolidate._version_of
        monkeypatch.setattr(consolidate, "_version_of", lambda path, size, modified: named(path, size, modified) if isinstance(path, str) else F.replace(named(path, size, modified), F.lit("more"), F.lit("less")))
    with pytest.raises(Exception) as raised:
        consolidate.consolidate_folder(spark, str(source), home, "v1", small=100_000, target=4_000)
    assert isinstance(raised.value, consolidate.VerificationFailed) or fault == "gone"
    assert not storage.exists(spark, f"{home}/snapshots/v1")
