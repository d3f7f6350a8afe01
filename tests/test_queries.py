"""Every core query against its SQL on the smallest tables, and the shape of some plans."""

import collections

import pytest
import xxhash

import __spark_entry__ as entry
from siltbed.plans import catalogue
from siltbed.plans.core_problems import TRUE_KEY_HEX


def compare(spark, duck, sf, f, sql):
    df = f(spark, sf)
    columns = sorted(df.columns)
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else round(v, 6) if isinstance(v, float) else v
    ours = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    theirs = collections.Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    compare(spark, duck, sf, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_every_key_is_routed(spark, duck, sf):
    got = {r.key_hex: (r.h, r.shard, r.bucket) for r in catalogue.QUERIES["kv_hash_routes"](spark, sf).collect()}
    true = {k for (k,) in duck.sql(f"SELECT DISTINCT {TRUE_KEY_HEX.format(key='data_', length='length_')} FROM key_history").fetchall() if k}
    assert set(got) == true and catalogue.QUERIES["kv_hash_routes"](spark, sf).count() == len(true)
    for key, (h, shard, bucket) in got.items():
        u = xxhash.xxh64(bytes.fromhex(key), seed=0).intdigest()
        assert (h, shard, bucket) == (u - (1 << 64) if u >= 1 << 63 else u, abs(u - (1 << 64) if u >= 1 << 63 else u) % 8, u >> 52)
    agreed = {r.key_hex: (r.h, r.shard, r.bucket) for r in catalogue.QUERIES["kv_hash_routing"](spark, sf).collect()}
    assert agreed and all(got[k] == v for k, v in agreed.items()) and len(agreed) < len(got)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_get_reaches_the_scan(spark, sf):
    text = plan(catalogue.QUERIES["kv_point_get"](spark, sf))
    assert "EqualTo(o_orderkey,1234)" in text and "Exchange" not in text


def test_seek_sorts_only_what_it_returns(spark, sf):
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["kv_seek"](spark, sf))


def test_no_cartesian_product(spark, sf):
    for name in ("p2_found", "p3_found", "p5_found", "kv_locate_file"):
        text = plan(catalogue.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
