"""Every llm query against its SQL, where SQL can express it."""

import pytest

from siltbed.llm import queries
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    compare(spark, duck, sf, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_wrong_answers_are_as_rare_as_expected(spark, sf):
    for r in queries.QUERIES["p4_wrong_answers"](spark, sf).collect():
        assert r.missed == 0
        assert r.false_alarms <= 3 + 5 * r.expected_rate * r.new_keys
