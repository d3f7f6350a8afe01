"""Every query of the core, by name, with its SQL."""

from siltbed.plans import core_problems, kv_queries, store_queries

QUERIES = {**kv_queries.QUERIES, **store_queries.QUERIES, **core_problems.QUERIES}
SQL = {**kv_queries.SQL, **store_queries.SQL, **core_problems.SQL}
