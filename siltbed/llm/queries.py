"""The queries of the llm operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from siltbed.llm import queries_records, queries_texts

QUERIES = {**queries_records.QUERIES, **queries_texts.QUERIES}
SQL = {**queries_records.SQL, **queries_texts.SQL}
