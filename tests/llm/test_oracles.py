"""Operators that SQL can express, against it."""

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages", "clicks"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    told = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in told.description]
    found = queries.queries()[name](spark, data)
    assert sorted(found.columns) == sorted(names)
    rows = [tuple(r[n] for n in names) for r in found.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, told.fetchall()))
