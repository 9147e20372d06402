"""Every registered query of the event, report, flow and anomaly operators against its SQL."""

import decimal
import os

import duckdb
import pytest

from millrace.plans import catalogue
from millrace.sources.tables import NAMES

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for n in NAMES:
        if os.path.exists(f"{data}/{n}.parquet"):
            c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{data}/{n}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    rows = [tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()]
    if name not in SQL:
        assert rows
        return
    expected = duck.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    place = [names.index(c) for c in sorted(names)]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in place)) for r in expected.fetchall())
