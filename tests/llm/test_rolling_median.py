"""Rolling medians against plain sorting of every window, and against SQL."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from millrace.llm import rolling_median as R


def brute(rows, window):
    out = {}
    for i, s, t, v in rows:
        if i is None or t is None:
            continue
        c = sorted(x for _, s2, u, x in rows if _ is not None and u is not None and s2 == s and t - window < u <= t and x is not None)
        n = len(c)
        if not n:
            out[i] = (s, 0, None, None, None)
            continue
        m = c[(n - 1) // 2] + c[n // 2]
        d = sorted(abs(2 * x - m) for x in c)
        mad = d[(n - 1) // 2] + d[n // 2]
        out[i] = (s, n, m, mad, None if v is None else abs(2 * v - m) > mad)
    return out


def made(seed, n, values, times, series):
    rng = np.random.default_rng(seed)
    known = [None if rng.random() < 0.05 else int(x) for x in rng.choice(values, n)]
    return [(i, series[int(s)], int(t), v) for i, (s, t, v) in enumerate(zip(rng.choice(len(series), n, p=np.array([8, 4, 2, 1][: len(series)]) / sum([8, 4, 2, 1][: len(series)])), rng.choice(times, n), known, strict=True))]


CASES = [
    (1, 500, np.arange(-50, 50), np.arange(0, 400), ["a", None, "", "b"]),
    (2, 400, np.array([3]), np.arange(0, 60), ["one value"]),
    (3, 500, np.array([-(2**58), 0, 1, 2**58, 5, 6]), np.arange(-300, 300, 7), ["x", "y"]),
    (4, 300, np.arange(0, 10**9, 997), np.array([5, 5, 5, 9, 10, 500]), ["ties", None]),
    (5, 600, np.round(np.random.default_rng(5).lognormal(3, 2, 999)).astype(int), np.arange(0, 90), ["skewed"]),
]


@pytest.mark.parametrize("case", CASES)
def test_every_window(spark, case):
    rows = made(*case)
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "id long, series string, ts long, value long, n string").repartition(5)
    found = {r.id: tuple(r)[1:] for r in R.rolling_medians(frame, 30, 8).collect()}
    assert found == brute(rows, 30)


def test_ranges_are_used():
    rows = made(*CASES[4])
    assert len(set(x[3] for x in rows)) > 50


def test_odd_rows(spark):
    rows = [(1, "a", 5, 7), (1, "a", 5, 7), (1, "a", 6, 1), (None, "a", 5, 9), (2, "a", None, 9), (3, "a", 5, None), (4, "b", 5, None)]
    frame = spark.createDataFrame(rows, "id long, series string, ts long, value long")
    found = {r.id: tuple(r)[1:] for r in R.rolling_medians(frame, 30).collect()}
    assert found == {1: ("a", 1, 14, 0, False), 3: ("a", 1, 14, 0, None), 4: ("b", 0, None, None, None)}
    assert R.rolling_medians(frame.limit(0), 30).count() == 0
    with pytest.raises(Exception, match="below 2"):
        R.rolling_medians(spark.createDataFrame([(1, "a", 1, 1 << 60)], frame.schema)).count()


def test_packing():
    rng = np.random.default_rng(1)
    for x in ([], [5], [-(2**63), 2**63 - 1, 0], rng.integers(-100, 100, 50), np.cumsum(rng.integers(0, 10**6, 99))):
        assert (R.unpack(R.pack(np.array(x, np.int64))) == np.array(x, np.int64)).all()


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    values = rng.integers(-30, 30, 200)
    ranked = R.Ranked(values)
    low = rng.integers(0, 199, 500)
    high = np.array([rng.integers(x + 1, 201) for x in low])
    k = np.array([rng.integers(0, b - a) for a, b in zip(low, high, strict=True)])
    x = rng.integers(-40, 40, 500)
    assert (ranked.kth(low, high, k) == [np.sort(values[a:b])[i] for a, b, i in zip(low, high, k, strict=True)]).all()
    assert (ranked.below(low, high, x) == [(values[a:b] < y).sum() for a, b, y in zip(low, high, x, strict=True)]).all()


def test_micros_has_no_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    moments = [datetime(2024, 3, 10, 2, 30, 0, 123456), datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 59, 59, 999999)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        frame = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
        found = [r[0] for r in frame.select(R.micros(frame.ts)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert found == [(m - datetime(1970, 1, 1)) // timedelta(microseconds=1) for m in moments]


def test_query_matches_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW clicks AS SELECT * FROM read_parquet('{data}/clicks.parquet')")
    found = R.op11_rolling_median(spark, data)
    told = c.execute(R.ORACLE_SQL)
    names = [d[0] for d in told.description]
    assert found.columns == names
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, told.fetchall()))
