"""The durable append as a stream: a death between commit and acknowledgement changes nothing."""

import duckdb
import pytest

from millrace.plans.registry import oracle_sql
from millrace.plans import stream_queries as S
from millrace.sources.tables import Tables
from millrace.streaming import ingest


def expected(data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{data}/events.parquet')")
    told = c.execute(oracle_sql()["s01_stream_append"])
    names = [d[0] for d in told.description]
    return {r[names.index("arrival")]: tuple(r[names.index(n)] for n in ("log_id", "revision", "state")) for r in told.fetchall()}


@pytest.mark.parametrize("step", ["acknowledge", "_replace"])
def test_restart_after_a_death(spark, data, tmp_path, monkeypatch, step):
    rows, folder = Tables(spark, data).arrival_event, f"file://{tmp_path}/store"
    ingest.prepare(spark, folder, rows.schema)
    real, calls = getattr(ingest, step), []

    def dying(*args):
        calls.append(args)
        if len(calls) in (2, 5):
            raise RuntimeError("the power went")
        real(*args)

    monkeypatch.setattr(ingest, step, dying)
    died = 0
    for part in S._by_arrival(rows, "arrival"):
        part.write.mode("append").parquet(f"{folder}/incoming")
        for _ in range(4):
            try:
                ingest.run_to_end(spark, f"{folder}/incoming", folder, rows.schema)
                break
            except Exception as why:
                assert "the power went" in str(why)
                died += 1
    assert died >= 1
    want = expected(data)
    verdicts = ingest.committed(spark, folder, ingest.VERDICTS, rows.schema)
    assert {r.arrival: (r.log_id, r.revision, r.state) for r in verdicts.collect()} == want and verdicts.count() == len(want)
    events = [(r.log_id, r.revision) for r in ingest.committed(spark, folder, ingest.EVENTS, rows.schema).collect()]
    assert len(events) == len(set(events)) == sum(s == "NEW" for *_, s in want.values())
    acks = sorted(r.arrival for r in ingest.committed(spark, folder, ingest.ACKS, rows.schema).collect())
    assert acks == sorted(a for a, (*_, s) in want.items() if s in ("NEW", "REPLAY"))


def test_small_batches_give_the_same(spark, data, tmp_path):
    rows, folder = Tables(spark, data).arrival_event, f"file://{tmp_path}/store"
    ingest.prepare(spark, folder, rows.schema)
    for i, part in enumerate(S._by_arrival(rows, "arrival")):
        part.coalesce(1).write.parquet(f"{folder}/incoming/part{i}")
    ingest.run_to_end(spark, f"{folder}/incoming/*", folder, rows.schema, files=1)
    verdicts = ingest.committed(spark, folder, ingest.VERDICTS, rows.schema)
    assert verdicts.select("batch_id").distinct().count() == S.PARTS
    assert {r.arrival: (r.log_id, r.revision, r.state) for r in verdicts.collect()} == expected(data)
    before = verdicts.count()
    ingest.run_to_end(spark, f"{folder}/incoming/*", folder, rows.schema)
    assert ingest.committed(spark, folder, ingest.VERDICTS, rows.schema).count() == before
