"""Queries that once read only some of their rows: every row has to count."""

import binascii

import duckdb
import numpy as np

from millrace.plans import catalogue, registry
from millrace.operators import anomaly as A
from millrace.sources.tables import Tables
from millrace.streaming import machines as M

QUERIES, QUERIES_OF = catalogue.queries(), registry._QUERIES


def test_system_machine_folds_every_event(spark, data):
    found = {(r.session_id, r.arrival): (r.state, r.rule, r.next_state) for r in QUERIES["st17_system_machine"](spark, data).collect()}
    rows = sorted(Tables(spark, data).system_event.collect(), key=lambda r: r.arrival)
    machines, expected = {}, {}
    for r in rows:
        expected[r.session_id, r.arrival] = machines.setdefault(r.session_id, M.SystemMachine()).take(r.asDict())
    assert len(rows) == Tables(spark, data).events.count() > 400
    assert found == expected


def test_queue_order_and_frames_cover_all_events(spark, data):
    jobs = Tables(spark, data).inference_job.collect()
    found = [r.job_id for r in QUERIES["t05_queue_order"](spark, data).collect()]
    assert found == [r.job_id for r in sorted(jobs, key=lambda r: (r.fifo_sequence, r.enqueued_ns, r.station_id))]
    # ids above 2000, which no small table holds
    events = spark.range(1990, 2100, 1, 2).selectExpr("id AS event_id", "id % 150 AS user_id")
    made = Tables(spark, data)
    made._made["events"] = events
    frames = {r.event_id: r for r in QUERIES_OF["c07_serial_frames"](made).collect()}
    assert sorted(frames) == list(range(1990, 2100))
    for i, r in frames.items():
        body = f"E|SENSOR|{i % 150 % 3 + 1}|{i}"
        assert r.line == f"{body}|{binascii.crc_hqx(body.encode(), 0xFFFF):04X}\n"
        assert r.fields == (0 if i % 9 == 0 else 4)


def test_later_heartbeats_of_every_arrival(spark, data):
    beats = Tables(spark, data).heartbeat.collect()
    expected = {(b.node_id, b.arrival): sum(h.node_id == b.node_id and h.instance_id == b.instance_id and h.sequence >= b.sequence for h in beats) for b in beats}
    found = {(r.node_id, r.arrival): r.later for r in QUERIES["j11_heartbeat_status_join"](spark, data).collect()}
    assert len(beats) > 500 and found == expected


def test_every_vector_meets_all_others(spark, data):
    rows = Tables(spark, data).embeddings.select("vec_id", "embedding").collect()
    copies = [(1000 + r.vec_id, r.embedding) for r in rows[:40]] + [(2000 + i, rows[7].embedding) for i in range(9)]
    for vectors in ([(r.vec_id, r.embedding) for r in rows], [(r.vec_id, r.embedding) for r in rows] + copies):
        ids, x = np.array([v for v, _ in vectors]), np.array([e for _, e in vectors], float)
        expected = {}
        for i, e in enumerate(x):
            d = np.sqrt(((x - e) ** 2).sum(1))
            expected[int(ids[i])] = [(int(ids[j]), round(float(d[j]), 6)) for j in np.lexsort((ids, d)) if j != i][:5]
        table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
        found = {}
        for r in sorted(A.nearest_others(table, 5, block=90).collect(), key=lambda r: (r.vec_id, r["rank"])):
            found.setdefault(r.vec_id, []).append((r.bank_id, round(r.distance, 6)))
        assert found == expected
    assert {r.vec_id for r in QUERIES["j08_nearest_bank_vector"](spark, data).collect()} == {r.vec_id for r in rows}


def test_last_bit_of_quantiles_decides(spark):
    """Two values a stream whose 95th percentiles are equal but for the rounding: the choice is that of the SQL."""
    streams = {1: ((129.31, 151.54), (47.61, 155.84)), 2: ((63.92, 83.18), (44.92, 84.18)), 3: ((186.11, 219.39), (79.71, 224.99)), 4: ((47.91, 58.44), (15.61, 60.14)), 5: ((8.0, 9.0), (7.0, 7.0)), 6: ((5.0, None), (5.0, 1.0))}
    rows = [(3 * i + stream, model, v) for model, measured in streams.items() for stream, values in enumerate(measured) for i, v in enumerate(values)]
    made = Tables(spark, "")
    made._made["events"] = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    found = {(r.model_no, r.streams) for r in QUERIES_OF["a25_parallelism_choice"](made).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, value DOUBLE)")
    duck.executemany("INSERT INTO events VALUES (?, ?, ?)", rows)
    expected = set(duck.execute(catalogue.oracle_sql()["a25_parallelism_choice"]).fetchall())
    assert found == expected and len(expected) == len(streams)
