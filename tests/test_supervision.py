"""Workers' timers: by hand, and a stream in micro-batches against the batch."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import stream_queries as S
from millrace.sources.tables import Tables
from millrace.streaming import supervision as V


def steps(*messages, until=None):
    machine, out = V.WorkerStart(), []
    for i, (at, kind, code, number) in enumerate(messages):
        again = V.WorkerStart(machine.saved())  # the saved state is all there is
        out += machine.take({"at_ms": at, "arrival": i, "kind": kind, "code": code, "instance": "i", "number": number, "epoch": 1})
        again.s = machine.s
    if until is not None:
        out += machine.fire(until)
    return [(at, cause, phase, attempt) for _, at, cause, phase, attempt, *_ in out]


def test_a_start_by_hand():
    assert steps((0, "START", 0, 0), (10, "BEAT", 0, 1), (20, "GOAL", 0, 0), (30, "RESULT", 0, 0), (40, "STATUS", 0, 1)) == [
        (0, "START", "WAITING_GOAL", 1), (10, "BEAT", "WAITING_GOAL", 1), (20, "GOAL", "WAITING_RESULT", 1), (30, "RESULT", "WAITING_STATUS", 1), (40, "READY", "READY", 1),
    ]


def test_timeouts_and_retries_go_on_by_themselves():
    assert steps((0, "START", 0, 0), until=9000) == [
        (0, "START", "WAITING_GOAL", 1), (3000, "TIMEOUT", "RETRY_WAIT", 1), (4500, "RETRY", "WAITING_GOAL", 2), (7500, "TIMEOUT", "RETRY_WAIT", 2), (9000, "RETRY", "WAITING_GOAL", 3),
    ]


def test_polls_stale_beats_restarts_and_epochs():
    got = steps((0, "START", 0, 0), (1, "GOAL", 0, 0), (2, "RESULT", 0, 0), (3, "STATUS", 0, 5), (4, "BEAT", 0, 4), (5, "BEAT", 0, 4), (6, "BEAT", 0, 5), (7, "EPOCH", 0, 0), (8, "STATUS", 0, 5), until=900)
    assert [g[1] for g in got] == ["START", "GOAL", "RESULT", "STATUS_WAIT", "BEAT", "BEAT_STALE", "READY", "EPOCH", "IGNORED", "POLL"]
    assert got[-1] == (807, "POLL", "WAITING_STATUS", 1)
    machine = V.WorkerStart()
    one = lambda at, instance, number: next(iter(list(machine.take({"at_ms": at, "kind": "BEAT", "code": 0, "instance": instance, "number": number}))[-1:]))[2]
    list(machine.take({"at_ms": 0, "kind": "START", "code": 0}))
    assert [one(1, "a", 1), one(2, "b", 1), one(3, "b", 0), one(4, "b", 1)] == ["BEAT", "RESTARTED", "BEAT_STALE", "BEAT_STALE"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def test_stream_gives_the_steps_of_the_batch(rocks, data, tmp_path):
    rows = Tables(rocks, data).worker_message.where("worker IN ('w0/control', 'w1/control', 'w2/vision', 'w3/vision')")
    want = {tuple(r) for r in V.supervised(rows).collect()}
    for i, part in enumerate(S._by_arrival(rows, "arrival")):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
        stream = rocks.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
        query = V.supervised_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    found = rocks.read.parquet(f"{tmp_path}/out")
    got = {tuple(r) for r in found.select(*[x.split()[0] for x in V.STEPS.split(", ")]).collect()}
    assert len(got) == found.count() and got == want
    assert found.where(F.col("cause").isin("TIMEOUT", "RETRY", "POLL")).count() > 10
