"""Finite machines in many tasks against one pass over each key."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import automata as A
from millrace.operators import system as S
from millrace.streaming import machines as M


@pytest.fixture
def many(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None], [f"k{i}" for i in range(40)]])
def test_states_match_one_pass(many, keys):
    draw = random.Random(len(keys))
    table = [[draw.randrange(6) for _ in range(6)] for _ in range(4)] + [list(range(6))]
    rows = [(draw.choice(keys), i, draw.randrange(5), "other") for i in range(3000)]
    shuffled = rows[:]
    draw.shuffle(shuffled)
    frame = many.createDataFrame(shuffled, "key string, at long, symbol int, state string").drop("state")
    found = {(r.key, r.at): r.found for r in A.states_before(frame, "key", "at", "symbol", table, "found").collect()}
    state, expected = {}, {}
    for k, i, s, _ in rows:
        expected[k, i] = state.get(k, 0)
        state[k] = table[s][expected[k, i]]
    assert found == expected


def test_one_session_runs_in_many_tasks(many):
    frame = many.range(5000).select(F.lit("s").alias("key"), F.col("id").alias("at"), (F.col("id") % 3).cast("int").alias("symbol"))
    cut = frame.repartitionByRange("key", "at").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(cut) == 9 and max(r["count"] for r in cut) < 2000
    found = {r["at"]: r.state for r in A.states_before(frame, "key", "at", "symbol", [[1, 2, 0], [0, 0, 1], [2, 1, 0]]).collect()}
    state = 0
    for i in range(5000):
        assert found[i] == state
        state = [[1, 2, 0], [0, 0, 1], [2, 1, 0]][i % 3][state]


def test_empty_rows(many):
    assert A.states_before(many.createDataFrame([], "key string, at long, symbol int"), "key", "at", "symbol", [[0]]).count() == 0


def test_maps_compose():
    maps = A.Maps([[1, 2, 0], [0, 0, 2]])
    number = 0
    for s in (0, 1, 1, 0):
        number = maps.then(number, s)
    assert [maps.maps[number][s] for s in range(3)] == [[1, 2, 0][[0, 0, 2][[0, 0, 2][[1, 2, 0][s]]]] for s in range(3)]
    states, table = A.explored((0, 0), ["a", "b"], lambda s, x: ((s[0] + 1) % 3, s[1]) if x == "a" else (s[0], 1 - s[1]))
    assert len(states) == 6 and states[0] == (0, 0) and table[0][0] != table[1][0]


def test_machines_agree_with_their_folds(many):
    draw = random.Random(5)
    events = [(f"s{draw.randrange(2)}", i, draw.choice([*S.SYSTEM_EVENTS, "nonsense", None])) for i in range(900)]
    found = {(r.session_id, r.arrival): (r.state, r.rule, r.next_state) for r in S.system_states(many.createDataFrame(events, "session_id string, arrival long, event string")).collect()}
    machines = {}
    assert found == {(k, i): machines.setdefault(k, M.SystemMachine()).take({"event": e}) for k, i, e in events}
    messages = [(f"s{draw.randrange(2)}", i, draw.choice(["BLOCKED", "ACCEPTING", "STOPPED", "else"]), draw.random() < 0.5, draw.random() < 0.2) for i in range(900)]
    told = {(r.session_id, r.arrival): (r.action, r.state) for r in S.queue_pauses(many.createDataFrame(messages, "session_id string, arrival long, kind string, paused boolean, frozen boolean")).collect()}
    machines = {}
    assert told == {(k, i): machines.setdefault(k, M.QueuePauses()).take({"kind": kind, "paused": p, "frozen": f}) for k, i, kind, p, f in messages}


def test_detections_agree_with_their_fold(many):
    draw = random.Random(6)
    rows = [(draw.choice([1, 2, 3]), i, draw.choice([None, float("nan"), 0.5, 1.5, 5.0, 10.0, 11.0, 12.0, 50.0, 90.0]), draw.random() < 0.7) for i in range(900)]
    found = {(r.sensor_id, r.sample_no): r.detected for r in S.detections(many.createDataFrame(rows, "sensor_id int, sample_no long, distance_cm double, conveyor_running boolean")).collect()}
    machines = {}
    assert found == {(k, i): machines.setdefault(k, M.EdgeDetector()).take({"sensor_id": k, "distance_cm": d, "conveyor_running": c})[0] for k, i, d, c in rows}


def test_entry_points_by_hand(spark):
    steps = [
        ("run", True, False, "BOOT", False, "", "NONE", ""),
        ("initialize", False, True, "INITIALIZING", False, "", "NONE", "START_WORKERS"),
        ("initialization_done", False, False, "INITIALIZING", False, "", "NONE", ""),
        ("initialization_done", True, True, "READY", False, "", "NONE", ""),
        ("running", True, False, "READY", False, "", "NONE", ""),
        ("run", True, True, "READY", True, "", "NONE", "RUN"),
        ("run_failed", True, True, "READY", False, "", "NONE", ""),
        ("run", True, True, "READY", True, "", "NONE", "RUN"),
        ("running", False, True, "RUN_SYS", False, "", "NONE", ""),
        ("pause_manual", False, True, "PAUSING", False, "DEVICE_RECOVERY_MANUAL", "NONE", "STOP"),
        ("stopped", False, True, "PAUSED", False, "DEVICE_RECOVERY_MANUAL", "NONE", ""),
        ("resume_automatic", True, False, "PAUSED", False, "DEVICE_RECOVERY_MANUAL", "NONE", ""),
        ("resume", None, False, "PAUSED", False, "DEVICE_RECOVERY_MANUAL", "NONE", ""),
        ("resume", True, True, "PAUSED", True, "DEVICE_RECOVERY_MANUAL", "NONE", "RUN"),
        ("running", True, True, "RUN_SYS", False, "", "NONE", ""),
        ("pause_failed", True, False, "RUN_SYS", False, "", "EQUIPMENT_CHECK_REQUIRED", ""),
        ("fault_line", True, True, "FAULT_STOP", False, "", "LINE_CLEAR_REQUIRED", "STOP,CLEAR"),
        ("reset", True, True, "RESETTING", False, "", "LINE_CLEAR_REQUIRED", "RESET"),
        ("reset_in_place", True, True, "PAUSED", False, "FAULT_RECOVERY", "NONE", ""),
    ]
    frame = spark.createDataFrame([("s", i, c, g) for i, (c, g, *_) in enumerate(steps)], "session_id string, arrival long, call string, guard boolean")
    found = S.entry_points(frame).orderBy("arrival").collect()
    assert [(r.accepted, r.state, r.pending, r.pause, r.recovery, r.asked) for r in found] == [s[2:] for s in steps]
    with pytest.raises(Exception, match="no entry point"):
        S.entry_points(spark.createDataFrame([("s", 1, "dance", True)], frame.schema)).collect()
