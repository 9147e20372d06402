"""Registers over ranges of rows against the machines that take one row after the other."""

import random

import pytest

from millrace.operators import registers
from millrace.plans import catalogue, registry
from millrace.sources.tables import Tables
from millrace.streaming import machines as M


QUERIES = catalogue.queries() and registry._QUERIES


def folded(rows, key, kind, **options):
    machines = {}
    return {r["arrival"]: machines.setdefault(r[key], kind(None, **options)).take(r)[0] for r in sorted(rows, key=lambda r: r["arrival"])}


def products(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        of = rng.randrange(max(0, i - 30), i + 1) if rng.random() < 0.4 else i
        rows.append({"session_id": f"s{rng.randrange(2)}", "arrival": 3 * i + 1, "product_id": rng.choice(["", None]) if rng.random() < 0.04 else f"p{of}", "fifo_sequence": rng.choice([0, -3, None, 1]) if rng.random() < 0.06 else max(1, i + rng.randrange(-12, 4))})
    return rows


REUSED = [{"session_id": "s", "arrival": i, "product_id": f"p{i // 2}", "fifo_sequence": 1 + (i + 1) // 2} for i in range(300)]  # each product again with the next product's number
ONE = [{"session_id": "s", "arrival": i, "product_id": "p", "fifo_sequence": 1 + i * 7 % 50} for i in range(200)]
FALLING = [{"session_id": "s", "arrival": i, "product_id": f"p{i % 40}", "fifo_sequence": 200 - i} for i in range(200)]


@pytest.mark.parametrize("rows", [products(1, 600), products(2, 600), REUSED, ONE, FALLING, REUSED[:1]], ids=["mixed", "mixed again", "reused", "one product", "falling", "one row"])
def test_products_in_parts(spark, rows):
    frame = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "session_id string, arrival long, product_id string, fifo_sequence long").repartition(3)
    found = registers.registered(frame).collect()
    assert len(found) == len(rows) and {r.arrival: r.outcome for r in found} == folded(rows, "session_id", M.LedgerRegister)


def sensors(seed, n, reuse, late):
    """Events of two sensors in a sequence with repeats, gaps that are filled later, and ids that come again with other numbers."""
    rng = random.Random(seed)
    rows, at = [], {"a": rng.randrange(1, 5), "b": 1}
    for i in range(n):
        s = rng.choice("ab")
        at[s] += 1
        number = at[s] - (rng.randrange(1, 6) if rng.random() < late else 0)
        event = f"e{rng.randrange(max(0, i - 20), i + 1)}" if rng.random() < reuse else f"n{s}{number}"
        rows.append({"sensor_id": s, "arrival": 2 * i, "event_id": "" if rng.random() < 0.02 else event, "sequence": rng.choice([0, -1]) if rng.random() < 0.02 else number, "digest": rng.choice(["d", "d", "d", "x"])})
        if rng.random() < 0.3:
            at[s] -= rng.randrange(0, 3)
    return rows


SHUFFLED = [{"sensor_id": "a", "arrival": i, "event_id": f"e{i}", "sequence": 1 + (i * 37 % 101), "digest": "d"} for i in range(4000)]
IDS_GO_ON = [{"sensor_id": "a", "arrival": i, "event_id": f"e{i // 2}", "sequence": 1 + (i + 1) // 2, "digest": "d"} for i in range(300)]
ONE_NUMBER = [{"sensor_id": "a", "arrival": i, "event_id": f"e{i % 7}", "sequence": 1 + (i > 90), "digest": "d"} for i in range(200)]
LONG = [{"sensor_id": "a", "arrival": i, "event_id": f"e{i}", "sequence": i + 1, "digest": "d"} for i in range(9000)] + [{"sensor_id": "a", "arrival": 20000 + i, "event_id": f"e{i}", "sequence": i + 1, "digest": "d"} for i in range(0, 9000, 900)]
ALL_KINDS = [sensors(seed, 700, reuse, late) for seed, reuse, late in ((1, 0, 0.2), (2, 0.05, 0.2), (3, 0.5, 0.3), (4, 0, 0), (5, 0.02, 0.5))]


@pytest.mark.parametrize("rows", [*ALL_KINDS, SHUFFLED, IDS_GO_ON, ONE_NUMBER, LONG, LONG[:1]], ids=["late", "some ids again", "many ids again", "in order", "very late", "shuffled", "ids go on", "one number", "ids from long ago", "one row"])
def test_sensors_in_parts(spark, rows):
    """Every id is known for ever, as in the SQL; the machine of the streams forgets after 8192."""
    frame = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "sensor_id string, arrival long, event_id string, sequence long, digest string").repartition(3)
    found = registers.sensor_outcomes(frame, 20 if len(rows) < 9000 else 1000).collect()
    assert len(found) == len(rows) and {r.arrival: r.outcome for r in found} == folded(rows, "sensor_id", M.SensorRegistry, capacity=1 << 40)


def test_no_session_in_one_task(spark, data):
    """The query gathers no session: its plan hands no group to Python."""
    found = QUERIES["st04_ledger_register"](Tables(spark, data))
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["st01_sensor_registry", "st02_sensor_actions"])
def test_ids_from_long_ago_are_known(spark, data, name):
    """After 8192 more accepted events an id is still known, and no sensor is handed to one task."""
    made = Tables(spark, data)
    made._made["sensor_event"] = spark.createDataFrame(LONG, "sensor_id string, arrival long, event_id string, sequence long, digest string")
    found = QUERIES[name](made)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    if name == "st01_sensor_registry":
        assert {(r.outcome, r.n) for r in rows} == {("ACCEPTED", 9000), ("DUPLICATE", 10)}
    else:
        assert [(r.outcome, r.action) for r in sorted(rows, key=lambda r: r.arrival)[9000:]] == [("DUPLICATE", "IGNORE")] * 10
