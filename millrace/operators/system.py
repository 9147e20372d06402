"""The system's state machine with its entry points and side flags, and the queue's pauses, as finite machines.

A state is (system state, a run is to be confirmed, why the line is paused, how a fault is to be recovered). A symbol is an entry point with what its guard
said. Every entry point has one system event, which the transition table takes or refuses, and settings that take hold before or after that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.machines import EdgeDetector, QueuePauses
from .automata import explored, numbered, states_before
from .flow import FAULTS, SYSTEM_STATES, TRANSITIONS

RULES = {(s, e): (rule, after) for s, e, rule, after in [*TRANSITIONS, *((s, e, rule, "FAULT_STOP") for s in SYSTEM_STATES for e, rule in FAULTS)]}
SYSTEM_EVENTS = sorted({e for _, e in RULES})


def system_states(rows: DataFrame) -> DataFrame:
    """``rows`` (session_id, arrival, event) with state, rule and next_state. An event that the state doesn't list changes nothing; an unknown one neither."""
    states, symbols = SYSTEM_STATES, [*SYSTEM_EVENTS, None]
    table = [[states.index(RULES.get((s, e), (None, s))[1]) for s in states] for e in symbols]
    coded = rows.withColumn("__symbol", _code(F.col("event"), numbered(SYSTEM_EVENTS), len(SYSTEM_EVENTS)))
    found = states_before(coded, "session_id", "arrival", "__symbol", table, "__state")
    state = F.element_at(F.array(*map(F.lit, states)), F.col("__state") + 1)
    rules = _lookup({(states.index(s), SYSTEM_EVENTS.index(e)): x for (s, e), x in RULES.items()}, len(symbols))
    return found.withColumn("state", state).withColumn("rule", rules("rule")).withColumn("next_state", F.coalesce(rules("next"), F.col("state"))).drop("__symbol", "__state")


def _code(value: Column, numbers: dict[str, int], other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), value), F.lit(other))


def _lookup(rules: dict[tuple[int, int], tuple[str, str]], symbols: int):  # noqa: ANN202
    """Texts by (__state, __symbol), null where there is no rule."""
    size = max(s for s, _ in rules) + 1

    def text(which: str) -> Column:
        listed = [rules.get((i // symbols, i % symbols), (None, None))[which == "next"] for i in range(size * symbols)]
        return F.element_at(F.array(*map(F.lit, listed)), F.col("__state") * symbols + F.col("__symbol") + 1)

    return text


@dataclass(frozen=True)
class Entry:
    """An entry point: its system event by state (None: the same in all), what is set before the event is tried, and after it was taken."""

    event: str
    in_state: dict[str, str] = field(default_factory=dict)
    needs: str | None = None  # "guard", or "pending": a run is to be confirmed; "auto": guard, and paused for automatic recovery
    first: dict[str, object] = field(default_factory=dict)
    then: dict[str, object] = field(default_factory=dict)
    asks: str = ""  # what the equipment is told


# Entry points with their rules.
ENTRIES = {
    "initialize": Entry("APP_STARTED", asks="START_WORKERS"),
    "initialization_done": Entry("INIT_DONE", needs="guard"),
    "initialization_failed": Entry("INIT_FAILED"),
    "initialization_timeout": Entry("INIT_TIMEOUT"),
    "run": Entry("START_REQUEST", needs="guard", then={"pending": True}, asks="RUN"),
    "running": Entry("ALL_CONVEYORS_RUNNING", needs="pending", then={"pending": False, "pause": ""}),
    "run_failed": Entry("RESUME_FAILED", in_state={"READY": "START_FAILED"}, then={"pending": False}),
    "pause": Entry("PAUSE_REQUEST", then={"pending": False, "pause": "OPERATOR"}, asks="STOP"),
    "pause_automatic": Entry("RECOVERABLE_DEVICE_FAULT", then={"pending": False, "pause": "DEVICE_RECOVERY_AUTO"}, asks="STOP"),
    "pause_manual": Entry("RECOVERABLE_DEVICE_FAULT", then={"pending": False, "pause": "DEVICE_RECOVERY_MANUAL"}, asks="STOP"),
    "pause_storage": Entry("RECOVERABLE_DEVICE_FAULT", then={"pending": False, "pause": "STORAGE_RECOVERY"}, asks="STOP"),
    "stopped": Entry("ALL_CONVEYORS_STOPPED"),
    "pause_failed": Entry("PAUSE_FAILED", first={"recovery": "EQUIPMENT_CHECK_REQUIRED"}, asks="STOP"),
    "pause_timeout": Entry("PAUSE_TIMEOUT", first={"recovery": "EQUIPMENT_CHECK_REQUIRED"}, asks="STOP"),
    "resume": Entry("RESUME_REQUEST", needs="guard", then={"pending": True}, asks="RUN"),
    "resume_automatic": Entry("DEVICE_RECOVERED", needs="auto", then={"pending": True}, asks="RUN"),
    "reset": Entry("RESET_REQUEST", needs="guard", asks="RESET"),
    "reset_cleared": Entry("RESET_SUCCEEDED_EMPTY_LINE", then={"recovery": "NONE", "pause": ""}),
    "reset_in_place": Entry("RESET_SUCCEEDED_IN_PLACE", then={"recovery": "NONE", "pause": "FAULT_RECOVERY"}),
    "reset_failed": Entry("RESET_FAILED"),
    "reset_timeout": Entry("RESET_TIMEOUT"),
    "fault_line": Entry("CRITICAL_FAULT", first={"recovery": "LINE_CLEAR_REQUIRED", "pending": False}, asks="STOP,CLEAR"),
    "fault_equipment": Entry("CRITICAL_FAULT", first={"recovery": "EQUIPMENT_CHECK_REQUIRED", "pending": False}, asks="STOP"),
    "estop": Entry("ESTOP_ASSERTED", first={"recovery": "EQUIPMENT_CHECK_REQUIRED", "pending": False}, asks="STOP"),
}
FIRST = ("BOOT", False, "", "NONE")
_FLAGS = ("pending", "pause", "recovery")


def entered(state: tuple, symbol: tuple[str, bool]) -> tuple[tuple, str | None]:
    """The state after an entry point, and the rule of its event, None if the guard or the transition table refuses it."""
    system, flags, entry = state[0], dict(zip(_FLAGS, state[1:], strict=True)), ENTRIES[symbol[0]]
    held = {None: True, "guard": symbol[1], "pending": flags["pending"], "auto": symbol[1] and flags["pause"] == "DEVICE_RECOVERY_AUTO"}[entry.needs]
    if not held:
        return state, None
    flags |= entry.first
    rule, after = RULES.get((system, entry.in_state.get(system, entry.event)), (None, system))
    if rule:
        flags |= entry.then
    return (after, *(flags[n] for n in _FLAGS)), rule


def entry_points(calls: DataFrame) -> DataFrame:
    """``calls`` (session_id, arrival, call, guard) with accepted, rule, the state after it with its flags, and what the equipment is asked.

    A null guard counts as one that doesn't hold. A call of another name is an error.
    """
    symbols = [(name, guard) for name in ENTRIES for guard in (False, True)]
    states, table = explored(FIRST, symbols, lambda s, x: entered(s, x)[0])
    unknown = F.raise_error(F.concat(F.lit("no entry point "), F.coalesce("call", F.lit("null")))).cast("int")
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, name in enumerate(ENTRIES) for x in (name, 2 * n)]), F.col("call")), unknown) + F.coalesce("guard", F.lit(False)).cast("int")
    found = states_before(calls.withColumn("__symbol", code), "session_id", "arrival", "__symbol", table, "__state")
    # a row for each pair of state and symbol
    told = [(i, j, *entered(s, x)[0], entered(s, x)[1], ENTRIES[x[0]].asks) for i, s in enumerate(states) for j, x in enumerate(symbols)]
    rules = calls.sparkSession.createDataFrame(told, "__state int, __symbol int, state string, pending boolean, pause string, recovery string, rule string, asked string")
    result = found.join(F.broadcast(rules), ["__state", "__symbol"])
    return result.withColumn("accepted", F.col("rule").isNotNull()).withColumn("asked", F.when(F.col("rule").isNotNull(), F.col("asked")).otherwise("")).drop("__state", "__symbol")


def queue_pauses(messages: DataFrame) -> DataFrame:
    """``messages`` (session_id, arrival, kind, paused, frozen) with action and the state after it: the line pauses while the inference queue is full.

    A recovered queue resumes the line once its stop is confirmed. A frozen system ignores every message.
    """
    kinds, states = ["BLOCKED", "ACCEPTING", "STOPPED"], ["FREE", "FULL", "RECOVERED"]
    symbols = [(k, p) for k in kinds for p in (False, True)] + [None]  # the last one changes nothing
    moves = {(s, x): QueuePauses.table.get((s, *x), ("NONE", s)) if x else ("NONE", s) for s in states for x in symbols}
    table = [[states.index(moves[s, x][1]) for s in states] for x in symbols]
    known = F.when(F.coalesce("frozen", F.lit(False)), None).otherwise(F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(kinds) for x in (k, 2 * n)]), F.col("kind"))) + F.coalesce("paused", F.lit(False)).cast("int")
    found = states_before(messages.withColumn("__symbol", F.coalesce(known, F.lit(len(symbols) - 1))), "session_id", "arrival", "__symbol", table, "__state")
    text = _lookup({(states.index(s), symbols.index(x)): v for (s, x), v in moves.items()}, len(symbols))
    return found.withColumn("action", F.when(F.coalesce("frozen", F.lit(False)), "IGNORED").otherwise(text("rule"))).withColumn("state", text("next")).drop("__symbol", "__state")


def detections(samples: DataFrame) -> DataFrame:
    """``samples`` (sensor_id, sample_no, distance_cm, conveyor_running) with detected: the hysteresis of ``EdgeDetector`` as a machine of two states, armed or not."""
    d, limits = F.col("distance_cm"), EdgeDetector
    clear, near = F.lit(0), F.when((d <= limits.near) & ((F.col("sensor_id") == 3) | F.coalesce("conveyor_running", F.lit(False))), 1).otherwise(2)
    symbol = F.when(d.isNull() | F.isnan(d), clear).when(~d.between(limits.least, limits.most), 2).when(d >= limits.clear, clear).otherwise(near)
    found = states_before(samples.withColumn("__symbol", symbol), "sensor_id", "sample_no", "__symbol", [[0, 0], [1, 1], [0, 1]], "__state")
    return found.withColumn("detected", (F.col("__symbol") == 1) & (F.col("__state") == 0)).drop("__symbol", "__state")
