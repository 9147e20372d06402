"""State machines of the flow as plain folds over ordered events.

A machine is built from a saved state and takes one row at a time. The batch and the streaming operators share it, so a stream
that has ended gives the rows of the batch.
"""

from __future__ import annotations

import json

from ..operators.flow import FAULTS, TRANSITIONS


class SensorRegistry:
    """Sequence and identity checks of sensor events: a list of what can be wrong, looked through in order. A refused event changes nothing, so a gap blocks all that follows it.

    An accepted event is known by its id until ``capacity`` later ones were accepted.
    """

    columns = ("outcome",)
    # outcome, when: of an event, the digest that its id is known by, and how far it lies beyond the sensor's last sequence (None for a sensor's first)
    refusals = (
        ("DUPLICATE", lambda event, digest, step: digest == event["digest"]),
        ("CONFLICT", lambda event, digest, step: digest is not None),
        ("OUT_OF_ORDER", lambda event, digest, step: not event["event_id"] or event["sequence"] < 1 or (step is not None and step < 1)),
        ("SEQUENCE_GAP", lambda event, digest, step: step is not None and step > 1),
    )

    def __init__(self, saved: str | None = None, capacity: int = 8192) -> None:
        self.last, self.seen = json.loads(saved) if saved else ({}, {})
        self.capacity = capacity

    def saved(self) -> str:
        return json.dumps([self.last, self.seen])

    def take(self, row: dict) -> tuple[str]:
        sensor, last = row["sensor_id"], self.last.get(row["sensor_id"])
        facts = (row, self.seen.get(row["event_id"]), None if last is None else row["sequence"] - last)
        outcome = next((name for name, holds in self.refusals if holds(*facts)), "ACCEPTED")
        if outcome == "ACCEPTED":
            self.last[sensor] = row["sequence"]
            self.seen[row["event_id"]] = row["digest"]
            for oldest in list(self.seen)[: len(self.seen) - self.capacity] if len(self.seen) > self.capacity else ():
                del self.seen[oldest]
        return (outcome,)


class IdempotencyStore:
    """NEW, REPLAY or CONFLICT of a command's id and digest, for streams. An id is forgotten when ``capacity`` others were used since its own last use."""

    columns = ("state",)

    def __init__(self, saved: str | None = None, capacity: int = 4096) -> None:
        self.digests: dict[str, str] = json.loads(saved) if saved else {}  # in the order of their last use
        self.capacity = capacity

    def saved(self) -> str:
        return json.dumps(self.digests)

    def take(self, row: dict) -> tuple[str]:
        offered = row["payload_digest"]
        first = self.digests.pop(row["command_id"], None)
        self.digests[row["command_id"]] = offered if first is None else first
        if len(self.digests) > self.capacity:
            del self.digests[next(iter(self.digests))]
        return ("NEW" if first is None else ("CONFLICT", "REPLAY")[first == offered],)


class SystemMachine:
    """System states by the transition table; a pair that isn't listed is refused and changes nothing."""

    columns = ("state", "rule", "next_state")
    table = {(s, e): (rule, after) for s, e, rule, after in TRANSITIONS}

    def __init__(self, saved: str | None = None) -> None:
        self.state = saved or "BOOT"

    def saved(self) -> str:
        return self.state

    def take(self, row: dict) -> tuple[str, str | None, str]:
        before = self.state
        rule, after = dict(FAULTS).get(row["event"]), "FAULT_STOP"
        if rule is None:
            rule, after = self.table.get((before, row["event"]), (None, before))
        self.state = after
        return before, rule, after


class EdgeDetector:
    """Detections of a distance sensor with hysteresis: near objects count once until the way is clear again.

    Limits in centimetres; no echo re-arms. Sensors 1 and 2 detect only while their conveyor runs.
    """

    columns = ("detected",)
    near, clear, least, most = 10.0, 12.0, 1.5, 80.0

    def __init__(self, saved: str | None = None) -> None:
        self.armed = saved != "0"

    def saved(self) -> str:
        return "1" if self.armed else "0"

    def take(self, row: dict) -> tuple[bool]:
        d = row["distance_cm"]
        if d is None or d != d:
            self.armed = True
            return (False,)
        if not self.least <= d <= self.most:
            return (False,)
        if d >= self.clear:
            self.armed = True
        elif d <= self.near and self.armed and (row["sensor_id"] == 3 or row["conveyor_running"]):
            self.armed = False
            return (True,)
        return (False,)


class ReorderBuffer:
    """Lets results go in the order of their sequences, from 1 on; earlier ones than the next are dropped."""

    columns = ("released",)

    def __init__(self, saved: str | None = None) -> None:
        state = json.loads(saved) if saved else {"next": 1, "held": []}
        self.next, self.held = state["next"], {int(x) for x in state["held"]}

    def saved(self) -> str:
        return json.dumps({"next": self.next, "held": sorted(self.held)})

    def take(self, row: dict) -> tuple[list[int]]:
        if row["fifo_sequence"] < self.next:
            return ([],)
        self.held.add(row["fifo_sequence"])
        out = []
        while self.next in self.held:
            self.held.discard(self.next)
            out.append(self.next)
            self.next += 1
        return (out,)


class LedgerRegister:
    """Product ids and sequences of a session, one to one, sequences rising; what is refused changes nothing."""

    columns = ("outcome",)

    def __init__(self, saved: str | None = None) -> None:
        self.sequences: dict[str, int] = json.loads(saved) if saved else {}
        self.owners = {n: p for p, n in self.sequences.items()}
        self.last = max(self.owners, default=0)

    def saved(self) -> str:
        return json.dumps(self.sequences)

    def take(self, row: dict) -> tuple[str]:
        product, n = row["product_id"], row["fifo_sequence"]
        known = self.sequences.get(product)
        tests = (
            (not product or n is None or n < 1, "INVALID"),
            (known is not None and known == n, "KNOWN"),
            (known is not None, "ID_CONFLICT"),
            (n in self.owners, "SEQUENCE_CONFLICT"),
            (n is not None and n <= self.last, "NOT_RISING"),
        )
        for holds, outcome in tests:
            if holds:
                return (outcome,)
        self.sequences[product], self.owners[n], self.last = n, product, n
        return ("REGISTERED",)


class _Steps:
    """A machine read off a table: event -> (identities that must agree, identities that it fixes, states before -> state after, states that take it as a repeat).

    OK moves on, REPEAT changes nothing, IDENTITY is another's message, REFUSED comes at the wrong time.
    """

    columns = ("outcome", "state")
    first: str
    table: dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, str], tuple[str, ...]]]

    def __init__(self, saved: str | None = None) -> None:
        self.state, self.known = json.loads(saved) if saved else (self.first, {})

    def saved(self) -> str:
        return json.dumps([self.state, self.known])

    def take(self, row: dict) -> tuple[str, str]:
        agree, fixes, moves, repeats = self.table[row["event"]]
        if any(self.known.get(n, "") != row[n] for n in agree):
            return "IDENTITY", self.state
        if self.state in repeats:
            return ("REPEAT" if all(self.known.get(n) == row[n] for n in fixes) else "IDENTITY"), self.state
        if self.state not in moves:
            return "REFUSED", self.state
        self.state = moves[self.state]
        self.known = {} if self.state == self.first else self.known | {n: row[n] for n in fixes}
        return "OK", self.state


class StationCycle(_Steps):
    """Positioning and capture of one product at one station. A capture's end counts whenever it comes, by its identity alone."""

    first = "PENDING"
    states = ("PENDING", "POSITIONING", "POSITION_SETTLED", "CAPTURE_REQUESTED", "CAPTURE_COMPLETED", "FAILED")
    table = {
        "BEGIN": ((), ("position_command", "capture_id"), {"PENDING": "POSITIONING"}, ()),
        "SETTLED": (("position_command",), (), {"POSITIONING": "POSITION_SETTLED"}, ("POSITION_SETTLED", "CAPTURE_REQUESTED", "CAPTURE_COMPLETED", "FAILED")),
        "REQUESTED": (("capture_id",), ("capture_command",), {"POSITION_SETTLED": "CAPTURE_REQUESTED"}, ("CAPTURE_REQUESTED",)),
        "SUCCEEDED": (("capture_id",), (), dict.fromkeys(states, "CAPTURE_COMPLETED"), ()),
        "FAILED": (("capture_id",), (), dict.fromkeys(states, "FAILED"), ()),
        "RESET": ((), (), dict.fromkeys(states[:4], "PENDING"), ()),
    }


class ActuationSteps(_Steps):
    """Actuation of one product from Sensor3 on. Accepted and completed may come in either order; an acceptance says that it is under way, also after its end."""

    first = "AT_SENSOR3"
    table = {
        "BEGIN": ((), ("actuator_job", "command"), {"AT_SENSOR3": "BEGUN"}, ("BEGUN",)),
        "ACCEPTED": (("command",), (), {"BEGUN": "ACTUATING", "ACTUATING": "ACTUATING", "DONE": "ACTUATING"}, ()),
        "COMPLETED": (("command",), ("actuation_id",), {"BEGUN": "DONE", "ACTUATING": "DONE"}, ()),
    }


class QueuePauses:
    """Pauses of the line while the inference queue is full. A recovered queue resumes the line once its stop is confirmed.

    ``kind`` is BLOCKED, ACCEPTING or STOPPED; ``paused`` says that the system is PAUSED, ``frozen`` that it is in FAULT_STOP.
    """

    columns = ("action", "state")
    # (state, kind, system paused) -> action, state; all else changes nothing
    table = {
        ("FREE", "BLOCKED", False): ("PAUSE", "FULL"),
        ("FREE", "BLOCKED", True): ("PAUSE", "FULL"),
        ("FULL", "ACCEPTING", False): ("WAIT", "RECOVERED"),
        ("FULL", "ACCEPTING", True): ("RESUME", "FREE"),
        ("RECOVERED", "ACCEPTING", True): ("RESUME", "FREE"),
        ("RECOVERED", "STOPPED", True): ("RESUME", "FREE"),
    }

    def __init__(self, saved: str | None = None) -> None:
        self.state = saved or "FREE"

    def saved(self) -> str:
        return self.state

    def take(self, row: dict) -> tuple[str, str]:
        if row["frozen"]:
            return "IGNORED", self.state
        action, self.state = self.table.get((self.state, row["kind"], bool(row["paused"])), ("NONE", self.state))
        return action, self.state
