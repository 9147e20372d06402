"""Supervision of workers while they start: attempts, deadlines, retries, status polls, heartbeats and command epochs.

A worker's messages are folded in the order of their times; between two of them, and after the last, its timers fire at the moments for which they are set. In a stream
the moments after a batch's last message come from event-time timers, which the watermark sets off, so stream and batch give the same steps.

Messages (kind, code, instance, number, epoch): START; GOAL (code 0: accepted); RESULT (0: done, 1: failed, may be tried again, 2: not without an operator);
STATUS (0: ready, 1: not yet, 2: of another node or version; number: the heartbeat it has seen, epoch: the one it knows); BEAT (0: healthy; number: its sequence);
EPOCH: a new command epoch, which makes statuses of the old one worthless. What comes at the wrong time is IGNORED and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds: an attempt's or status check's patience, the pause before a retry, before a status poll, and the age of a fresh heartbeat.
TIMEOUT, RETRY, POLL, FRESH = 3000, 1500, 800, 4000
STEPS = "worker string, step long, at_ms long, cause string, phase string, attempt int, ready boolean, manual boolean"
_FAILED = ("TIMEOUT", "GOAL_REFUSED", "RESULT_FAILED", "RESULT_FATAL", "STATUS_FATAL", "RESTARTED")


class WorkerStart:
    """One worker: ``take`` a message or ``fire`` what is due; both give the steps that this makes."""

    def __init__(self, saved: str | None = None) -> None:
        self.s = json.loads(saved) if saved else {
            "step": 0, "phase": "IDLE", "attempt": 0, "deadline": None, "retry": None, "poll": None, "asked": False, "acted": False, "verified": False, "ready": False, "manual": False,
            "epoch": 1, "beat": None, "seen": None,
        }

    def saved(self) -> str:
        return json.dumps(self.s)

    def due(self) -> int | None:
        return min((self.s[n] for n in ("deadline", "retry", "poll") if self.s[n] is not None), default=None)

    def fire(self, until: int) -> Iterator[tuple]:
        """Timers up to ``until``, the earliest first; of equal ones the deadline, then the retry."""
        while (at := self.due()) is not None and at <= until:
            yield self._step(at, next(c for n, c in (("deadline", "TIMEOUT"), ("retry", "RETRY"), ("poll", "POLL")) if self.s[n] == at))

    def take(self, m: dict) -> Iterator[tuple]:
        yield from self.fire(m["at_ms"])
        yield self._step(m["at_ms"], getattr(self, f"_{m['kind'].lower()}")(m))

    # each says what a message means, and notes what it tells

    def _start(self, m: dict) -> str:
        return "START" if self.s["phase"] == "IDLE" else "IGNORED"

    def _goal(self, m: dict) -> str:
        return "IGNORED" if self.s["phase"] != "WAITING_GOAL" else "GOAL_REFUSED" if m["code"] else "GOAL"

    def _result(self, m: dict) -> str:
        return "IGNORED" if self.s["phase"] != "WAITING_RESULT" else ("RESULT", "RESULT_FAILED", "RESULT_FATAL")[m["code"]]

    def _status(self, m: dict) -> str:
        if self.s["phase"] != "WAITING_STATUS" or not self.s["asked"]:
            return "IGNORED"
        if m["code"] == 2:
            return "STATUS_FATAL"
        self.s["seen"] = [m["instance"], m["number"], m["epoch"], m["code"] == 0]
        return "READY" if self._can_be_ready(m["at_ms"]) else "STATUS_WAIT"

    def _beat(self, m: dict) -> str:
        last, s = self.s["beat"], self.s
        if m["number"] <= 0 or (last and last[0] == m["instance"] and m["number"] <= last[1]):
            return "BEAT_STALE"
        s["beat"] = [m["instance"], m["number"], m["code"] == 0, m["at_ms"]]
        if last and last[0] != m["instance"] and s["phase"] != "IDLE":
            return "RESTARTED"
        if m["code"]:
            return "UNHEALTHY" if s["ready"] else "BEAT"
        return "READY" if s["phase"] == "WAITING_STATUS" and s["verified"] and self._can_be_ready(m["at_ms"]) else "BEAT"

    def _epoch(self, m: dict) -> str:
        return "EPOCH"

    def _can_be_ready(self, at: int) -> bool:
        """Action, status and heartbeat all speak of one instance, and the status of this epoch."""
        seen, beat = self.s["seen"], self.s["beat"]
        return bool(self.s["acted"] and seen and beat and seen[3] and beat[2] and seen[0] == beat[0] and seen[2] == self.s["epoch"] and beat[1] >= seen[1] and at - beat[3] <= FRESH)

    def _step(self, at: int, cause: str) -> tuple:
        s = self.s
        if cause in _FAILED:
            s |= {"phase": "RETRY_WAIT", "deadline": None, "retry": at + RETRY, "poll": None, "asked": False, "acted": False, "verified": False, "ready": False, "manual": cause in ("RESULT_FATAL", "STATUS_FATAL")}
        elif cause in ("START", "RETRY"):
            s |= {"phase": "WAITING_GOAL", "attempt": s["attempt"] + 1, "deadline": at + TIMEOUT, "retry": None, "manual": False}
        elif cause == "GOAL":
            s["phase"] = "WAITING_RESULT"
        elif cause == "RESULT":
            s |= {"phase": "WAITING_STATUS", "deadline": at + TIMEOUT, "poll": None, "asked": True, "acted": True}
        elif cause == "POLL":
            s |= {"poll": None, "asked": True}
        elif cause == "STATUS_WAIT":
            s |= {"poll": at + POLL, "asked": False, "verified": True}
        elif cause == "READY":
            s |= {"phase": "READY", "deadline": None, "poll": None, "asked": False, "verified": True, "ready": True}
        elif cause == "UNHEALTHY" or (cause == "EPOCH" and s["acted"]):
            s |= {"phase": "WAITING_STATUS", "deadline": None, "poll": at + POLL, "asked": False, "ready": False}
        if cause == "EPOCH":
            s |= {"epoch": s["epoch"] + 1, "verified": False, "ready": False}
        s["step"] += 1
        return s["step"], at, cause, s["phase"], s["attempt"], s["ready"], s["manual"]


_NAMES = [x.split()[0] for x in STEPS.split(", ")]


def _table(worker: str, steps: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(worker, *x) for x in steps], columns=_NAMES)


def supervised(messages: DataFrame) -> DataFrame:
    """All steps of all workers (worker, at_ms, arrival, kind, code, instance, number, epoch), with the timers up to the time of the last message of any worker."""
    last = messages.agg(F.max("at_ms")).first()[0]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine, steps = WorkerStart(), []
        for m in rows.sort_values(["at_ms", "arrival"]).to_dict("records"):
            steps += machine.take(m)
        steps += machine.fire(last)
        return _table(rows["worker"].iloc[0], steps)

    return messages.groupBy("worker").applyInPandas(run, STEPS)


def initializations(steps: DataFrame, workers: int) -> DataFrame:
    """A row for each line (what stands before the slash of a worker's name): its attempts, timeouts, and the first time at which all ``workers`` were ready."""
    line = F.substring_index("worker", "/", 1)
    before = F.lag(F.col("ready").cast("int")).over(W.partitionBy("worker").orderBy("step"))
    flips = steps.withColumn("line", line).withColumn("change", F.col("ready").cast("int") - F.coalesce(before, F.lit(0)))
    up = F.sum("change").over(W.partitionBy("line").orderBy("at_ms", "worker", "step"))
    return (
        flips.withColumn("up", up)
        .groupBy("line")
        .agg(
            F.count_distinct("worker").alias("workers"),
            F.count_if(F.col("cause").isin("START", "RETRY")).alias("attempts"),
            F.count_if(F.col("cause") == "TIMEOUT").alias("timeouts"),
            F.bool_or("manual").alias("needs_operator"),
            F.min(F.when((F.col("up") == workers) & (F.col("change") == 1), F.col("at_ms"))).alias("complete_at"),
        )
    )


class _Supervisor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("worker", T.StructType([T.StructField("saved", T.StringType())]))

    def _machine(self) -> WorkerStart:
        return WorkerStart(self.state.get()[0] if self.state.exists() else None)

    def _keep(self, machine: WorkerStart) -> None:
        self.state.update((machine.saved(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (due := machine.due()) is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine, steps = self._machine(), []
        for m in pd.concat(list(rows)).sort_values(["at_ms", "arrival"]).to_dict("records"):  # one worker's part of a micro-batch
            steps += machine.take(m)
        self._keep(machine)
        yield _table(key[0], steps)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine = self._machine()
        steps = list(machine.fire(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())))
        self._keep(machine)
        yield _table(key[0], steps)

    def close(self) -> None:
        pass


def supervised_stream(messages: DataFrame) -> DataFrame:
    """The same over a stream; needs the RocksDB state store. Messages of a worker come in the order of their times, which are above 0."""
    timed = messages.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "0 seconds")
    return timed.groupBy("worker").transformWithStateInPandas(statefulProcessor=_Supervisor(), outputStructType=STEPS, outputMode="append", timeMode="EventTime")
