"""Queries that run as streams: several starts on one checkpoint, over files that arrive between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import shared_folder
from ..sources.tables import Tables
from ..streaming import ingest
from ..streaming import supervision as V
from .event_queries import REJECT
from .registry import query

#: Parts in which the arrivals of a registered stream come; each is followed by a start of the stream.
PARTS = 3

ARRIVALS = REJECT.replace("log_event", "arrival_event").replace("SELECT event_id,", "SELECT *,")


def _by_arrival(rows: DataFrame, order: str) -> list[DataFrame]:
    """The rows in ``PARTS`` stretches of their order, of about equal number."""
    cuts = rows.approxQuantile(order, [i / PARTS for i in range(1, PARTS)], 0.01)
    ends = [None, *cuts, None]
    return [rows.where((F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high)) for low, high in zip(ends, ends[1:], strict=False)]


def _appended(t: Tables) -> tuple[str, DataFrame]:
    """The arrivals through the stream, part by part; the store's folder and the arrivals."""
    folder, rows = shared_folder(t.spark), t.arrival_event
    ingest.prepare(t.spark, folder, rows.schema)
    for part in _by_arrival(rows, "arrival"):
        part.write.mode("append").parquet(f"{folder}/incoming")
        ingest.run_to_end(t.spark, f"{folder}/incoming", folder, rows.schema)
    return folder, rows


STATES = f"""SELECT arrival, log_id, revision, reject_reason, CASE WHEN reject_reason IS NOT NULL THEN 'REJECTED' WHEN n = 1 THEN 'NEW' WHEN payload_digest = known THEN 'REPLAY' ELSE 'CONFLICT' END AS state FROM (
  SELECT *, row_number() OVER w AS n, first_value(payload_digest) OVER w AS known FROM ({ARRIVALS}) r WINDOW w AS (PARTITION BY log_id, revision, reject_reason IS NULL ORDER BY arrival)) s"""


@query("s01_stream_append", STATES)
def stream_append(t: Tables) -> DataFrame:
    """Verdict of every arrival, as the stream gave it batch by batch."""
    folder, rows = _appended(t)
    return ingest.committed(t.spark, folder, ingest.VERDICTS, rows.schema).select("arrival", "log_id", "revision", "reject_reason", "state")


@query("k01_ack_after_commit", f"""SELECT s.log_id, s.revision, count(*) AS acks, CAST(sum(CASE WHEN s.state = 'NEW' THEN 1 ELSE 0 END) AS BIGINT) AS commits, min(s.arrival) AS committed_arrival
FROM ({STATES}) s WHERE s.state IN ('NEW', 'REPLAY') GROUP BY s.log_id, s.revision""")
def ack_after_commit(t: Tables) -> DataFrame:
    """Acknowledged identities, held against the stored events: how often each was acknowledged and stored, and the arrival that is stored."""
    folder, rows = _appended(t)
    acks = ingest.committed(t.spark, folder, ingest.ACKS, rows.schema).groupBy("log_id", "revision").agg(F.count(F.lit(1)).alias("acks"))
    events = ingest.committed(t.spark, folder, ingest.EVENTS, rows.schema).groupBy("log_id", "revision").agg(F.count(F.lit(1)).alias("commits"), F.min("arrival").alias("committed_arrival"))
    return acks.join(events, ["log_id", "revision"], "left")


#: One step at a time: a timer that is due before the next message, or that message. Layer by layer: what is next, what it tells, whether all evidence agrees, what follows.
STEPS = """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY at_ms, arrival) AS n FROM worker_message), horizon AS (SELECT max(at_ms) AS last FROM worker_message),
fold AS (SELECT worker, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS at_ms, '' AS cause, 'IDLE' AS phase, 0 AS attempt, CAST(NULL AS BIGINT) AS deadline, CAST(NULL AS BIGINT) AS retry, CAST(NULL AS BIGINT) AS poll,
    FALSE AS asked, FALSE AS acted, FALSE AS verified, FALSE AS ready, FALSE AS manual, CAST(1 AS BIGINT) AS epoch, '' AS beat, CAST(0 AS BIGINT) AS beat_no, FALSE AS beat_ok, CAST(0 AS BIGINT) AS beat_at, '' AS seen, CAST(0 AS BIGINT) AS seen_no, CAST(0 AS BIGINT) AS seen_epoch, FALSE AS seen_ok
  FROM (SELECT DISTINCT worker FROM worker_message) w
  UNION ALL
  SELECT worker, CASE WHEN fires THEN n ELSE n + 1 END, step + 1, t, act,
    CASE WHEN failed THEN 'RETRY_WAIT' WHEN act IN ('START', 'RETRY') THEN 'WAITING_GOAL' WHEN act = 'GOAL' THEN 'WAITING_RESULT' WHEN act IN ('RESULT', 'UNHEALTHY') THEN 'WAITING_STATUS' WHEN act = 'EPOCH' AND acted THEN 'WAITING_STATUS' WHEN act = 'READY' THEN 'READY' ELSE phase END,
    CASE WHEN act IN ('START', 'RETRY') THEN attempt + 1 ELSE attempt END,
    CASE WHEN failed OR act IN ('READY', 'UNHEALTHY') OR (act = 'EPOCH' AND acted) THEN NULL WHEN act IN ('START', 'RETRY', 'RESULT') THEN t + 3000 ELSE deadline END,
    CASE WHEN failed THEN t + 1500 WHEN act IN ('START', 'RETRY') THEN NULL ELSE retry END,
    CASE WHEN failed OR act IN ('RESULT', 'POLL', 'READY') THEN NULL WHEN act IN ('STATUS_WAIT', 'UNHEALTHY') OR (act = 'EPOCH' AND acted) THEN t + 800 ELSE poll END,
    CASE WHEN act IN ('RESULT', 'POLL') THEN TRUE WHEN failed OR act IN ('STATUS_WAIT', 'READY', 'UNHEALTHY') OR (act = 'EPOCH' AND acted) THEN FALSE ELSE asked END,
    CASE WHEN act = 'RESULT' THEN TRUE WHEN failed THEN FALSE ELSE acted END, CASE WHEN act IN ('STATUS_WAIT', 'READY') THEN TRUE WHEN failed OR act = 'EPOCH' THEN FALSE ELSE verified END,
    CASE WHEN act = 'READY' THEN TRUE WHEN failed OR act IN ('EPOCH', 'UNHEALTHY') THEN FALSE ELSE ready END, CASE WHEN failed THEN act IN ('RESULT_FATAL', 'STATUS_FATAL') WHEN act IN ('START', 'RETRY') THEN FALSE ELSE manual END,
    CASE WHEN act = 'EPOCH' THEN epoch + 1 ELSE epoch END, beat2, beat_no2, beat_ok2, beat_at2, seen2, seen_no2, seen_epoch2, seen_ok2
  FROM (SELECT *, act IN ('TIMEOUT', 'GOAL_REFUSED', 'RESULT_FAILED', 'RESULT_FATAL', 'STATUS_FATAL', 'RESTARTED') AS failed FROM (
    SELECT *, CASE WHEN fires THEN CASE WHEN deadline = due THEN 'TIMEOUT' WHEN retry = due THEN 'RETRY' ELSE 'POLL' END
      WHEN kind = 'EPOCH' THEN 'EPOCH' WHEN kind = 'START' AND phase = 'IDLE' THEN 'START' WHEN kind = 'GOAL' AND phase = 'WAITING_GOAL' THEN CASE WHEN code = 0 THEN 'GOAL' ELSE 'GOAL_REFUSED' END
      WHEN kind = 'RESULT' AND phase = 'WAITING_RESULT' THEN CASE code WHEN 0 THEN 'RESULT' WHEN 1 THEN 'RESULT_FAILED' ELSE 'RESULT_FATAL' END
      WHEN kind = 'STATUS' AND phase = 'WAITING_STATUS' AND asked THEN CASE WHEN code = 2 THEN 'STATUS_FATAL' WHEN agrees THEN 'READY' ELSE 'STATUS_WAIT' END
      WHEN kind = 'BEAT' THEN CASE WHEN stale THEN 'BEAT_STALE' WHEN beat <> '' AND beat <> instance AND phase <> 'IDLE' THEN 'RESTARTED' WHEN code <> 0 AND ready THEN 'UNHEALTHY' WHEN code = 0 AND phase = 'WAITING_STATUS' AND verified AND agrees THEN 'READY' ELSE 'BEAT' END
      ELSE 'IGNORED' END AS act FROM (
    SELECT *, acted AND seen2 <> '' AND seen2 = beat2 AND seen_ok2 AND beat_ok2 AND seen_epoch2 = epoch AND beat_no2 >= seen_no2 AND t - beat_at2 <= 4000 AS agrees FROM (
    SELECT *, CASE WHEN beats THEN instance ELSE beat END AS beat2, CASE WHEN beats THEN number ELSE beat_no END AS beat_no2, CASE WHEN beats THEN code = 0 ELSE beat_ok END AS beat_ok2, CASE WHEN beats THEN t ELSE beat_at END AS beat_at2,
      CASE WHEN tells THEN instance ELSE seen END AS seen2, CASE WHEN tells THEN number ELSE seen_no END AS seen_no2, CASE WHEN tells THEN m_epoch ELSE seen_epoch END AS seen_epoch2, CASE WHEN tells THEN code = 0 ELSE seen_ok END AS seen_ok2 FROM (
    SELECT *, NOT fires AND kind = 'BEAT' AND NOT stale AS beats, NOT fires AND kind = 'STATUS' AND phase = 'WAITING_STATUS' AND asked AND code <> 2 AS tells FROM (
    SELECT *, due <= coalesce(m_at, last) AS fires, CASE WHEN due <= coalesce(m_at, last) THEN due ELSE m_at END AS t, coalesce(number <= 0 OR (beat = instance AND number <= beat_no), FALSE) AS stale FROM (
    SELECT f.*, x.kind, x.code, x.instance, x.number, x.epoch AS m_epoch, x.at_ms AS m_at, h.last, least(coalesce(f.deadline, 1000000000000), coalesce(f.retry, 1000000000000), coalesce(f.poll, 1000000000000)) AS due
    FROM fold f LEFT JOIN numbered x ON x.worker = f.worker AND x.n = f.n + 1 CROSS JOIN horizon h) a WHERE m_at IS NOT NULL OR due <= last) b) c) d) e) g) i)"""
SHOWN = "worker, step, at_ms, cause, phase, attempt, ready, manual"


@query("st18_worker_supervision", f"{STEPS} SELECT {SHOWN} FROM fold WHERE step > 0")
def worker_supervision(t: Tables) -> DataFrame:
    return V.supervised(t.worker_message)


@query("st37_initialization", f"""{STEPS}, flips AS (SELECT *, split_part(worker, '/', 1) AS line, CAST(ready AS INT) - coalesce(lag(CAST(ready AS INT)) OVER (PARTITION BY worker ORDER BY step), 0) AS change FROM fold WHERE step > 0),
together AS (SELECT *, sum(change) OVER (PARTITION BY line ORDER BY at_ms, worker, step) AS up FROM flips)
SELECT line, CAST(count(DISTINCT worker) AS BIGINT) AS workers, CAST(sum(CASE WHEN cause IN ('START', 'RETRY') THEN 1 ELSE 0 END) AS BIGINT) AS attempts, CAST(sum(CASE WHEN cause = 'TIMEOUT' THEN 1 ELSE 0 END) AS BIGINT) AS timeouts, bool_or(manual) AS needs_operator,
  min(CASE WHEN up = 2 AND change = 1 THEN at_ms END) AS complete_at FROM together GROUP BY line""")
def initialization(t: Tables) -> DataFrame:
    """Of each line: attempts, timeouts, whether an operator was needed, and when both workers were first ready together."""
    return V.initializations(V.supervised(t.worker_message), 2)
