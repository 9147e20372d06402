"""Queries of product flow, supervision and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.numbers import expired
from ..functions.text import is_sha256_hex, is_uuid4
from ..operators import flow as L
from ..operators import registers, system
from ..sources.tables import Tables
from ..streaming import machines as M
from ..streaming.fold import fold
from .registry import query

VERDICT = """SELECT fifo_sequence, product_id, CASE WHEN a_failed OR a_conflicted THEN 'FORCED_NG' WHEN a_verdict = 2 THEN 'NG' WHEN b_failed OR b_conflicted THEN 'FORCED_NG' WHEN a_verdict IS NULL OR b_verdict IS NULL THEN 'FORCED_NG' WHEN a_verdict = 1 AND b_verdict = 1 THEN 'PASS' ELSE 'NG' END AS verdict,
  CASE WHEN a_failed OR a_conflicted THEN 'Station A failed' WHEN a_verdict = 2 THEN 'Station A terminal NG' WHEN b_failed OR b_conflicted THEN 'Station B failed' WHEN a_verdict IS NULL OR b_verdict IS NULL THEN 'station result incomplete at Sensor3' ELSE 'both station results completed' END AS reason FROM station_facts"""


@query("st08_verdict_rules", VERDICT)
def verdicts(t: Tables) -> DataFrame:
    return t.station_facts.select("fifo_sequence", "product_id", L.final_verdict().alias("verdict"), L.verdict_reason().alias("reason"))


@query("st25_actuation", f"SELECT CASE WHEN verdict = 'PASS' THEN 'PASS_THROUGH' ELSE 'DIVERT_NG' END AS action, count(*) AS n FROM ({VERDICT}) v GROUP BY 1")
def actuations(t: Tables) -> DataFrame:
    return verdicts(t).groupBy(L.actuation(F.col("verdict")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


LOCKED = """WITH ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.product_id, s.station_id ORDER BY s.revision DESC) AS r FROM station_terminal s JOIN lock_arrival l ON l.fifo_sequence = s.fifo_sequence WHERE s.revision <= l.arrival - 100),
wide AS (SELECT l.fifo_sequence, max(CASE WHEN station_id = 1 THEN terminal_kind END) AS a_kind, max(CASE WHEN station_id = 1 THEN verdict END) AS a_verdict, max(CASE WHEN station_id = 2 THEN terminal_kind END) AS b_kind, max(CASE WHEN station_id = 2 THEN verdict END) AS b_verdict
  FROM lock_arrival l LEFT JOIN ranked r ON r.fifo_sequence = l.fifo_sequence AND r.r = 1 GROUP BY l.fifo_sequence)
SELECT fifo_sequence, CASE WHEN a_kind = 'FAILURE' THEN 'FORCED_NG' WHEN a_verdict = 2 THEN 'NG' WHEN b_kind = 'FAILURE' THEN 'FORCED_NG' WHEN a_verdict IS NULL OR b_verdict IS NULL THEN 'FORCED_NG' WHEN a_verdict = 1 AND b_verdict = 1 THEN 'PASS' ELSE 'NG' END AS verdict FROM wide"""


@query("st09_lock_at_sensor3", LOCKED)
def locked(t: Tables) -> DataFrame:
    """Only what arrived before the lock counts; the rest is late, not lost."""
    before = t.station_terminal.join(t.lock_arrival, "fifo_sequence").where(F.col("revision") <= F.col("arrival") - 100)
    latest = before.withColumn("r", F.row_number().over(W.partitionBy("product_id", "station_id").orderBy(F.desc("revision")))).where("r = 1")
    at = lambda n, c: F.max(F.when(F.col("station_id") == n, F.col(c)))
    wide = latest.groupBy("fifo_sequence").agg(at(1, "terminal_kind").alias("a_kind"), at(1, "verdict").alias("a_verdict"), at(2, "terminal_kind").alias("b_kind"), at(2, "verdict").alias("b_verdict"))
    rows = t.lock_arrival.select("fifo_sequence").join(wide, "fifo_sequence", "left")
    failed = lambda c: F.coalesce(F.col(c) == "FAILURE", F.lit(False))
    rows = rows.withColumns({"a_failed": failed("a_kind"), "b_failed": failed("b_kind"), "a_conflicted": F.lit(False), "b_conflicted": F.lit(False)})
    return rows.select("fifo_sequence", L.final_verdict().alias("verdict"))


MESSAGES = """SELECT m.message_id, CASE WHEN m.station_id_raw NOT IN (1, 2) THEN 'INVALID_STATION_ID' WHEN l.product_id IS NULL AND g.product_id IS NOT NULL THEN 'EXPIRED_PRODUCT' WHEN l.product_id IS NULL AND o.capture_id IS NOT NULL THEN 'CAPTURE_OWNER_CONFLICT'
  WHEN l.product_id IS NULL THEN 'UNKNOWN_PRODUCT' WHEN o.capture_id IS NULL OR o.owner_product <> m.product_id OR o.owner_station <> m.station_id_raw THEN 'UNREGISTERED_CAPTURE' WHEN l.removed THEN 'REMOVED_PRODUCT' WHEN coalesce(a.active_capture_id, '') <> m.capture_id THEN 'SUPERSEDED_CAPTURE'
  WHEN l.locked THEN 'LATE_AFTER_LOCK' WHEN (m.expects_verdict AND m.score IS NULL) OR (m.expects_verdict AND m.verdict_raw NOT IN (1, 2, 3)) OR m.result_revision < 1 OR m.frame_batch_id = '' OR m.inference_job_id = '' THEN 'CONTRACT_INCOMPLETE' ELSE 'ACCEPTED' END AS outcome,
  m.expects_verdict AND m.score IS NULL AS no_score
FROM station_message m LEFT JOIN ledger l ON l.product_id = m.product_id AND l.fifo_sequence = m.fifo_sequence LEFT JOIN capture_owner o ON o.capture_id = m.capture_id LEFT JOIN retired_product g ON g.product_id = m.product_id AND g.fifo_sequence = m.fifo_sequence
LEFT JOIN active_capture a ON a.product_id = m.product_id AND a.station_id = m.station_id_raw"""


def classified(t: Tables) -> DataFrame:
    return L.classify_messages(t.station_message, t.ledger, t.capture_owner, t.active_capture, t.retired_product)


@query("st10_late_classification", f"SELECT message_id, outcome, CASE WHEN outcome <> 'CONTRACT_INCOMPLETE' THEN 'NONE' WHEN no_score THEN 'SCORE_NOT_FINITE' ELSE 'PAYLOAD_INCOMPLETE' END AS defect FROM ({MESSAGES}) x")
def late(t: Tables) -> DataFrame:
    return classified(t).select("message_id", "outcome", "defect")


#: Tombstones of the registered query: few, so that some products are forgotten.
TOMBSTONES = 8


@query("st13_retirement", f"""WITH gone AS (SELECT *, removed_ms + 600000 AS retired_ms, row_number() OVER (PARTITION BY session_id ORDER BY removed_ms, product_id) AS place FROM removal)
SELECT m.message_id, CASE WHEN g.removed_ms IS NULL OR m.at_ms < g.removed_ms THEN 'ACTIVE' WHEN m.at_ms < g.retired_ms THEN 'REMOVED' WHEN g.place > (SELECT count(*) FROM gone x WHERE x.session_id = m.session_id AND x.retired_ms <= m.at_ms) - {TOMBSTONES} THEN 'RETIRED' ELSE 'FORGOTTEN' END AS life
FROM product_message m LEFT JOIN gone g ON g.session_id = m.session_id AND g.product_id = m.product_id""")
def retired(t: Tables) -> DataFrame:
    """What the line still knows of each message's product."""
    return L.retirement(t.product_message, t.removal, tombstones=TOMBSTONES).select("message_id", "life")


@query("st11_outcome_actions", f"SELECT action, count(*) AS n FROM ({MESSAGES}) x JOIN (VALUES " + ", ".join(f"('{o}', '{a}')" for o, a in L.ACTIONS) + ") a(o, action) ON a.o = x.outcome GROUP BY action")
def actions(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(L.ACTIONS, "outcome string, action string")
    return classified(t).join(F.broadcast(table), "outcome").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("j03_ledger_lookup", "SELECT count(*) AS messages, count(l.product_id) AS in_ledger, count(o.capture_id) AS captured FROM station_message m LEFT JOIN ledger l ON l.product_id = m.product_id AND l.fifo_sequence = m.fifo_sequence LEFT JOIN capture_owner o ON o.capture_id = m.capture_id")
def lookup(t: Tables) -> DataFrame:
    rows = t.station_message.join(t.ledger.select("product_id", "fifo_sequence", F.lit(1).alias("l")), ["product_id", "fifo_sequence"], "left").join(t.capture_owner.select("capture_id", F.lit(1).alias("o")), "capture_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("messages"), F.count("l").alias("in_ledger"), F.count("o").alias("captured"))


@query("st31_capture_ownership", "SELECT capture_id, count(DISTINCT owner) AS owners FROM (SELECT 'cap-' || CAST(event_id % 3000 AS VARCHAR) AS capture_id, user_id AS owner FROM events) x GROUP BY capture_id HAVING count(DISTINCT owner) > 1")
def owners(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat(F.lit("cap-"), (F.col("event_id") % 3000).cast("string")).alias("capture_id"), "user_id")
    return rows.groupBy("capture_id").agg(F.count_distinct("user_id").alias("owners")).where("owners > 1")


@query("w02_sequence_steps", "SELECT sensor_id, event_id, arrival, CASE WHEN p IS NULL THEN 'FIRST' WHEN sequence <= p THEN 'OUT_OF_ORDER' WHEN sequence <> p + 1 THEN 'SEQUENCE_GAP' ELSE 'NEXT' END AS step FROM (SELECT *, lag(sequence) OVER (PARTITION BY sensor_id ORDER BY arrival) AS p FROM sensor_event) x")
def steps(t: Tables) -> DataFrame:
    return L.sequence_steps(t.sensor_event).select("sensor_id", "event_id", "arrival", "step")


BEATS = "SELECT *, coalesce(sequence > max(sequence) OVER (PARTITION BY node_id, instance_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted, coalesce(lag(instance_id) OVER (PARTITION BY node_id ORDER BY arrival) <> instance_id, false) AS restarted FROM heartbeat"


@query("w03_heartbeat_latest", f"SELECT node_id, arrival, accepted, restarted FROM ({BEATS}) b")
def beats(t: Tables) -> DataFrame:
    return L.heartbeats(t.heartbeat).select("node_id", "arrival", "accepted", "restarted")


@query("st35_heartbeat_handling", f"SELECT node_id, CASE WHEN interface_version <> '2.1.0' THEN 'VERSION_MISMATCH' WHEN NOT accepted THEN 'STALE' WHEN restarted THEN 'RESTARTED' WHEN health <> 1 THEN 'NOT_READY' ELSE 'ALIVE' END AS outcome, count(*) AS n FROM ({BEATS}) b GROUP BY 1, 2")
def beat_handling(t: Tables) -> DataFrame:
    outcome = F.when(F.col("interface_version") != "2.1.0", "VERSION_MISMATCH").when(~F.col("accepted"), "STALE").when(F.col("restarted"), "RESTARTED").when(F.col("health") != 1, "NOT_READY").otherwise("ALIVE")
    return L.heartbeats(t.heartbeat).groupBy("node_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("j11_heartbeat_status_join", "SELECT s.node_id, s.arrival, count(*) AS later FROM heartbeat s JOIN heartbeat h ON h.node_id = s.node_id AND h.instance_id = s.instance_id AND h.sequence >= s.sequence GROUP BY s.node_id, s.arrival")
def status_join(t: Tables) -> DataFrame:
    return L.later_heartbeats(t.heartbeat)


@query("w04_fifo_alignment", "SELECT bool_and(physical_state >= nxt AND fifo_sequence < follows) AS aligned, count(*) FILTER (WHERE physical_state < nxt) AS behind FROM (SELECT fifo_sequence, physical_state, lead(physical_state) OVER w AS nxt, lead(fifo_sequence) OVER w AS follows FROM ledger WINDOW w AS (ORDER BY fifo_sequence)) y WHERE nxt IS NOT NULL")
def alignment(t: Tables) -> DataFrame:
    rows = L.neighbours(t.ledger, "fifo_sequence", "physical_state")
    return rows.agg(F.bool_and((F.col("physical_state") >= F.col("next_state")) & (F.col("fifo_sequence") < F.col("follows"))).alias("aligned"), F.count_if(F.col("physical_state") < F.col("next_state")).alias("behind"))


@query("w06_completed_prefix", "SELECT product_id, fifo_sequence FROM ledger WHERE NOT EXISTS (SELECT 1 FROM ledger f WHERE NOT f.completed AND f.fifo_sequence <= ledger.fifo_sequence)")
def prefix(t: Tables) -> DataFrame:
    return L.completed_prefix(t.ledger).select("product_id", "fifo_sequence")


@query("w07_ready_run", "SELECT session_id, n FROM (SELECT session_id, n, n - row_number() OVER (PARTITION BY session_id ORDER BY n) AS island FROM (SELECT DISTINCT 's' || CAST(user_id % 5 AS VARCHAR) AS session_id, event_id % 300 AS n FROM events WHERE event_id % 311 <> 7 AND event_id % 300 >= 1) x) y WHERE island = 0")
def run(t: Tables) -> DataFrame:
    rows = t.events.where("event_id % 311 <> 7").select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("session_id"), (F.col("event_id") % 300).alias("n"))
    return L.ready_run(rows, "session_id", "n", 1)


@query("t09_oldest_in_state", "SELECT physical_state, min(fifo_sequence) AS oldest, arg_min(product_id, fifo_sequence) AS product_id FROM ledger WHERE NOT removed GROUP BY physical_state")
def oldest(t: Tables) -> DataFrame:
    return t.ledger.where("NOT removed").groupBy("physical_state").agg(F.min("fifo_sequence").alias("oldest"), F.min_by("product_id", "fifo_sequence").alias("product_id"))


@query("t09_oldest_or_behind", """WITH a AS (SELECT * FROM ledger WHERE NOT removed), o AS (SELECT physical_state, min(fifo_sequence) AS oldest FROM a GROUP BY physical_state)
SELECT physical_state, oldest, (SELECT arg_min(product_id, fifo_sequence) FROM a WHERE a.fifo_sequence < o.oldest AND a.physical_state < o.physical_state) AS behind FROM o""")
def oldest_or_behind(t: Tables) -> DataFrame:
    """The oldest product of each state, and the first earlier product that hasn't come as far: then the state is not to be served."""
    return L.oldest_in_states(t.ledger)


@query("t05_queue_order", "SELECT job_id FROM inference_job ORDER BY fifo_sequence, enqueued_ns, station_id")
def queue_order(t: Tables) -> DataFrame:
    return t.inference_job.orderBy("fifo_sequence", "enqueued_ns", "station_id").select("job_id")


@query("c22_job_deadlines", "SELECT job_id, coalesce(job_id * 1000000 + 1500000000 - enqueued_ns > timeout_ms * 1000000, false) AS expired, CASE WHEN failure_text = '' THEN NULL WHEN lower(failure_text) LIKE '%cuda out of memory%' THEN 'CUDA_OOM' ELSE 'MODEL' END AS failure, CASE WHEN failure_text = '' THEN 0 WHEN lower(failure_text) LIKE '%cuda out of memory%' THEN 2003 ELSE 2000 END AS error_code FROM inference_job")
def deadlines(t: Tables) -> DataFrame:
    text = F.col("failure_text")
    kind = F.when(text == "", None).when(F.lower(text).contains("cuda out of memory"), "CUDA_OOM").otherwise("MODEL")
    code = F.when(kind.isNull(), 0).when(kind == "CUDA_OOM", 2003).otherwise(2000)
    return t.inference_job.select("job_id", expired(F.col("job_id") * 1_000_000 + 1_500_000_000, F.col("enqueued_ns"), F.col("timeout_ms")).alias("expired"), kind.alias("failure"), code.alias("error_code"))


@query("st40_cancellation_scope", "SELECT j.job_id FROM inference_job j WHERE NOT EXISTS (SELECT 1 FROM inference_job c WHERE c.job_id % 50 = 0 AND c.fifo_sequence = j.fifo_sequence AND c.station_id = j.station_id)")
def cancelled(t: Tables) -> DataFrame:
    scope = t.inference_job.where("job_id % 50 = 0").select("fifo_sequence", "station_id").distinct()
    return t.inference_job.join(scope, ["fifo_sequence", "station_id"], "left_anti").select("job_id")


#: The command epoch at which the gate stands.
NODE_EPOCH = 7


@query("f09_command_gate", "SELECT command_no, CASE WHEN health_state <> 1 THEN 9002 WHEN session_id <> 'live' OR command_epoch <> 7 OR NOT regexp_matches(command_id, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') OR NOT regexp_matches(payload_digest, '^[0-9a-f]{64}$') OR system_state <> 3 THEN 9000 ELSE 0 END AS error_code FROM command")
def command_gate(t: Tables) -> DataFrame:
    fine = (F.col("session_id") == "live") & (F.col("command_epoch") == NODE_EPOCH) & is_uuid4(F.col("command_id")) & is_sha256_hex(F.col("payload_digest")) & (F.col("system_state") == 3)
    return t.command.select("command_no", F.when(F.col("health_state") != 1, 9002).when(~fine, 9000).otherwise(0).alias("error_code"))


GUARD = [("system_state <> 2", "system_state"), ("NOT workers_ready", "workers_not_ready"), ("NOT mapping_confirmed", "hardware_mapping_unconfirmed"), ("NOT (cameras_a = 3 AND cameras_b = 1)", "camera_mapping_incomplete"), ("NOT spool_available", "master_log_spool_unavailable"), ("active_products <> 0", "active_products"), ("NOT line_clear", "line_clear_not_confirmed"), ("NOT conveyors_stopped", "conveyors_not_stopped"), ("NOT sensors_clear", "sensors_not_clear"), ("NOT actuator_safe", "actuator_not_safe"), ("estop", "estop_asserted")]


@query("st33_start_guard", "SELECT check_no, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in GUARD) + "], lambda x: x IS NOT NULL) AS failures FROM equipment")
def start_guard(t: Tables) -> DataFrame:
    listed = F.array(*[F.when(F.expr(c), n) for c, n in GUARD])
    return t.equipment.select("check_no", F.filter(listed, lambda x: x.isNotNull()).alias("failures"))


@query("st36_outage_severity", "SELECT check_no, CASE WHEN system_state = 1 THEN 'RETRY_INIT' WHEN worker_id = 'control' AND system_state IN (3, 4) THEN 'FAULT' WHEN worker_id = 'vision' AND system_state = 3 THEN CASE WHEN restarted THEN 'PAUSE_MANUAL' ELSE 'PAUSE_AUTO' END ELSE 'DEGRADED' END AS severity FROM equipment")
def outages(t: Tables) -> DataFrame:
    s, w = F.col("system_state"), F.col("worker_id")
    level = F.when(s == 1, "RETRY_INIT").when((w == "control") & s.isin(3, 4), "FAULT").when((w == "vision") & (s == 3), F.when(F.col("restarted"), "PAUSE_MANUAL").otherwise("PAUSE_AUTO")).otherwise("DEGRADED")
    return t.equipment.select("check_no", level.alias("severity"))


@query("st43_resume_and_reset_guards", "SELECT check_no, workers_ready AND actuator_safe AND NOT estop AS may_resume, system_state = 6 AND conveyors_stopped AND NOT estop AS may_reset FROM equipment")
def guards(t: Tables) -> DataFrame:
    calm = ~F.col("estop")
    return t.equipment.select("check_no", (F.col("workers_ready") & F.col("actuator_safe") & calm).alias("may_resume"), ((F.col("system_state") == 6) & F.col("conveyors_stopped") & calm).alias("may_reset"))


@query("f27_missing_parameters", "SELECT command_no, list_filter([CASE WHEN session_id = 'other' THEN 'session_id' END, CASE WHEN command_epoch = 0 THEN 'command_epoch' END, CASE WHEN operator_no % 9 = 0 THEN 'operator_id' END], lambda x: x IS NOT NULL) AS missing FROM command")
def missing(t: Tables) -> DataFrame:
    listed = F.array(F.when(F.col("session_id") == "other", "session_id"), F.when(F.col("command_epoch") == 0, "command_epoch"), F.when(F.col("operator_no") % 9 == 0, "operator_id"))
    return t.command.select("command_no", F.filter(listed, lambda x: x.isNotNull()).alias("missing"))


VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in L.TRANSITIONS + [(s, e, r, "FAULT_STOP") for s in L.SYSTEM_STATES for e, r in L.FAULTS])


MACHINE = f"""WITH RECURSIVE rules(state, event, rule, next_state) AS (VALUES {VALUES}), numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n FROM system_event),
fold AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, '' AS event, 'BOOT' AS state, CAST(NULL AS VARCHAR) AS rule, 'BOOT' AS next_state FROM (SELECT DISTINCT session_id FROM system_event) s
  UNION ALL SELECT f.session_id, x.n, x.arrival, x.event, f.next_state, r.rule, coalesce(r.next_state, f.next_state) FROM fold f JOIN numbered x ON x.session_id = f.session_id AND x.n = f.n + 1 LEFT JOIN rules r ON r.state = f.next_state AND r.event = x.event)
"""


@query("c29_allowed_events", f"""{MACHINE}, seen AS (SELECT state, count(*) AS met, count(rule) AS taken FROM fold WHERE n > 0 GROUP BY state) SELECT r.state, count(*) AS events, min(r.event) AS first_event, any_value(coalesce(s.met, 0)) AS met, any_value(coalesce(s.taken, 0)) AS taken FROM rules r LEFT JOIN seen s ON s.state = r.state GROUP BY r.state""")
def allowed(t: Tables) -> DataFrame:
    """Of each state: the events that it takes, and how many of those that the sessions met there were taken."""
    seen = system.system_states(t.system_event).groupBy("state").agg(F.count(F.lit(1)).alias("met"), F.count("rule").alias("taken"))
    listed = L.transitions(t.spark).groupBy("state").agg(F.count(F.lit(1)).alias("events"), F.min("event").alias("first_event"))
    none = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return listed.join(seen, "state", "left").select("state", "events", "first_event", none("met"), none("taken"))


@query("st17_system_machine", f"""{MACHINE} SELECT session_id, arrival, event, state, rule, next_state FROM fold WHERE n > 0""")
def machine(t: Tables) -> DataFrame:
    return system.system_states(t.system_event).select("session_id", "arrival", "event", "state", "rule", "next_state")


@query("st34_entry_points", f"""WITH RECURSIVE rules(state, event, rule, next_state) AS (VALUES {VALUES}), numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n,
  CASE call WHEN 'initialize' THEN 'APP_STARTED' WHEN 'initialization_done' THEN 'INIT_DONE' WHEN 'initialization_failed' THEN 'INIT_FAILED' WHEN 'initialization_timeout' THEN 'INIT_TIMEOUT' WHEN 'run' THEN 'START_REQUEST' WHEN 'running' THEN 'ALL_CONVEYORS_RUNNING'
    WHEN 'pause' THEN 'PAUSE_REQUEST' WHEN 'stopped' THEN 'ALL_CONVEYORS_STOPPED' WHEN 'pause_failed' THEN 'PAUSE_FAILED' WHEN 'pause_timeout' THEN 'PAUSE_TIMEOUT' WHEN 'resume' THEN 'RESUME_REQUEST' WHEN 'resume_automatic' THEN 'DEVICE_RECOVERED' WHEN 'reset' THEN 'RESET_REQUEST'
    WHEN 'reset_cleared' THEN 'RESET_SUCCEEDED_EMPTY_LINE' WHEN 'reset_in_place' THEN 'RESET_SUCCEEDED_IN_PLACE' WHEN 'reset_failed' THEN 'RESET_FAILED' WHEN 'reset_timeout' THEN 'RESET_TIMEOUT' WHEN 'run_failed' THEN 'RESUME_FAILED' WHEN 'estop' THEN 'ESTOP_ASSERTED'
    ELSE CASE WHEN starts_with(call, 'fault') THEN 'CRITICAL_FAULT' ELSE 'RECOVERABLE_DEVICE_FAULT' END END AS event FROM system_call),
fold AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, '' AS call, CAST(NULL AS VARCHAR) AS rule, 'BOOT' AS state, FALSE AS pending, '' AS pause, 'NONE' AS recovery FROM (SELECT DISTINCT session_id FROM system_call) s
  UNION ALL SELECT f.session_id, x.n, x.arrival, x.call, r.rule, coalesce(r.next_state, f.state),
    CASE WHEN x.event IN ('CRITICAL_FAULT', 'ESTOP_ASSERTED') THEN FALSE WHEN r.rule IS NULL THEN f.pending WHEN x.event IN ('START_REQUEST', 'RESUME_REQUEST', 'DEVICE_RECOVERED') THEN TRUE WHEN x.event IN ('ALL_CONVEYORS_RUNNING', 'RESUME_FAILED', 'PAUSE_REQUEST', 'RECOVERABLE_DEVICE_FAULT') THEN FALSE ELSE f.pending END,
    CASE WHEN r.rule IS NULL THEN f.pause WHEN x.event IN ('ALL_CONVEYORS_RUNNING', 'RESET_SUCCEEDED_EMPTY_LINE') THEN '' WHEN x.event = 'RESET_SUCCEEDED_IN_PLACE' THEN 'FAULT_RECOVERY' WHEN x.event = 'PAUSE_REQUEST' THEN 'OPERATOR'
      WHEN x.call = 'pause_automatic' THEN 'DEVICE_RECOVERY_AUTO' WHEN x.call = 'pause_manual' THEN 'DEVICE_RECOVERY_MANUAL' WHEN x.call = 'pause_storage' THEN 'STORAGE_RECOVERY' ELSE f.pause END,
    CASE WHEN x.call = 'fault_line' THEN 'LINE_CLEAR_REQUIRED' WHEN x.event IN ('CRITICAL_FAULT', 'ESTOP_ASSERTED', 'PAUSE_FAILED', 'PAUSE_TIMEOUT') THEN 'EQUIPMENT_CHECK_REQUIRED' WHEN r.rule IS NOT NULL AND starts_with(x.event, 'RESET_SUCC') THEN 'NONE' ELSE f.recovery END
    FROM fold f JOIN numbered x ON x.session_id = f.session_id AND x.n = f.n + 1
    LEFT JOIN rules r ON r.state = f.state AND r.event = CASE WHEN x.call = 'run_failed' AND f.state = 'READY' THEN 'START_FAILED' ELSE x.event END
      AND (x.guard OR x.call NOT IN ('initialization_done', 'run', 'resume', 'resume_automatic', 'reset')) AND (f.pending OR x.call <> 'running') AND (f.pause = 'DEVICE_RECOVERY_AUTO' OR x.call <> 'resume_automatic'))
SELECT session_id, arrival, call, rule IS NOT NULL AS accepted, rule, state, pending, pause, recovery,
  CASE WHEN rule IS NULL THEN '' WHEN call = 'initialize' THEN 'START_WORKERS' WHEN call IN ('run', 'resume', 'resume_automatic') THEN 'RUN' WHEN call = 'reset' THEN 'RESET' WHEN call = 'fault_line' THEN 'STOP,CLEAR' WHEN call = 'estop' OR starts_with(call, 'fault') OR starts_with(call, 'pause') THEN 'STOP' ELSE '' END AS asked FROM fold WHERE n > 0""")
def entry_points(t: Tables) -> DataFrame:
    return system.entry_points(t.system_call).select("session_id", "arrival", "call", "accepted", "rule", "state", "pending", "pause", "recovery", "asked")


#: One event of each sensor at a time, with the ids and digests of what was accepted.
REGISTRY = """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY arrival) AS n FROM sensor_event),
fold AS (SELECT sensor_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS sequence, '' AS outcome, CAST(NULL AS BIGINT) AS last, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS digests FROM (SELECT DISTINCT sensor_id FROM sensor_event) s
  UNION ALL SELECT sensor_id, n, arrival, sequence, outcome, CASE WHEN outcome = 'ACCEPTED' THEN sequence ELSE last END, CASE WHEN outcome = 'ACCEPTED' THEN list_append(ids, event_id) ELSE ids END, CASE WHEN outcome = 'ACCEPTED' THEN list_append(digests, digest) ELSE digests END
  FROM (SELECT f.sensor_id, x.n, x.arrival, x.sequence, x.event_id, x.digest, f.last, f.ids, f.digests, CASE WHEN list_contains(f.ids, x.event_id) THEN CASE WHEN f.digests[list_position(f.ids, x.event_id)] = x.digest THEN 'DUPLICATE' ELSE 'CONFLICT' END
      WHEN x.event_id = '' OR x.sequence < 1 OR x.sequence <= f.last THEN 'OUT_OF_ORDER' WHEN x.sequence > f.last + 1 THEN 'SEQUENCE_GAP' ELSE 'ACCEPTED' END AS outcome
    FROM fold f JOIN numbered x ON x.sensor_id = f.sensor_id AND x.n = f.n + 1) s)"""


@query("st01_sensor_registry", f"{REGISTRY} SELECT sensor_id, outcome, count(*) AS n FROM fold WHERE n > 0 GROUP BY sensor_id, outcome")
def registry(t: Tables) -> DataFrame:
    return registers.sensor_outcomes(t.sensor_event).groupBy("sensor_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("st03_idempotency_store", "SELECT command_no, CASE WHEN lag(payload_digest) OVER w IS NULL THEN 'NEW' WHEN first_value(payload_digest) OVER w = payload_digest THEN 'REPLAY' ELSE 'CONFLICT' END AS state FROM command WINDOW w AS (PARTITION BY operator_no, command_id ORDER BY command_no)")
def idempotency(t: Tables) -> DataFrame:
    """By the first digest of each id: in batch no id is forgotten, however many come between."""
    own = W.partitionBy("operator_no", "command_id").orderBy("command_no")
    state = F.when(F.row_number().over(own) == 1, "NEW").when(F.first("payload_digest").over(own) == F.col("payload_digest"), "REPLAY").otherwise("CONFLICT")
    return t.command.select("command_no", state.alias("state"))


@query("st16_edge_detector", """WITH told AS (SELECT *, CASE WHEN distance_cm IS NULL THEN 'CLEAR' WHEN distance_cm < 1.5 OR distance_cm > 80 THEN 'NONE' WHEN distance_cm >= 12 THEN 'CLEAR' WHEN distance_cm <= 10 AND (sensor_id = 3 OR conveyor_running) THEN 'NEAR' ELSE 'NONE' END AS said FROM distance_sample),
judged AS (SELECT *, said = 'NEAR' AND coalesce(last_value(CASE WHEN said <> 'NONE' THEN said END IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'CLEAR') = 'CLEAR' AS detected FROM told)
SELECT sensor_id, count(*) AS samples, count(*) FILTER (WHERE detected) AS detections FROM judged GROUP BY sensor_id""")
def edges(t: Tables) -> DataFrame:
    return system.detections(t.distance_sample).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if("detected").alias("detections"))


@query("st12_reorder_buffer", """WITH RECURSIVE numbered AS (SELECT 's' || CAST(user_id % 5 AS VARCHAR) AS session_id, event_id * 37 % 301 + 1 AS place, event_id AS arrival, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events WHERE event_id % 311 <> 7),
fold AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, CAST([] AS BIGINT[]) AS released, CAST([] AS BIGINT[]) AS held, CAST(1 AS BIGINT) AS next FROM (SELECT DISTINCT session_id FROM numbered) s
  UNION ALL SELECT session_id, n, arrival, range(next, missing), list_filter(waiting, lambda x: x >= missing), missing
  FROM (SELECT *, list_min(list_filter(range(next, next + len(waiting) + 1), lambda x: NOT list_contains(waiting, x))) AS missing FROM (
    SELECT f.session_id, x.n, x.arrival, f.next, CASE WHEN x.place < f.next OR list_contains(f.held, x.place) THEN f.held ELSE list_append(f.held, x.place) END AS waiting FROM fold f JOIN numbered x ON x.session_id = f.session_id AND x.n = f.n + 1) a) b)
SELECT session_id, arrival, released FROM fold WHERE len(released) > 0""")
def reorder(t: Tables) -> DataFrame:
    rows = t.events.where("event_id % 311 <> 7").select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("session_id"), (F.col("event_id") * 37 % 301 + 1).alias("fifo_sequence"), F.col("event_id").alias("arrival"))
    return fold(rows, "session_id", "arrival", M.ReorderBuffer, {"released": T.ArrayType(T.LongType())}).where(F.size("released") > 0).select("session_id", "arrival", "released")


@query("st44_spool_capacity", "SELECT bucket, sum(bytes) AS bytes, CASE WHEN sum(bytes) >= 1900 THEN 'HARD' WHEN sum(bytes) >= 1500 THEN 'WARN' ELSE 'OK' END AS level FROM (SELECT CAST(floor(created_at / 200) AS BIGINT) AS bucket, length(payload_json) AS bytes FROM spool) x GROUP BY bucket")
def capacity(t: Tables) -> DataFrame:
    rows = t.spool.groupBy(F.floor(F.col("created_at") / 200).alias("bucket")).agg(F.sum(F.length("payload_json")).alias("bytes"))
    return rows.withColumn("level", F.when(F.col("bytes") >= 1900, "HARD").when(F.col("bytes") >= 1500, "WARN").otherwise("OK"))


@query("st14_backpressure", "SELECT session_id, active, CASE WHEN active >= 20 THEN 'FAULT' WHEN active >= 18 THEN 'PAUSE' ELSE 'RUN' END AS action FROM (SELECT session_id, count(*) AS active FROM product_terminal WHERE fifo_sequence % 3 <> 0 GROUP BY session_id) x")
def backpressure(t: Tables) -> DataFrame:
    rows = t.product_terminal.where("fifo_sequence % 3 <> 0").groupBy("session_id").agg(F.count(F.lit(1)).alias("active"))
    return rows.withColumn("action", F.when(F.col("active") >= 20, "FAULT").when(F.col("active") >= 18, "PAUSE").otherwise("RUN"))


@query("st19_station_b_skip", "SELECT product_id, a_verdict = 2 AND b_verdict IS NOT NULL AS skip_b FROM station_facts WHERE a_verdict IS NOT NULL")
def skip(t: Tables) -> DataFrame:
    return t.station_facts.where("a_verdict IS NOT NULL").select("product_id", ((F.col("a_verdict") == 2) & F.col("b_verdict").isNotNull()).alias("skip_b"))
