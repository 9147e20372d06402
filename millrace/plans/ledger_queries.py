"""Queries of the station ledger, its cycles, and the gates of workers and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import top_k_count
from ..operators import anomaly as A
from ..operators import ledger as G
from ..operators import registers
from ..operators import supervision as S
from ..operators import system
from ..sources.tables import Tables
from ..streaming import machines as M
from ..streaming.fold import fold
from .flow_queries import REGISTRY
from .registry import query

#: The same rules by subqueries over the rows before, without a window of outcomes.
JUDGED = """WITH l AS (SELECT product_id, min(arrival) AS lock_at FROM ledger_message WHERE kind = 'LOCK' GROUP BY product_id),
m AS (SELECT x.*, l.lock_at IS NULL OR x.arrival < l.lock_at AS is_open, kind IN ('RESULT', 'FAILURE') AND capture_id = expected_capture AS placed FROM ledger_message x LEFT JOIN l USING (product_id) WHERE kind <> 'LOCK'),
o AS (SELECT product_id, station_id, min(arrival) AS at, arg_min(frame_batch_id, arrival) AS frame, arg_min(inference_job_id, arrival) AS job FROM m WHERE placed AND is_open GROUP BY product_id, station_id),
f AS (SELECT m.*, placed AND (o.at IS NULL OR m.arrival <= o.at OR (frame = frame_batch_id AND job = inference_job_id)) AS fits FROM m LEFT JOIN o USING (product_id, station_id)),
r AS (SELECT a.product_id, a.station_id, a.arrival, max(b.revision) AS top, arg_max(b.verdict, b.revision * 1000000000 - b.arrival) AS top_verdict FROM f a JOIN f b ON b.product_id = a.product_id AND b.station_id = a.station_id AND b.arrival < a.arrival AND b.kind = a.kind AND b.fits AND b.is_open WHERE a.fits AND a.is_open GROUP BY ALL),
n AS (SELECT f.product_id, f.station_id, min(f.arrival) AS ng_at FROM f LEFT JOIN r USING (product_id, station_id, arrival) WHERE f.station_id = 1 AND f.kind = 'RESULT' AND f.fits AND f.is_open AND f.verdict = 2 AND (r.top IS NULL OR f.revision > r.top) GROUP BY ALL),
judged AS (SELECT f.*, CASE WHEN kind <> 'CONTRACT' AND NOT fits THEN 'IDENTITY' WHEN NOT is_open THEN 'LATE' WHEN kind = 'CONTRACT' THEN 'APPLIED' WHEN kind = 'FAILURE' THEN CASE WHEN top IS NULL OR revision > top THEN 'APPLIED' ELSE 'IGNORED' END
  WHEN ng_at < f.arrival THEN CASE WHEN verdict = 2 THEN 'IGNORED' ELSE 'CONFLICT' END WHEN top IS NULL OR revision > top THEN 'APPLIED' WHEN revision = top AND verdict <> top_verdict THEN 'CONFLICT' ELSE 'IGNORED' END AS outcome
  FROM f LEFT JOIN r USING (product_id, station_id, arrival) LEFT JOIN n USING (product_id, station_id))"""


@query("st06_station_ledger", f"{JUDGED} SELECT product_id, station_id, arrival, outcome FROM judged")
def outcomes(t: Tables) -> DataFrame:
    return G.station_outcomes(t.ledger_message).where("kind <> 'LOCK'").select("product_id", "station_id", "arrival", "outcome")


@query("st07_locked_verdicts", f"""{JUDGED}, k AS (SELECT product_id, count(*) AS locks, arg_min(inference_job_id, arrival) AS first FROM ledger_message WHERE kind = 'LOCK' GROUP BY product_id),
s AS (SELECT product_id, station_id, bool_or(kind = 'FAILURE' AND outcome = 'APPLIED') AS failed, bool_or(outcome = 'CONFLICT' OR kind = 'CONTRACT' AND outcome = 'APPLIED') AS spoilt, arg_max(verdict, arrival) FILTER (WHERE kind = 'RESULT' AND outcome = 'APPLIED') AS verdict FROM judged GROUP BY ALL)
SELECT k.product_id, CASE WHEN a.failed OR a.spoilt THEN 'FORCED_NG' WHEN a.verdict = 2 THEN 'NG' WHEN b.failed OR b.spoilt THEN 'FORCED_NG' WHEN a.verdict IS NULL OR b.verdict IS NULL THEN 'FORCED_NG' WHEN a.verdict = 1 AND b.verdict = 1 THEN 'PASS' ELSE 'NG' END AS verdict, locks,
  (SELECT count(*) - 1 FROM ledger_message x WHERE x.kind = 'LOCK' AND x.product_id = k.product_id AND x.inference_job_id = k.first) AS replays
FROM k LEFT JOIN s a ON a.product_id = k.product_id AND a.station_id = 1 LEFT JOIN s b ON b.product_id = k.product_id AND b.station_id = 2""")
def locked(t: Tables) -> DataFrame:
    return G.locked_products(G.station_outcomes(t.ledger_message))


@query("st04_ledger_register", """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n FROM registration),
fold AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, '' AS outcome, CAST(0 AS BIGINT) AS last, CAST([] AS VARCHAR[]) AS ids, CAST([] AS BIGINT[]) AS places FROM (SELECT DISTINCT session_id FROM registration) s
  UNION ALL SELECT session_id, n, arrival, outcome, CASE WHEN outcome = 'REGISTERED' THEN fifo_sequence ELSE last END, CASE WHEN outcome = 'REGISTERED' THEN list_append(ids, product_id) ELSE ids END, CASE WHEN outcome = 'REGISTERED' THEN list_append(places, fifo_sequence) ELSE places END
  FROM (SELECT f.session_id, x.n, x.arrival, x.product_id, x.fifo_sequence, f.last, f.ids, f.places, CASE WHEN x.product_id = '' OR x.fifo_sequence < 1 THEN 'INVALID' WHEN list_contains(f.ids, x.product_id) THEN CASE WHEN f.places[list_position(f.ids, x.product_id)] = x.fifo_sequence THEN 'KNOWN' ELSE 'ID_CONFLICT' END
      WHEN list_contains(f.places, x.fifo_sequence) THEN 'SEQUENCE_CONFLICT' WHEN x.fifo_sequence <= f.last THEN 'NOT_RISING' ELSE 'REGISTERED' END AS outcome
    FROM fold f JOIN numbered x ON x.session_id = f.session_id AND x.n = f.n + 1) s)
SELECT session_id, arrival, outcome FROM fold WHERE n > 0""")
def register(t: Tables) -> DataFrame:
    return registers.registered(t.registration).select("session_id", "arrival", "outcome")


@query("st05_station_cycle", """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY product_id, station_id ORDER BY arrival) AS n FROM cycle_event),
fold AS (SELECT product_id, station_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, '' AS outcome, 'PENDING' AS state, '' AS pos, '' AS cap, '' AS cmd FROM (SELECT DISTINCT product_id, station_id FROM cycle_event) s
  UNION ALL SELECT product_id, station_id, n, arrival, outcome, CASE WHEN outcome <> 'OK' THEN state ELSE CASE event WHEN 'BEGIN' THEN 'POSITIONING' WHEN 'SETTLED' THEN 'POSITION_SETTLED' WHEN 'REQUESTED' THEN 'CAPTURE_REQUESTED' WHEN 'SUCCEEDED' THEN 'CAPTURE_COMPLETED' WHEN 'RESET' THEN 'PENDING' ELSE 'FAILED' END END,
    CASE WHEN outcome = 'OK' AND event = 'RESET' THEN '' WHEN outcome = 'OK' AND event = 'BEGIN' THEN position_command ELSE pos END, CASE WHEN outcome = 'OK' AND event = 'RESET' THEN '' WHEN outcome = 'OK' AND event = 'BEGIN' THEN capture_id ELSE cap END, CASE WHEN outcome = 'OK' AND event = 'RESET' THEN '' WHEN outcome = 'OK' AND event = 'REQUESTED' THEN capture_command ELSE cmd END
  FROM (SELECT f.*  EXCLUDE (n, arrival, outcome), x.n, x.arrival, x.event, x.position_command, x.capture_id, x.capture_command,
    CASE WHEN x.event = 'BEGIN' THEN CASE WHEN f.state = 'PENDING' THEN 'OK' ELSE 'REFUSED' END WHEN x.event = 'RESET' THEN CASE WHEN f.state IN ('CAPTURE_COMPLETED', 'FAILED') THEN 'REFUSED' ELSE 'OK' END
      WHEN x.event = 'SETTLED' THEN CASE WHEN x.position_command <> f.pos THEN 'IDENTITY' WHEN f.state = 'POSITIONING' THEN 'OK' ELSE 'REPEAT' END
      WHEN x.capture_id <> f.cap THEN 'IDENTITY' WHEN x.event = 'REQUESTED' THEN CASE WHEN f.state = 'CAPTURE_REQUESTED' THEN CASE WHEN x.capture_command = f.cmd THEN 'REPEAT' ELSE 'IDENTITY' END WHEN f.state = 'POSITION_SETTLED' THEN 'OK' ELSE 'REFUSED' END ELSE 'OK' END AS outcome
    FROM fold f JOIN numbered x ON x.product_id = f.product_id AND x.station_id = f.station_id AND x.n = f.n + 1) s)
SELECT product_id, station_id, arrival, outcome, state FROM fold WHERE n > 0""")
def cycle(t: Tables) -> DataFrame:
    rows = t.cycle_event.withColumn("station", F.concat_ws("/", F.col("product_id").cast("string"), F.col("station_id").cast("string")))
    return fold(rows, "station", "arrival", M.StationCycle).select("product_id", "station_id", "arrival", "outcome", "state")


@query("st30_actuation_substate", """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY arrival) AS n FROM actuation_event),
fold AS (SELECT product_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, '' AS outcome, 'AT_SENSOR3' AS state, '' AS job, '' AS command FROM (SELECT DISTINCT product_id FROM actuation_event) p
  UNION ALL SELECT product_id, n, arrival, outcome, CASE WHEN outcome <> 'OK' THEN state WHEN event = 'BEGIN' THEN 'BEGUN' WHEN event = 'ACCEPTED' THEN 'ACTUATING' ELSE 'DONE' END, CASE WHEN outcome = 'OK' AND event = 'BEGIN' THEN actuator_job ELSE job END, CASE WHEN outcome = 'OK' AND event = 'BEGIN' THEN given ELSE command END
  FROM (SELECT f.product_id, x.n, x.arrival, x.event, x.actuator_job, x.command AS given, f.state, f.job, f.command,
    CASE WHEN x.event <> 'BEGIN' AND x.command <> f.command THEN 'IDENTITY' WHEN x.event = 'BEGIN' AND f.state = 'BEGUN' THEN CASE WHEN x.actuator_job = f.job AND x.command = f.command THEN 'REPEAT' ELSE 'IDENTITY' END
      WHEN x.event = 'BEGIN' AND f.state <> 'AT_SENSOR3' THEN 'REFUSED' WHEN x.event = 'COMPLETED' AND f.state = 'DONE' THEN 'REFUSED' ELSE 'OK' END AS outcome
    FROM fold f JOIN numbered x ON x.product_id = f.product_id AND x.n = f.n + 1) s)
SELECT product_id, arrival, outcome, state FROM fold WHERE n > 0""")
def actuation_steps(t: Tables) -> DataFrame:
    return fold(t.actuation_event, "product_id", "arrival", M.ActuationSteps).select("product_id", "arrival", "outcome", "state")


@query("st02_sensor_actions", f"{REGISTRY} SELECT sensor_id, arrival, outcome, CASE WHEN outcome = 'ACCEPTED' AND sequence % 2 = 1 THEN 'PROCESS' WHEN outcome IN ('ACCEPTED', 'DUPLICATE') THEN 'IGNORE' ELSE 'FAULT_STOP' END AS action FROM fold WHERE n > 0")
def sensor_actions(t: Tables) -> DataFrame:
    """The registry judges first; only of what it accepts the edges count."""
    judged = registers.sensor_outcomes(t.sensor_event)
    action = F.when(F.col("outcome") == "DUPLICATE", "IGNORE").when(F.col("outcome") != "ACCEPTED", "FAULT_STOP").when(F.col("sequence") % 2 == 1, "PROCESS").otherwise("IGNORE")
    return judged.select("sensor_id", "arrival", "outcome", action.alias("action"))


@query("st18_worker_readiness", "SELECT check_no, coalesce(action_ready AND status_verified AND status_instance = beat_instance AND status_session = 'live' AND beat_session = 'live' AND interface_version = '2.0' AND command_epoch = 7 AND beat_sequence >= status_sequence AND status_ready AND master_alive AND status_health = 1 AND beat_health = 1 AND received_ns > 0 AND now_ns - received_ns <= 100, false) AS ready FROM worker_state")
def ready(t: Tables) -> DataFrame:
    return S.readiness(t.worker_state, "live", 7, "2.0", 100).select("check_no", "ready")


@query("st24_fault_freeze", "SELECT check_no, CASE WHEN system_state = 6 THEN 'LOG_ONLY' ELSE 'APPLY' END AS action FROM equipment")
def freeze(t: Tables) -> DataFrame:
    return t.equipment.select("check_no", F.when(F.col("system_state") == S.FAULT_STOP, "LOG_ONLY").otherwise("APPLY").alias("action"))


ROUTES = " ".join(f"WHEN {n} THEN '{name}'" for n, name in S.COMMANDS.items())


@query("st32_operator_routes", f"""WITH c AS (SELECT *, CASE command_type {ROUTES} END AS handler, CASE WHEN request_id = '' THEN '#' || CAST(arrival AS VARCHAR) ELSE request_id END AS own FROM operator_command),
f AS (SELECT own, min(arrival) AS first_at, arg_min(reason, arrival) AS reason, arg_min(operator_id, arrival) AS operator_id, arg_min(command_type, arrival) AS command_type FROM c GROUP BY own)
SELECT arrival, CASE WHEN request_id <> '' AND NOT regexp_matches(request_id, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') THEN 'INVALID_ID' WHEN c.reason <> f.reason OR c.operator_id <> f.operator_id OR c.command_type <> f.command_type THEN 'CONFLICT'
  WHEN arrival > first_at THEN 'REPLAY' WHEN handler IS NULL THEN 'UNKNOWN' WHEN handler = 'CONFIRM_LINE_CLEAR' AND c.operator_id = '' THEN 'OPERATOR_MISSING' ELSE handler END AS route FROM c JOIN f USING (own)""")
def routes(t: Tables) -> DataFrame:
    return S.routed(t.operator_command).select("arrival", "route")


@query("st39_status_readiness", "SELECT check_no, status_health = 1 AND status_session <> '' AND status_session = 'live' AND now_ns - received_ns <= 90 AS ready FROM worker_state")
def status_ready(t: Tables) -> DataFrame:
    fine = (F.col("status_health") == S.READY) & (F.col("status_session") != "") & (F.col("status_session") == "live") & (F.col("now_ns") - F.col("received_ns") <= 90)
    return t.worker_state.select("check_no", fine.alias("ready"))


@query("st46_serial_correlation", "SELECT c.sequence, CASE WHEN min(a.received_ms) IS NULL THEN 'timeout' WHEN arg_min(a.status, a.received_ms) = 'OK' THEN 'OK' ELSE 'rejected: ' || arg_min(a.status, a.received_ms) END AS outcome FROM serial_command c LEFT JOIN serial_answer a ON a.sequence = c.sequence AND a.received_ms >= c.sent_ms AND a.received_ms < c.sent_ms + 100 GROUP BY c.sequence, c.sent_ms")
def serial(t: Tables) -> DataFrame:
    return S.acknowledged(t.serial_command, t.serial_answer, 100)


@query("st46_serial_prune", "SELECT sequence, received_ms, received_ms < 30000 - 15000 AS stale FROM serial_answer a WHERE NOT EXISTS (SELECT 1 FROM serial_command c WHERE c.sequence = a.sequence)")
def pruned(t: Tables) -> DataFrame:
    return S.uncollected(t.serial_answer, t.serial_command, 30_000).select("sequence", "received_ms", "stale")


@query("f10_capture_goal", "SELECT goal_no, capture_id, NOT shutdown AND product_id <> '' AND capture_id <> '' AND command_id <> '' AND NOT cancelled AND (station_id = 1 AND camera_list = 'CAM0,CAM1,CAM2' OR station_id = 2 AND camera_list = 'CAM3') AS accepted FROM capture_goal")
def goals(t: Tables) -> DataFrame:
    return S.accepted_goals(t.capture_goal.withColumn("cameras", F.split("camera_list", ",")))


def _values(options: list[tuple[str, float]]) -> str:
    return ", ".join(f"('{m}', CAST({v} AS DOUBLE))" for m, v in options)


FIELDS = ", ".join(f"('{m}', '{f}')" for m, f in S.OPTION_FIELDS.items())


@query("f19_normalization_option", f"""WITH o AS (SELECT option_no, json_extract_string(normalization, '$.method') AS method, list_sort(json_keys(normalization)) AS keys, normalization FROM option_text), x AS (SELECT o.*, v.field, try_cast(json_extract_string(normalization, '$.' || coalesce(field, 'none')) AS DOUBLE) AS value FROM o LEFT JOIN (VALUES {FIELDS}) v(method, field) USING (method))
SELECT option_no, CASE WHEN field IS NULL OR keys <> list_sort(['method', field]) THEN 'keys' WHEN value IS NULL OR value <= 0 OR NOT isfinite(value) THEN 'value' WHEN NOT EXISTS (SELECT 1 FROM (VALUES {_values(A.normalizations())}) c(m, v) WHERE m = method AND v = value) THEN 'candidate' END AS error FROM x""")
def normalization_options(t: Tables) -> DataFrame:
    return t.option_text.select("option_no", S.normalization_error(F.col("normalization")).alias("error"))


@query("f19_aggregation_option", f"""WITH x AS (SELECT option_no, json_extract_string(aggregation, '$.method') AS method, list_sort(json_keys(aggregation)) AS keys, try_cast(coalesce(json_extract_string(aggregation, '$.percentile'), json_extract_string(aggregation, '$.top_k_percent')) AS DOUBLE) AS value, json_extract_string(aggregation, '$.rounding') AS rounding, json_extract_string(aggregation, '$.minimum_patch_count') AS least FROM option_text)
SELECT option_no, CASE WHEN method NOT IN ('percentile', 'top_k_percent_average') THEN 'method' WHEN keys <> CASE method WHEN 'percentile' THEN ['method', 'percentile'] ELSE ['method', 'minimum_patch_count', 'rounding', 'top_k_percent'] END THEN 'keys'
  WHEN NOT EXISTS (SELECT 1 FROM (VALUES {_values(A.aggregations())}) c(m, v) WHERE m = method AND v = value) THEN 'candidate' WHEN method <> 'percentile' AND rounding <> 'ceil' THEN 'rounding' WHEN method <> 'percentile' AND least <> '1' THEN 'minimum' END AS error FROM x""")
def aggregation_options(t: Tables) -> DataFrame:
    return t.option_text.select("option_no", S.aggregation_error(F.col("aggregation")).alias("error"))


@query("f28_preprocessing", """WITH x AS (SELECT option_no, list_sort(json_keys(preprocessing)) AS keys, json_type(preprocessing, '$.v_threshold') AS kind, try_cast(json_extract_string(preprocessing, '$.v_threshold') AS BIGINT) AS threshold, json_extract_string(preprocessing, '$.connectivity') AS connectivity, json_extract_string(preprocessing, '$.remove_disconnected_noise') AS noise, json_extract_string(preprocessing, '$.check_connection') AS connection FROM option_text)
SELECT option_no, CASE WHEN keys <> ['check_connection', 'connectivity', 'remove_disconnected_noise', 'v_threshold'] THEN 'keys' WHEN kind NOT IN ('UBIGINT', 'BIGINT') THEN 'types' WHEN threshold NOT BETWEEN 0 AND 255 THEN 'threshold' WHEN connectivity <> '8' THEN 'connectivity' WHEN noise <> 'true' OR connection <> 'false' THEN 'policy' END AS error FROM x""")
def preprocessing(t: Tables) -> DataFrame:
    return t.option_text.select("option_no", S.preprocessing_error(F.col("preprocessing")).alias("error"))


@query("c31_late_operation", "SELECT goal_no, ['correlation_id', 'operation', 'product'] AS keys, 'capture' AS operation, capture_id AS correlation_id FROM capture_goal")
def late_operations(t: Tables) -> DataFrame:
    """The caller's own ``operation`` is overwritten."""
    made = S.late_operation(F.create_map(F.lit("operation"), F.lit("mine"), F.lit("product"), F.col("product_id")), F.lit("capture"), F.col("capture_id"))
    rows = t.capture_goal.select("goal_no", made.alias("d"))
    return rows.select("goal_no", F.array_sort(F.map_keys("d")).alias("keys"), F.col("d")["operation"].alias("operation"), F.col("d")["correlation_id"].alias("correlation_id"))


@query("st42_queue_pauses", """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n FROM queue_message),
fold AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, '' AS action, 'FREE' AS state FROM (SELECT DISTINCT session_id FROM queue_message) s
  UNION ALL SELECT f.session_id, x.n, x.arrival, CASE WHEN x.frozen THEN 'IGNORED' WHEN f.state = 'FREE' AND x.kind = 'BLOCKED' THEN 'PAUSE' WHEN f.state <> 'FREE' AND x.kind = 'ACCEPTING' AND x.paused THEN 'RESUME' WHEN f.state = 'RECOVERED' AND x.kind = 'STOPPED' AND x.paused THEN 'RESUME'
      WHEN f.state = 'FULL' AND x.kind = 'ACCEPTING' THEN 'WAIT' ELSE 'NONE' END,
    CASE WHEN x.frozen THEN f.state WHEN f.state = 'FREE' AND x.kind = 'BLOCKED' THEN 'FULL' WHEN f.state <> 'FREE' AND x.kind = 'ACCEPTING' AND x.paused THEN 'FREE' WHEN f.state = 'RECOVERED' AND x.kind = 'STOPPED' AND x.paused THEN 'FREE'
      WHEN f.state = 'FULL' AND x.kind = 'ACCEPTING' THEN 'RECOVERED' ELSE f.state END FROM fold f JOIN numbered x ON x.session_id = f.session_id AND x.n = f.n + 1)
SELECT session_id, arrival, action, state FROM fold WHERE n > 0""")
def queue_pauses(t: Tables) -> DataFrame:
    return system.queue_pauses(t.queue_message).select("session_id", "arrival", "action", "state")


@query("f26_model_identity", "SELECT entry_no, CASE WHEN NOT starts_with(path, '/') THEN 'path' WHEN coalesce(version, '') = '' THEN 'version' WHEN NOT regexp_full_match(lower(expected), '[0-9a-f]{64}') THEN 'digest' WHEN lower(expected) <> actual THEN 'differs' END AS error FROM model_entry")
def identities(t: Tables) -> DataFrame:
    return t.model_entry.select("entry_no", S.model_identity_error(*map(F.col, ("path", "version", "expected", "actual"))).alias("error"))


@query("c21_config_fingerprint", """SELECT entry_no, sha256('{"camera_ids_station_a":["CAM0","CAM1","CAM2"],"model_version":' || CASE WHEN version IS NULL THEN 'null' ELSE '"' || version || '"' END || ',"serialize_model_access":' || CASE WHEN serialize_access THEN 'true' ELSE 'false' END || ',"worker_count":' || CAST(worker_count AS VARCHAR) || '}') AS fingerprint FROM model_entry""")
def fingerprints(t: Tables) -> DataFrame:
    settings = {"worker_count": F.col("worker_count"), "serialize_model_access": F.col("serialize_access"), "model_version": F.col("version"), "camera_ids_station_a": F.array(*map(F.lit, ("CAM0", "CAM1", "CAM2")))}
    return t.model_entry.select("entry_no", S.fingerprint(settings).alias("fingerprint"))


@query("s19_timeout_tuning", """WITH p AS (SELECT document_no, CASE WHEN json_valid(document) THEN document END AS d FROM tuning_text), j AS (SELECT document_no, CASE WHEN json_type(d) = 'OBJECT' THEN d END AS d FROM p),
x AS (SELECT document_no, d, CASE WHEN d IS NULL THEN 'document' WHEN json_extract_string(d, '$.model_version') <> 'm1' OR json_extract_string(d, '$.model_sha256') <> 'sha' OR json_extract_string(d, '$.config_fingerprint') <> 'fp' THEN 'identity'
  WHEN json_extract_string(d, '$.schema_version') <> '1' OR CAST(json_extract_string(d, '$.minimum_samples') AS INT) < 50 OR CAST(json_extract_string(d, '$.safety_factor') AS DOUBLE) <> 1.5 OR list_sort(json_keys(d, '$.timeouts_ms')) <> ['station_a', 'station_b'] THEN 'eligibility' END AS error FROM j)
SELECT document_no, error, CASE WHEN error IS NULL AND CAST(json_extract_string(d, '$.timeouts_ms.station_a') AS BIGINT) > 0 THEN CAST(json_extract_string(d, '$.timeouts_ms.station_a') AS BIGINT) END AS station_a, CASE WHEN error IS NULL AND CAST(json_extract_string(d, '$.timeouts_ms.station_b') AS BIGINT) > 0 THEN CAST(json_extract_string(d, '$.timeouts_ms.station_b') AS BIGINT) END AS station_b FROM x""")
def tuning(t: Tables) -> DataFrame:
    error, a, b = S.tuned_timeouts(F.col("document"), {"model_version": "m1", "model_sha256": "sha", "config_fingerprint": "fp"}, 50, 1.5)
    return t.tuning_text.select("document_no", error.alias("error"), a.alias("station_a"), b.alias("station_b"))


@query("f29_spatial_payload", "SELECT payload_no, CASE WHEN count(DISTINCT patch) <> 16 THEN 'grid' WHEN NOT bool_and(isfinite(center) AND isfinite(denominator) AND isfinite(raw_scale)) THEN 'not finite' WHEN min(denominator) <= 0 THEN 'denominator' WHEN min(raw_scale) < 0 THEN 'raw scale' WHEN min(scale_reference) <= 0 OR min(sample_count) < 2 THEN 'metadata' END AS error FROM spatial_patch GROUP BY payload_no")
def spatial(t: Tables) -> DataFrame:
    return S.spatial_errors(t.spatial_patch, A.PATCHES)


@query("c32_policy_counts", "WITH o(percent) AS (VALUES " + ", ".join(f"(CAST({p} AS DOUBLE))" for p in A.TOP_K_PERCENTS) + "), g AS (SELECT view, count(DISTINCT patch) AS patches FROM (SELECT CAST(floor(i / 16) AS INT) AS view, i % 16 AS patch FROM (SELECT unnest(range(0, len(embedding))) AS i FROM embeddings) r) x GROUP BY view) SELECT percent, view, CAST(greatest(1, ceil(patches * percent / 100)) AS BIGINT) AS effective FROM o, g")
def policy_counts(t: Tables) -> DataFrame:
    """How many patches of a view's grid each top-k option averages; the grids are those of the vectors."""
    grids = A.patches(t.embeddings).groupBy("view").agg(F.count_distinct("patch").alias("patches"))
    return grids.select("view", "patches", F.explode(F.array(*map(F.lit, A.TOP_K_PERCENTS))).alias("percent")).select("percent", "view", top_k_count(F.col("patches"), F.col("percent")).cast("long").alias("effective"))
