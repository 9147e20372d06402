"""Queries of the contracts between the line's nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as K
from ..sources.tables import Tables
from .registry import query

HEX = "regexp_matches(sha256, '^[0-9a-f]{64}$')"
NAMED = "list(camera_id ORDER BY camera_id)"
REQUIRED = "CASE station_id WHEN 1 THEN ['CAM0', 'CAM1', 'CAM2'] ELSE ['CAM3'] END"


@query("f11_capture_result", f"SELECT capture_no, bool_and(frame_batch_id <> '') AND bool_and(inference_job_id <> '') AND min(width) > 0 AND min(height) > 0 AND bool_and(attempt_count >= 1 AND {HEX} AND file_path <> '' AND file_size > 0 AND pixel_format = 'MONO8_PNG') AND {NAMED} = {REQUIRED} AS complete FROM capture_image GROUP BY capture_no, station_id")
def results(t: Tables) -> DataFrame:
    return K.complete_results(t.capture_image)


@query("f13_capture_batch", f"""SELECT capture_no, CASE WHEN NOT bool_and(requested_ns > 0) THEN 'trigger missing' WHEN NOT bool_and(returned_ns >= requested_ns) THEN 'trigger order' WHEN min(requested_wall_ns) <= 0 THEN 'wall clock missing' WHEN max(requested_wall_ns - returned_wall_ns) > 0 THEN 'wall clock order' WHEN count(DISTINCT camera_id) <> count(*) THEN 'duplicate camera' WHEN {NAMED} <> {REQUIRED} THEN 'cameras differ'
  WHEN max(lost_packets) > 0 THEN 'packet loss' WHEN NOT bool_and(starts_with(file_path, '/')) THEN 'path not absolute' WHEN NOT bool_and({HEX}) THEN 'digest' WHEN min(file_size) <= 0 THEN 'file size' WHEN count(*) FILTER (WHERE pixel_format <> 'MONO8_PNG') > 0 THEN 'pixel format' END AS error FROM capture_image GROUP BY capture_no, station_id""")
def batches(t: Tables) -> DataFrame:
    return K.batch_errors(t.capture_image)


@query("f12_model_output", "SELECT job_id, count(*) = CASE station_id WHEN 1 THEN 3 ELSE 1 END AND bool_and(view_verdict IN (1, 2)) AND verdict = CASE WHEN bool_or(view_verdict = 2) THEN 2 ELSE 1 END AND bool_and(coalesce(isfinite(view_score), false)) AND count(*) FILTER (WHERE score IS NULL OR NOT isfinite(score)) = 0 AND min(image_paths) = max(image_paths) AND max(image_paths) = CASE station_id WHEN 1 THEN 3 ELSE 1 END AS valid FROM model_view GROUP BY job_id, station_id, verdict")
def outputs(t: Tables) -> DataFrame:
    return K.valid_outputs(t.model_view)


@query("x02_key_set", "SELECT event_id, list_sort(list_filter(['payload', 'schema_version', 'session_id'], lambda k: NOT list_contains(json_keys(payload_json), k))) AS missing, list_sort(list_filter(json_keys(payload_json), lambda k: NOT list_contains(['payload', 'schema_version', 'session_id'], k))) AS extra FROM log_event WHERE json_valid(payload_json)")
def key_set(t: Tables) -> DataFrame:
    missing, extra = K.key_differences(F.col("payload_json"), ["payload", "schema_version", "session_id"])
    return t.log_event.where(F.try_parse_json("payload_json").isNotNull()).select("event_id", missing.alias("missing"), extra.alias("extra"))


@query("x03_disjoint_stations", "SELECT line, NOT list_has_any(coalesce(list(camera_id) FILTER (WHERE station_id = 1), []), coalesce(list(camera_id) FILTER (WHERE station_id = 2), [])) AS disjoint FROM (SELECT DISTINCT CAST(floor(capture_no / 40) AS BIGINT) AS line, station_id, camera_id FROM capture_image) x GROUP BY line")
def disjoint(t: Tables) -> DataFrame:
    used = lambda station: F.collect_set(F.when(F.col("station_id") == station, F.col("camera_id")))
    rows = t.capture_image.groupBy(F.floor(F.col("capture_no") / 40).alias("line")).agg(used(1).alias("a"), used(2).alias("b"))  # a few cameras
    return rows.select("line", (~F.arrays_overlap("a", "b")).alias("disjoint"))


@query("st38_heartbeat_gate", """WITH ours AS (SELECT *, coalesce(max(CASE WHEN interface_version = '2.0' AND session_id = 'live' THEN command_epoch END) OVER (PARTITION BY node_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM master_beat),
judged AS (SELECT *, CASE WHEN interface_version <> '2.0' THEN 'VERSION' WHEN session_id <> 'live' THEN 'SESSION' WHEN command_epoch < known THEN 'STALE' WHEN system_state NOT BETWEEN 0 AND 7 THEN 'FAULT' ELSE 'ALIVE' END AS outcome FROM ours)
SELECT node_id, arrival, outcome, CASE WHEN outcome IN ('FAULT', 'ALIVE') THEN command_epoch ELSE known END AS epoch FROM judged""")
def beats(t: Tables) -> DataFrame:
    return K.beat_outcomes(t.master_beat, "live").select("node_id", "arrival", "outcome", "epoch")


@query("st25_actuation_ids", """WITH a AS (SELECT *, CASE WHEN verdict = 'PASS' THEN 'PASS_THROUGH' ELSE 'DIVERT_NG' END AS command FROM actuation)
SELECT arrival, command, CASE WHEN row_number() OVER w = 1 THEN 'NEW' WHEN product_id = first_value(product_id) OVER w AND command = first_value(command) OVER w THEN 'REPLAY' ELSE 'CONFLICT' END AS state FROM a WINDOW w AS (PARTITION BY actuation_id ORDER BY arrival)""")
def actuation(t: Tables) -> DataFrame:
    return K.actuations(t.actuation)
