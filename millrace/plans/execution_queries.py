"""Queries of work in progress: jobs, deadlines, actuations, discarded images, snapshots, and the checks of the older tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import execution as X
from ..operators import manifest as M
from ..sources.tables import Tables
from .registry import query


def _late(at: str) -> str:
    return f"coalesce({at} - enqueued_ns > timeout_ms * 1000000, false)"


def _gone(at: str) -> str:
    return f"coalesce(cancelled_ns <= {at}, false)"


@query("st20_job_stages", f"""WITH f AS (SELECT job_id, image_no, CASE WHEN first_error = 'preprocessing' THEN 'PREPROCESSING' WHEN first_error = '' THEN NULL WHEN {_late('retried_ns')} THEN 'TIMEOUT' WHEN second_error = 'preprocessing' THEN 'PREPROCESSING' WHEN second_error <> '' THEN 'FILE_READ' END AS failure FROM job_image JOIN job_run USING (job_id)),
u AS (SELECT job_id, arg_min(failure, image_no) AS unread FROM f WHERE failure IS NOT NULL GROUP BY job_id),
s AS (SELECT r.*, CASE WHEN {_gone('dequeued_ns')} THEN 'DEQUEUED_BEFORE_LOAD' WHEN {_late('dequeued_ns')} THEN 'TIMEOUT' WHEN unread IS NOT NULL THEN unread WHEN {_gone('loaded_ns')} THEN 'LOADED_BEFORE_FORWARD' WHEN {_late('loaded_ns')} OR forward_error = 'deadline' THEN 'TIMEOUT'
  WHEN starts_with(lower(forward_error), 'cuda out of memory') THEN 'CUDA_OOM' WHEN forward_error <> '' THEN 'MODEL' END AS stopped FROM job_run r LEFT JOIN u USING (job_id))
SELECT job_id, coalesce(stopped, CASE WHEN {_gone('completed_ns')} THEN 'DISCARDED_AFTER_FORWARD' WHEN {_late('completed_ns')} THEN 'TIMEOUT' ELSE 'SUCCESS' END) AS outcome, CASE WHEN stopped IS NULL THEN (loaded_ns - dequeued_ns) / 1000000 END AS load_ms,
  CASE WHEN stopped IS NULL THEN (completed_ns - loaded_ns) / 1000000 END AS forward_ms, CASE WHEN stopped IS NULL THEN (completed_ns - enqueued_ns) / 1000000 END AS total_ms FROM s""")
def job_stages(t: Tables) -> DataFrame:
    return X.job_outcomes(t.job_run, t.job_image)


@query("st27_phase_deadlines", """SELECT timer_no, CASE WHEN deadline_ns = 0 OR now_ns <= deadline_ns THEN NULL WHEN phase IN ('CAPTURE_GOAL', 'WAITING_CAPTURE_RESULT') THEN CASE WHEN queue_paused THEN 'HELD' ELSE 'CAPTURE_FAILURE' END
  WHEN phase = 'WAITING_POSITION' THEN CASE WHEN conveyor_running THEN 'PAUSE_STATION' ELSE 'FAULT_STOP' END WHEN phase = 'RESUME_PENDING' THEN 'PAUSE_AND_RESUME_LATER' WHEN phase = 'WAITING_RESULT' THEN 'FAULT_STOP' WHEN phase = 'GOAL_PENDING' THEN 'PAUSE_DEVICE' ELSE 'CLEARED' END AS action FROM phase_timer""")
def deadlines(t: Tables) -> DataFrame:
    return X.overdue(t.phase_timer).select("timer_no", "action")


@query("st47_actuation_replay", """WITH f AS (SELECT command_id, arg_min(payload_digest, arrival) AS digest, coalesce(arg_min(coalesce(answer, '-'), arrival), '-') AS told, min(arrival) AS first_at, sha256(command_id) AS h FROM actuation_goal WHERE header_valid GROUP BY command_id),
s AS (SELECT g.arrival, told, h, CASE WHEN NOT header_valid THEN 'HEADER' WHEN payload_digest <> digest THEN 'CONFLICT' WHEN g.arrival > first_at THEN 'REPLAY' ELSE 'EXECUTED' END AS state FROM actuation_goal g LEFT JOIN f USING (command_id))
SELECT arrival, state, state IN ('EXECUTED', 'REPLAY') AND told = 'OK' AS success, CASE WHEN state IN ('EXECUTED', 'REPLAY') AND told = 'OK' THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 13, 3) || '-8' || substr(h, 16, 3) || '-' || substr(h, 19, 12) ELSE '' END AS actuation_id,
  CASE WHEN state IN ('HEADER', 'CONFLICT') THEN lower(state) WHEN told = 'OK' THEN 'done' WHEN told = '-' THEN 'timeout' ELSE 'rejected: ' || told END AS reason FROM s""")
def actuation_replay(t: Tables) -> DataFrame:
    return X.executed_actuations(t.actuation_goal).select("arrival", "state", "success", "actuation_id", "reason")


@query("st41_discarded_images", "WITH p AS (SELECT event_id, json_extract_string(payload_json, '$.image_paths[*]') AS paths FROM discard_event WHERE event_type = 'VISION_CAPTURE_DISCARDED') SELECT event_id, CAST(i AS INT) AS position, paths[i + 1] AS file_path FROM p, range(0, 3) r(i) WHERE i < len(paths) AND paths[i + 1] <> ''")
def discarded(t: Tables) -> DataFrame:
    return X.retained_images(t.discard_event)


@query("s11_old_split_index", """WITH v AS (SELECT DISTINCT split, view FROM old_file), a AS (SELECT split, filename FROM old_file WHERE view = 'V0')
SELECT v.split, v.view, a.filename, 'missing' AS side FROM v JOIN a USING (split) WHERE NOT EXISTS (SELECT 1 FROM old_file f WHERE f.split = v.split AND f.view = v.view AND f.filename = a.filename)
UNION ALL SELECT split, view, filename, 'extra' FROM old_file f WHERE view <> 'V0' AND NOT EXISTS (SELECT 1 FROM a WHERE a.split = f.split AND a.filename = f.filename)""")
def old_split_index(t: Tables) -> DataFrame:
    return X.view_differences(t.old_file.where(F.col("split").isin(*X.OLD_SPLITS)), "V0")


@query("f25_library_versions", "SELECT set_no, CASE WHEN anomalib IS DISTINCT FROM '2.6.0' THEN 'anomalib' WHEN torch IS DISTINCT FROM '2.12.1+cu132' THEN 'torch' WHEN lightning IS DISTINCT FROM '2.6.5' THEN 'lightning' END AS error FROM library_set")
def library_versions(t: Tables) -> DataFrame:
    installed = F.create_map(*[x for name in X.LIBRARIES for x in (F.lit(name), F.col(name))])
    return t.library_set.select("set_no", X.library_error(installed).alias("error"))


def _by_station(value: str) -> str:
    return f"'{{' || string_agg('\"' || station || '\":' || {value}, ',' ORDER BY station) || '}}'"


def _reasons(column: str) -> str:
    return f"'{{' || coalesce(string_agg('\"' || station || '\":\"' || {column} || '\"', ',' ORDER BY station) FILTER (WHERE {column} <> ''), '') || '}}'"


QUOTED = """'"' || capture_id || '"'"""
RESULT = """CASE WHEN result IS NULL THEN 'null' ELSE '"' || result || '"' END"""


@query("c30_product_snapshot", f"""SELECT product_id, '{{"product_id":"' || product_id || '","fifo_sequence":' || fifo_sequence || ',"physical_state":"' || physical_state || '","revision":' || revision || ',"capture_ids":' || {_by_station(QUOTED)} || ',"station_results":' || {_by_station(RESULT)}
  || ',"station_failure_reasons":' || {_reasons('failure_reason')} || ',"station_skip_reasons":' || {_reasons('skip_reason')} || ',"final_verdict":"' || coalesce(verdict, 'PENDING') || '"}}' AS snapshot FROM station_context GROUP BY product_id, fifo_sequence, physical_state, revision, verdict""")
def snapshots(t: Tables) -> DataFrame:
    return X.product_snapshots(t.station_context)


@query("st29_sensor_identities", "SELECT arrival, CASE WHEN sensor_event <> arg_min(sensor_event, arrival) OVER w THEN 'CONFLICT' WHEN arrival > min(arrival) OVER w THEN 'KEPT' ELSE 'RECORDED' END AS outcome FROM sensor_pass WINDOW w AS (PARTITION BY product_id, sensor_index)")
def sensor_identities(t: Tables) -> DataFrame:
    return X.sensor_identities(t.sensor_pass).select("arrival", "outcome")


VIEW_LIST = "['CAM_A_1', 'CAM_A_2', 'CAM_A_3', 'CAM_B_1']"


def _each(condition: str, names: tuple[str, ...] = ("CAM_A_1", "CAM_A_2", "CAM_A_3", "CAM_B_1")) -> str:
    """The condition with every name in place of @."""
    return "(" + " AND ".join(f"coalesce({condition.replace('@', n)}, FALSE)" for n in names) + ")"


def _same_keys(path: str, names: str) -> str:
    return f"list_sort(json_keys(text, '$.{path}')) = list_sort({names})"


N = "CAST(json_extract(text, '$.{}') AS DOUBLE)"
T = "json_extract_string(text, '$.{}')"
C = "json_extract(text, '$.candidate_selection.candidates')"
PICK = f"list_filter(CAST({C} AS JSON[]), lambda c: json_extract_string(c, '$.candidate_id') = {T.format('candidate_selection.selected_candidate_id')})"
MANIFEST = {
    "format": f"{N.format('format_version')} = 3",
    "identity": f"{T.format('algorithm')} = 'patchcore' AND {T.format('artifact_name')} = 'm1'",
    "views": f"CAST(json_extract(text, '$.view_names') AS VARCHAR[]) = {VIEW_LIST}",
    "view keys": " AND ".join(_same_keys(p, VIEW_LIST) for p in ("thresholds", "patch_grid_shapes", "memory_bank_shapes", "calibration_b_scores")),
    "policy": _same_keys("spatial_scoring_policy", "['normalization', 'aggregation', 'decision']"),
    "option": f"{N.format('spatial_scoring_policy.normalization.epsilon_ratio')} IN (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.2)",
    "decision": f"{T.format('spatial_scoring_policy.decision.comparison')} = 'strict_greater_than' AND {N.format('spatial_scoring_policy.decision.target_product_fpr')} = 0.1",
    "threshold": _each(N.format("thresholds.@") + " > 0"),
    "scores": _each("json_array_length(text, '$.calibration_b_scores.@') >= 3 AND len(list_filter(CAST(json_extract(text, '$.calibration_b_scores.@') AS DOUBLE[]), lambda x: x IS NULL)) = 0"),
    "shapes": _each("list_min(CAST(json_extract(text, '$.patch_grid_shapes.@') AS BIGINT[])) >= 1 AND list_min(CAST(json_extract(text, '$.memory_bank_shapes.@') AS BIGINT[])) >= 1"),
    "selection": f"len({PICK}) = 1",
    "candidate": f"json_extract_string({PICK}[1], '$.status') = 'valid' AND CAST(json_extract({PICK}[1], '$.eligible_for_selection') AS BOOLEAN) AND json_extract({PICK}[1], '$.thresholds') = json_extract(text, '$.thresholds') AND CAST(json_extract({PICK}[1], '$.threshold_percentile') AS DOUBLE) = {N.format('spatial_scoring_policy.decision.threshold_percentile')} AND CAST(json_extract({PICK}[1], '$.calibration_product_fpr') AS DOUBLE) <= 0.1 AND CAST(json_extract({PICK}[1], '$.validation_metrics.fpr') AS DOUBLE) <= 0.1",
    "provenance": _each(f"{N.format('dataset_provenance.@.file_count')} = 4 * {N.format('dataset_provenance.@.product_count')} AND regexp_full_match({T.format('dataset_provenance.@.sha256')}, '[0-9a-f]{{64}}')", ("calibration_a", "calibration_b", "validation_normal", "validation_anomaly")),
    "libraries": "list_has_all(json_keys(text, '$.library_versions'), ['torch', 'torchvision'])",
    "samples": f"{N.format('calibration_b_sample_policy.actual')} = json_array_length(text, '$.calibration_b_scores.CAM_A_1')",
    "benchmark": f"{N.format('parallel_benchmark.selected_parallel_count')} BETWEEN 1 AND 3 AND CAST({T.format('parallel_benchmark.all_view_memory_safety.memory_safe')} AS BOOLEAN)",
}
RULES = " ".join(f"WHEN NOT coalesce({rule}, FALSE) THEN '{name}'" for name, rule in MANIFEST.items())


@query("f21_manifest", f"SELECT manifest_no, CASE WHEN NOT json_valid(text) OR coalesce(json_type(CASE WHEN json_valid(text) THEN text END), '') <> 'OBJECT' THEN 'root' ELSE (SELECT CASE {RULES} END) END AS error FROM (SELECT manifest_no, text AS raw, CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS text FROM manifest) m".replace("NOT json_valid(text) OR", "NOT json_valid(raw) OR"))
def manifests(t: Tables) -> DataFrame:
    """The first rule that each manifest breaks, with three scores a view as enough."""
    return M.with_manifest_error(t.manifest, F.lit("m1"), 3).select("manifest_no", "error")


@query("c28_json_safe", "SELECT event_id, '{\"' || CAST(event_id % 7 AS VARCHAR) || '\":{\"' || CAST(user_id AS VARCHAR) || '\":[{\"n\":' || CAST(event_id AS VARCHAR) || ',\"none\":null},null]}}' AS text FROM events")
def safe_json(t: Tables) -> DataFrame:
    """Maps within maps whose keys are numbers."""
    listed = F.array(F.struct(F.col("event_id").alias("n"), F.lit(None).cast("string").alias("none")), F.lit(None))
    return t.events.select("event_id", M.json_safe(F.create_map(F.col("event_id") % 7, F.create_map(F.col("user_id"), listed))).alias("text"))
