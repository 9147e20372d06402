"""Queries of the session report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import events as E
from ..operators import report as R
from ..sources.tables import Tables
from .registry import query

RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, product_id, station_id ORDER BY revision DESC, CASE terminal_kind WHEN 'FAILURE' THEN 0 ELSE 1 END, inference_job_id) AS r FROM station_terminal)"
REPORT = f"""WITH {RANKED} SELECT p.session_id, p.fifo_sequence, p.product_id, p.final_verdict, p.reason,
  a.terminal_kind AS a_terminal_kind, a.verdict AS a_verdict, a.error_code AS a_error_code, a.model_forward_ms AS a_model_forward_ms, a.enqueue_to_result_ms AS a_enqueue_to_result_ms,
  b.terminal_kind AS b_terminal_kind, b.verdict AS b_verdict, b.error_code AS b_error_code, b.model_forward_ms AS b_model_forward_ms, b.enqueue_to_result_ms AS b_enqueue_to_result_ms,
  (coalesce(b.completed_monotonic_ns, a.completed_monotonic_ns) - a.capture_completed_monotonic_ns) / 1000000.0 AS product_total_ms
FROM product_terminal p LEFT JOIN ranked a ON a.session_id = p.session_id AND a.product_id = p.product_id AND a.station_id = 1 AND a.r = 1
LEFT JOIN ranked b ON b.session_id = p.session_id AND b.product_id = p.product_id AND b.station_id = 2 AND b.r = 1"""


@query("j01_session_report", REPORT)
def session_report(t: Tables) -> DataFrame:
    return R.product_rows(t.product_terminal, t.station_terminal)


@query("w01_latest_terminal", f"WITH {RANKED} SELECT session_id, product_id, station_id, revision, terminal_kind, inference_job_id FROM ranked WHERE r = 1")
def latest(t: Tables) -> DataFrame:
    return R.latest_terminals(t.station_terminal).select("session_id", "product_id", "station_id", "revision", "terminal_kind", "inference_job_id")


@query("s05_report_base_scan", "SELECT session_id, count(*) AS products, min(fifo_sequence) AS first_fifo FROM product_terminal WHERE session_id = 's2' GROUP BY session_id")
def base_scan(t: Tables) -> DataFrame:
    return t.product_terminal.where("session_id = 's2'").groupBy("session_id").agg(F.count(F.lit(1)).alias("products"), F.min("fifo_sequence").alias("first_fifo"))


@query("s06_timing_samples", "SELECT fifo_sequence, revision, enqueue_to_result_ms FROM station_terminal WHERE session_id = 's1' AND station_id = 2 AND terminal_kind = 'RESULT' AND enqueue_to_result_ms IS NOT NULL")
def samples(t: Tables) -> DataFrame:
    return R.station_samples(t.station_terminal.where("session_id = 's1' AND station_id = 2")).select("fifo_sequence", "revision", "enqueue_to_result_ms")


@query("s08_gpu_lookup", "SELECT session_id, count(*) AS sample_count, max(vram) AS peak_vram FROM gpu_sample WHERE session_id = 's4' GROUP BY session_id")
def gpu_lookup(t: Tables) -> DataFrame:
    return R.gpu_metrics(t.gpu_sample.where("session_id = 's4'")).select("session_id", "sample_count", "peak_vram")


TUNING = """SELECT session_id, station_id, count(*) AS sample_count, quantile_disc(enqueue_to_result_ms, 0.999) AS p999_ms, CASE WHEN count(DISTINCT model_version) = 1 THEN max(model_version) ELSE '' END AS model_version,
  CASE WHEN count(DISTINCT model_sha256) = 1 THEN max(model_sha256) ELSE '' END AS model_sha256, CASE WHEN count(DISTINCT config_fingerprint) = 1 THEN max(config_fingerprint) ELSE '' END AS config_fingerprint
  FROM station_terminal WHERE terminal_kind = 'RESULT' AND enqueue_to_result_ms IS NOT NULL GROUP BY session_id, station_id"""
TUNED = f"SELECT *, CASE WHEN eligible AND p999_ms <> 0 THEN CAST(ceil(p999_ms * 1.2) AS BIGINT) END AS timeout_ms FROM (SELECT *, sample_count >= 100 AND model_version <> '' AND model_sha256 <> '' AND config_fingerprint <> '' AS eligible FROM ({TUNING}) x) y"


@query("a01_means", "SELECT session_id, station_id, avg(model_forward_ms) AS mean_forward_ms, avg(enqueue_to_result_ms) AS mean_latency_ms FROM station_terminal GROUP BY session_id, station_id")
def means(t: Tables) -> DataFrame:
    return t.station_terminal.groupBy("session_id", "station_id").agg(F.avg("model_forward_ms").alias("mean_forward_ms"), F.avg("enqueue_to_result_ms").alias("mean_latency_ms"))


@query("a02_nearest_rank", "SELECT session_id, quantile_disc(enqueue_to_result_ms, 0.5) AS p50, quantile_disc(enqueue_to_result_ms, 0.999) AS p999 FROM station_terminal WHERE enqueue_to_result_ms IS NOT NULL GROUP BY session_id")
def nearest_rank(t: Tables) -> DataFrame:
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY enqueue_to_result_ms)")
    return t.station_terminal.where("enqueue_to_result_ms IS NOT NULL").groupBy("session_id").agg(rank(0.5).alias("p50"), rank(0.999).alias("p999"))


@query("a05_timeout_tuning", TUNED)
def tuning(t: Tables) -> DataFrame:
    return R.station_tuning(t.station_terminal)


@query("k07_tuning_document", f"SELECT a.session_id, a.model_version, a.model_sha256, a.config_fingerprint, a.timeout_ms AS a_timeout_ms, b.timeout_ms AS b_timeout_ms FROM ({TUNED}) a JOIN ({TUNED}) b ON a.session_id = b.session_id WHERE a.station_id = 1 AND b.station_id = 2 AND a.model_version = b.model_version AND a.model_sha256 = b.model_sha256 AND a.config_fingerprint = b.config_fingerprint AND a.timeout_ms IS NOT NULL AND b.timeout_ms IS NOT NULL")
def tuning_document(t: Tables) -> DataFrame:
    return R.tuning_document(R.station_tuning(t.station_terminal))


@query("a06_gpu_metrics", "SELECT session_id, count(*) AS sample_count, avg(util) AS mean_util, avg(vram) AS mean_vram, max(vram) AS peak_vram, arg_max(total_vram, sampled_at) AS total_vram FROM gpu_sample GROUP BY session_id")
def gpu(t: Tables) -> DataFrame:
    return R.gpu_metrics(t.gpu_sample)


@query("a26_capture_candidates", "SELECT session_id, count(*) AS n, avg(acquisition_ms * 2 + save_ms + validation_ms) AS mean_candidate_ms FROM capture_timing GROUP BY session_id")
def capture_candidates(t: Tables) -> DataFrame:
    return t.capture_timing.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("acquisition_ms") * 2 + F.col("save_ms") + F.col("validation_ms")).alias("mean_candidate_ms"))


@query("s07_capture_samples", "SELECT capture_id, round(acquisition_ms * 2 + save_ms + validation_ms, 6) AS timeout_candidate_ms FROM capture_timing WHERE session_id = 's3'")
def capture_samples(t: Tables) -> DataFrame:
    candidate = F.col("acquisition_ms") * 2 + F.col("save_ms") + F.col("validation_ms")
    return t.capture_timing.where("session_id = 's3'").select("capture_id", F.round(candidate, 6).alias("timeout_candidate_ms"))


@query("a27_product_totals", f"SELECT session_id, count(product_total_ms) AS n, avg(product_total_ms) AS mean_ms, quantile_disc(product_total_ms, 0.999) AS p999_ms FROM ({REPORT}) r GROUP BY session_id")
def totals(t: Tables) -> DataFrame:
    return session_report(t).groupBy("session_id").agg(F.count("product_total_ms").alias("n"), F.avg("product_total_ms").alias("mean_ms"), F.expr("percentile_disc(0.999) WITHIN GROUP (ORDER BY product_total_ms)").alias("p999_ms"))


@query("a28_same_identity", f"SELECT a.session_id, a.model_version <> '' AND a.model_sha256 <> '' AND a.config_fingerprint <> '' AND a.model_version = b.model_version AND a.model_sha256 = b.model_sha256 AND a.config_fingerprint = b.config_fingerprint AS same_identity FROM ({TUNING}) a JOIN ({TUNING}) b ON a.session_id = b.session_id WHERE a.station_id = 1 AND b.station_id = 2")
def identity(t: Tables) -> DataFrame:
    tuned = R.station_tuning(t.station_terminal)
    names = ("model_version", "model_sha256", "config_fingerprint")
    a = tuned.where("station_id = 1").select("session_id", *[F.col(n).alias(f"a_{n}") for n in names])
    b = tuned.where("station_id = 2").select("session_id", *[F.col(n).alias(f"b_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & (F.col(f"a_{n}") != "") & (F.col(f"a_{n}") == F.col(f"b_{n}"))
    return a.join(b, "session_id").select("session_id", same.alias("same_identity"))


@query("k06_session_summary", f"""SELECT p.session_id, p.product_count, m.a_mean_forward_ms, m.b_mean_forward_ms, m.mean_total_ms, c.capture_samples, c.capture_mean_ms FROM (SELECT session_id, count(*) AS product_count FROM product_terminal GROUP BY session_id) p
  JOIN (SELECT session_id, avg(a_model_forward_ms) AS a_mean_forward_ms, avg(b_model_forward_ms) AS b_mean_forward_ms, avg(product_total_ms) AS mean_total_ms FROM ({REPORT}) r GROUP BY session_id) m ON m.session_id = p.session_id
  JOIN (SELECT session_id, count(*) AS capture_samples, avg(acquisition_ms * 2 + save_ms + validation_ms) AS capture_mean_ms FROM capture_timing GROUP BY session_id) c ON c.session_id = p.session_id""")
def summary(t: Tables) -> DataFrame:
    rows = session_report(t).groupBy("session_id").agg(F.count(F.lit(1)).alias("product_count"), F.avg("a_model_forward_ms").alias("a_mean_forward_ms"), F.avg("b_model_forward_ms").alias("b_mean_forward_ms"), F.avg("product_total_ms").alias("mean_total_ms"))
    captures = capture_candidates(t).select("session_id", F.col("n").alias("capture_samples"), F.col("mean_candidate_ms").alias("capture_mean_ms"))
    return rows.join(captures, "session_id")


@query("t01_replay_order", "SELECT terminal_kind, product_id, fifo_sequence, station_id, inference_job_id, revision FROM station_terminal WHERE session_id = 's0' ORDER BY fifo_sequence, station_id, revision")
def replay(t: Tables) -> DataFrame:
    return t.station_terminal.where("session_id = 's0'").orderBy("fifo_sequence", "station_id", "revision").select("terminal_kind", "product_id", "fifo_sequence", "station_id", "inference_job_id", "revision")


@query("t02_replay_page", "SELECT session_id, product_id, station_id, revision, n, max(n) OVER (PARTITION BY session_id) > 60 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fifo_sequence, station_id, revision) AS n FROM station_terminal) x WHERE n > 20 AND n <= 61 QUALIFY n <= 60")
def replay_page(t: Tables) -> DataFrame:
    return R.page(t.station_terminal, ["session_id"], ["fifo_sequence", "station_id", "revision"], 40, 20).select("session_id", "product_id", "station_id", "revision", F.col("n").cast("bigint").alias("n"), "has_more")


@query("k10_replay_split", "SELECT terminal_kind, count(*) AS n, sum(coalesce(verdict, 0)) AS verdicts, sum(coalesce(score, 0.0)) AS scores FROM station_terminal WHERE session_id = 's0' GROUP BY terminal_kind")
def replay_split(t: Tables) -> DataFrame:
    return t.station_terminal.where("session_id = 's0'").groupBy("terminal_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("verdict", F.lit(0))).alias("verdicts"), F.sum(F.coalesce("score", F.lit(0.0))).alias("scores"))


@query("x05_replay_merge", "SELECT fifo_sequence, station_id, revision, terminal_kind FROM station_terminal WHERE session_id = 's2' AND terminal_kind = 'RESULT' UNION ALL SELECT fifo_sequence, station_id, revision, terminal_kind FROM station_terminal WHERE session_id = 's2' AND terminal_kind = 'FAILURE'")
def replay_merge(t: Tables) -> DataFrame:
    rows = t.station_terminal.where("session_id = 's2'").select("fifo_sequence", "station_id", "revision", "terminal_kind")
    return rows.where("terminal_kind = 'RESULT'").unionByName(rows.where("terminal_kind = 'FAILURE'"))


@query("t04_retention", "SELECT artifact_order, file_path FROM image_artifact QUALIFY row_number() OVER (ORDER BY artifact_order DESC) > 300")
def retention(t: Tables) -> DataFrame:
    return R.beyond_latest(t.image_artifact, 300).select("artifact_order", "file_path")


@query("w08_first_and_last_arrival", "SELECT product_id, min(artifact_order) AS first_order, arg_min(file_path, artifact_order) AS first_path, arg_max(file_path, artifact_order) AS last_path FROM image_artifact GROUP BY product_id")
def arrivals(t: Tables) -> DataFrame:
    return t.image_artifact.groupBy("product_id").agg(F.min("artifact_order").alias("first_order"), F.min_by("file_path", "artifact_order").alias("first_path"), F.max_by("file_path", "artifact_order").alias("last_path"))


@query("f22_disk_thresholds", "SELECT sample_no, session_id, CASE WHEN used_ratio >= 0.95 THEN 'STOP' WHEN used_ratio >= 0.90 THEN 'WARN' ELSE 'OK' END AS level, used_ratio >= 0.90 AND coalesce(lag(used_ratio) OVER (PARTITION BY session_id ORDER BY sample_no), 0) < 0.90 AS warns FROM disk_sample")
def disk(t: Tables) -> DataFrame:
    r = F.col("used_ratio")
    before = F.lag(r).over(W.partitionBy("session_id").orderBy("sample_no"))
    return t.disk_sample.select("sample_no", "session_id", F.when(r >= 0.95, "STOP").when(r >= 0.90, "WARN").otherwise("OK").alias("level"), ((r >= 0.90) & (F.coalesce(before, F.lit(0)) < 0.90)).alias("warns"))


@query("u01_dedup_spool", "SELECT log_id, revision, payload_digest FROM spool QUALIFY row_number() OVER (PARTITION BY log_id, revision ORDER BY created_at) = 1")
def dedup(t: Tables) -> DataFrame:
    return E.first_wins(t.spool, ["log_id", "revision"], ["created_at"]).select("log_id", "revision", "payload_digest")
