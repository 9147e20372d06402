"""Queries of the anomaly analytics and the remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions.numbers import finite, top_k_count
from ..operators import anomaly as A
from ..operators import coreset, grids
from ..sources.stored import stored
from ..operators.supervision import key_set_differences
from ..sources.tables import Tables
from .registry import query

PATCHES = "patches AS (SELECT vec_id, vec_id % 5 AS split, CAST(floor((i - 1) / 16) AS INT) AS view, CAST((i - 1) % 16 AS INT) AS patch, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i))"
MOMENTS = "moments AS (SELECT view, patch, avg(value) AS center, stddev_samp(value) AS scale FROM patches WHERE split = 0 GROUP BY view, patch)"
REFS = "refs AS (SELECT view, median(CASE WHEN scale > 0 THEN scale END) AS reference, avg(scale * scale) AS global_variance FROM moments GROUP BY view)"
DIST = "sqrt(list_sum(list_transform(list_zip(q.embedding, b.bank_vec), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last places."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


NEAR = f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bank_id) AS r FROM (SELECT q.vec_id, b.bank_id, {DIST} AS d FROM embeddings q, (SELECT vec_id AS bank_id, embedding AS bank_vec FROM embeddings) b WHERE b.bank_id <> q.vec_id) x) y WHERE r <= 5)"


@query("j08_nearest_bank_vector", f"WITH {NEAR} SELECT vec_id, round(d, 6) AS distance, bank_id FROM near WHERE r = 1")
def nearest(t: Tables) -> DataFrame:
    """Every vector against all others."""
    return rounded(A.nearest_others(t.embeddings, 1)).select("vec_id", "distance", "bank_id")


@query("t08_nearest_k", f"WITH {NEAR} SELECT vec_id, bank_id, round(d, 6) AS distance, CAST(r AS INT) AS rank FROM near")
def nearest_k(t: Tables) -> DataFrame:
    return rounded(A.nearest_others(t.embeddings, 5)).select("vec_id", "bank_id", "distance", "rank")


@query("m03_reweighted_score", f"WITH {NEAR} SELECT vec_id, round((1 - exp(ds[1] - ds[5]) / list_sum(list_transform(ds, lambda z: exp(z - ds[5])))) * ds[1], 6) AS score FROM (SELECT vec_id, list(d ORDER BY d) AS ds FROM near GROUP BY vec_id) z")
def image_score(t: Tables) -> DataFrame:
    return rounded(A.reweighted(A.nearest_others(t.embeddings, 5)))


@query("a14_position_moments", f"WITH {PATCHES}, {MOMENTS} SELECT view, patch, round(center, 6) AS center, round(scale, 6) AS scale FROM moments")
def moments(t: Tables) -> DataFrame:
    return rounded(A.moments(A.patches(t.embeddings).where("split = 0")))


MEDIANS = "mc AS (SELECT view, patch, median(value) AS center FROM patches WHERE split = 0 GROUP BY view, patch), mads AS (SELECT p.view, p.patch, any_value(mc.center) AS center, 1.4826 * median(abs(p.value - mc.center)) AS scale FROM patches p JOIN mc ON mc.view = p.view AND mc.patch = p.patch WHERE p.split = 0 GROUP BY p.view, p.patch)"


@query("a15_position_medians", f"WITH {PATCHES}, {MEDIANS} SELECT view, patch, round(center, 6) AS center, round(scale, 6) AS scale FROM mads")
def medians(t: Tables) -> DataFrame:
    return rounded(A.medians(A.patches(t.embeddings).where("split = 0")))


@query("a16_scale_references", f"WITH {PATCHES}, {MOMENTS}, {REFS} SELECT view, round(reference, 6) AS reference, round(global_variance, 6) AS global_variance FROM refs")
def references(t: Tables) -> DataFrame:
    return rounded(A.references(A.moments(A.patches(t.embeddings).where("split = 0"))))


OPTIONS = "options(method, option) AS (VALUES " + ", ".join(f"('{m}', {v})" for m, v in A.normalizations()) + ")"
DENOMINATOR = "CASE WHEN o.method IN ('epsilon', 'mad') THEN s.scale + o.option * r.reference WHEN o.method = 'std_floor' THEN greatest(s.scale, o.option * r.reference) ELSE sqrt((1 - o.option) * s.scale * s.scale + o.option * r.global_variance) + greatest(1e-12, r.reference * 1e-6) END"
CALIBRATION = f"{PATCHES}, {MOMENTS}, {REFS}, {MEDIANS}, mrefs AS (SELECT view, median(CASE WHEN scale > 0 THEN scale END) AS reference, avg(scale * scale) AS global_variance FROM mads GROUP BY view), {OPTIONS}, calibration AS (SELECT o.method, CAST(o.option AS DOUBLE) AS option, s.view, s.patch, s.center, {DENOMINATOR} AS denominator FROM moments s JOIN refs r ON r.view = s.view, options o WHERE o.method <> 'mad' UNION ALL SELECT o.method, CAST(o.option AS DOUBLE), s.view, s.patch, s.center, {DENOMINATOR} FROM mads s JOIN mrefs r ON r.view = s.view, options o WHERE o.method = 'mad')"


@query("m04_build_calibration", f"WITH {CALIBRATION} SELECT method, option, view, patch, round(center, 6) AS center, round(denominator, 6) AS denominator FROM calibration")
def calibration(t: Tables) -> DataFrame:
    return rounded(A.calibration(A.patches(t.embeddings).where("split = 0")))


@query("j06_normalized_patches", f"WITH {CALIBRATION} SELECT p.vec_id, p.view, round(max((p.value - c.center) / c.denominator), 6) AS z_max, round(avg((p.value - c.center) / c.denominator), 6) AS z_mean FROM patches p JOIN calibration c ON c.view = p.view AND c.patch = p.patch WHERE c.method = 'std_floor' AND c.option = 0.1 AND p.split = 1 GROUP BY p.vec_id, p.view")
def normalized(t: Tables) -> DataFrame:
    rows = A.patches(t.embeddings)
    z = A.normalized(rows.where("split = 1"), A.calibration(rows.where("split = 0"), [("std_floor", 0.1)]))
    return rounded(z.groupBy("vec_id", "view").agg(F.max("z").alias("z_max"), F.avg("z").alias("z_mean")))


def _scores(method: str, option: float, kinds: str) -> str:
    return f"WITH {CALIBRATION}, z AS (SELECT p.vec_id, p.split, p.view, (p.value - c.center) / c.denominator AS z FROM patches p JOIN calibration c ON c.view = p.view AND c.patch = p.patch WHERE c.method = '{method}' AND c.option = {option}), scores AS (SELECT vec_id, split, view, {kinds} AS score FROM z GROUP BY vec_id, split, view)"


CHOSEN = _scores("std_floor", 0.1, "quantile_cont(z, 0.995)")


def chosen_scores(t: Tables) -> DataFrame:
    rows = A.patches(t.embeddings)
    z = A.normalized(rows, A.calibration(rows.where("split = 0"), [("std_floor", 0.1)]))
    return A.view_scores(z, [("percentile", 99.5)]).select("vec_id", "split", "view", "score")


@query("a18_map_percentile", f"{CHOSEN} SELECT vec_id, view, round(score, 6) AS score FROM scores")
def map_percentile(t: Tables) -> DataFrame:
    return rounded(chosen_scores(t).select("vec_id", "view", "score"))


@query("a19_top_k_mean", _scores("epsilon", 0.01, "list_avg(list_slice(list_reverse_sort(list(z)), 1, CAST(greatest(1, ceil(count(*) * 20.0 / 100.0)) AS INT)))") + " SELECT vec_id, view, round(score, 6) AS score FROM scores")
def top_k(t: Tables) -> DataFrame:
    rows = A.patches(t.embeddings)
    z = A.normalized(rows, A.calibration(rows.where("split = 0"), [("epsilon", 0.01)]))
    return rounded(A.view_scores(z, [("top_k_percent_average", 20.0)]).select("vec_id", "view", "score"))


THRESHOLDS = """, grid AS (SELECT 90.0 + i * 0.01 AS percentile, i FROM range(0, 1001) r(i)), tables AS (SELECT s.view, list(quantile) AS t FROM (SELECT view, unnest(quantile_cont(score, [""" + ", ".join(f"{(90.0 + i * 0.01) / 100:.8f}" for i in range(1001)) + """])) AS quantile FROM scores WHERE split = 1 GROUP BY view) s GROUP BY s.view),
exceeds AS (SELECT g.i, s.vec_id, bool_or(s.score > x.t[g.i + 1]) AS ng FROM (SELECT * FROM scores WHERE split = 1) s JOIN tables x ON x.view = s.view, grid g GROUP BY g.i, s.vec_id),
rates AS (SELECT i, avg(CASE WHEN ng THEN 1.0 ELSE 0.0 END) AS fpr FROM exceeds GROUP BY i), safe AS (SELECT g.i FROM grid g, tables x GROUP BY g.i HAVING min(x.t[g.i + 1]) > 0),
pick AS (SELECT min(r.i) AS i FROM rates r JOIN safe USING (i) WHERE r.fpr <= 0.1)"""


@query("m06_threshold_search", f"{CHOSEN}{THRESHOLDS} SELECT x.view, round(90.0 + p.i * 0.01, 4) AS percentile, round(r.fpr, 6) AS fpr, round(x.t[p.i + 1], 6) AS threshold FROM pick p JOIN rates r ON r.i = p.i, tables x")
def thresholds(t: Tables) -> DataFrame:
    found = A.search_thresholds(stored(chosen_scores(t).where("split = 1").withColumn("k", F.lit(1))), 0.1, ["k"])
    return rounded(found.withColumn("percentile", F.round("percentile", 4)).select("view", "percentile", "fpr", "threshold"))


@query("m09_final_evaluation", f"{CHOSEN}{THRESHOLDS}, pred AS (SELECT s.vec_id, s.split, bool_or(s.score > x.t[p.i + 1]) AS ng FROM scores s JOIN tables x ON x.view = s.view, pick p WHERE s.split IN (2, 3) GROUP BY s.vec_id, s.split) SELECT count(*) FILTER (WHERE split = 2 AND NOT ng) AS tn, count(*) FILTER (WHERE split = 2 AND ng) AS fp, count(*) FILTER (WHERE split = 3 AND NOT ng) AS fn, count(*) FILTER (WHERE split = 3 AND ng) AS tp FROM pred")
def evaluation(t: Tables) -> DataFrame:
    scores = stored(chosen_scores(t).withColumn("k", F.lit(1)))
    found = A.search_thresholds(scores.where("split = 1"), 0.1, ["k"])
    rows = A.predictions(scores.where("split IN (2, 3)"), found, ["k"]).withColumn("truth", (F.col("split") == 3).cast("int"))
    return A.metrics(rows, ["k"]).select("tn", "fp", "fn", "tp")


@query("m07_candidate_grid", f"WITH {CALIBRATION}, fit AS (SELECT method, option FROM calibration GROUP BY method, option HAVING min(denominator) > 0) SELECT method, count(*) * {len(A.aggregations())} AS candidates FROM fit GROUP BY method")
def grid(t: Tables) -> DataFrame:
    """Candidates of each normalization whose denominators are positive everywhere, under every aggregation."""
    calibrated = A.calibration(A.patches(t.embeddings).where("split = 0")).groupBy("method", "option").agg(F.min("denominator").alias("least"))
    return calibrated.where("least > 0").groupBy("method").agg((F.count(F.lit(1)) * len(A.aggregations())).alias("candidates"))


def measured(t: Tables) -> DataFrame:
    """All candidates in one plan: every normalization and aggregation over the same gathered maps. Split 0 calibrates, 1 gives the thresholds, 2 is normal, 3 and 4 are anomalies.

    No table holds latencies of candidates, so none are among the keys of the selection."""
    rows = A.patches(t.embeddings)
    keys = ["method", "option", "kind", "level"]
    scores = stored(A.view_scores(A.normalized(rows.where("split > 0"), A.calibration(rows.where("split = 0")))))
    found = A.search_thresholds(scores.where("split = 1"), 0.1, keys)
    pred = A.predictions(scores.where("split > 1"), found, keys).withColumn("truth", (F.col("split") > 2).cast("int"))
    names = F.create_map(*[F.lit(x) for pair in A.COMPLEXITY.items() for x in pair])
    out = A.metrics(pred, keys).withColumn("complexity", F.element_at(names, F.col("method")))
    return out.withColumn("candidate_id", F.concat_ws("/", "method", F.col("option").cast("string"), "kind", F.col("level").cast("string")))


PERCENTILES = ", ".join(f"{{'kind': 'percentile', 'level': {p}, 'score': quantile_cont(z, {p / 100:.10f})}}" for p in A.MAP_PERCENTILES)
SHARES = ", ".join(f"{{'kind': 'top_k_percent_average', 'level': {p}, 'score': list_avg(list_slice(list_reverse_sort(list(z)), 1, CAST(greatest(1, ceil(count(*) * {p} / 100.0)) AS INT)))}}" for p in A.TOP_K_PERCENTS)
#: Thresholds as lists, and of every product how many of them it exceeds in its worst view: those are the first ones, since they rise.
CANDIDATES = f"""WITH {CALIBRATION}, z AS (SELECT c.method, c.option, p.vec_id, p.split, p.view, (p.value - c.center) / c.denominator AS z FROM patches p JOIN calibration c ON c.view = p.view AND c.patch = p.patch WHERE p.split > 0),
gathered AS (SELECT method, option, vec_id, split, view, [{PERCENTILES}, {SHARES}] AS listed FROM z GROUP BY method, option, vec_id, split, view),
scores AS (SELECT method, option, CAST(s.kind AS VARCHAR) AS kind, CAST(s.level AS DOUBLE) AS level, vec_id, split, view, CAST(s.score AS DOUBLE) AS score FROM (SELECT method, option, vec_id, split, view, unnest(listed) AS s FROM gathered) g),
tables AS (SELECT method, option, kind, level, view, quantile_cont(score, [{", ".join(f"{(90.0 + i * 0.01) / 100:.8f}" for i in range(1001))}]) AS t FROM scores WHERE split = 1 GROUP BY ALL),
worst AS (SELECT s.method, s.option, s.kind, s.level, s.vec_id, max(len(list_filter(x.t, lambda v: v < s.score))) AS e FROM scores s JOIN tables x USING (method, option, kind, level, view) WHERE s.split = 1 GROUP BY ALL),
unsafe AS (SELECT method, option, kind, level, max(len(list_filter(t, lambda v: v <= 0))) AS u, count(*) AS views FROM tables GROUP BY ALL),
pick AS (SELECT method, option, kind, level, greatest(coalesce(list_reverse_sort(list(e))[CAST(floor(count(*) / 10.0 + 1e-9) AS INT) + 1], 0), any_value(u)) AS i FROM worst JOIN unsafe USING (method, option, kind, level) GROUP BY ALL HAVING any_value(views) = 4 AND count(*) >= 100),
pred AS (SELECT s.method, s.option, s.kind, s.level, s.vec_id, s.split > 2 AS truth, bool_or(s.score > x.t[p.i + 1]) AS ng FROM scores s JOIN tables x USING (method, option, kind, level, view) JOIN pick p USING (method, option, kind, level) WHERE s.split > 1 AND p.i <= 1000 GROUP BY ALL),
measured AS (SELECT method || '/' || CASE WHEN option < 0.001 THEN CAST(CAST(option * 10000 AS INT) AS VARCHAR) || '.0E-4' ELSE CAST(option AS VARCHAR) END || '/' || kind || '/' || CAST(level AS VARCHAR) AS candidate_id,
  count(*) FILTER (WHERE NOT truth AND NOT ng) AS tn, count(*) FILTER (WHERE NOT truth AND ng) AS fp, count(*) FILTER (WHERE truth AND NOT ng) AS fn, count(*) FILTER (WHERE truth AND ng) AS tp, CASE method WHEN 'std_floor' THEN 0 WHEN 'epsilon' THEN 1 WHEN 'shrinkage' THEN 2 ELSE 3 END AS complexity FROM pred GROUP BY method, option, kind, level)"""


@query("m08_candidate_metrics", f"{CANDIDATES} SELECT * FROM measured")
def candidates(t: Tables) -> DataFrame:
    return measured(t).select("candidate_id", "tn", "fp", "fn", "tp", "complexity")


@query("t06_candidate_selection", f"{CANDIDATES} SELECT candidate_id, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, complexity FROM measured ORDER BY recall DESC, fpr, complexity, candidate_id LIMIT 1")
def selection(t: Tables) -> DataFrame:
    return rounded(A.best_candidate(measured(t)).select("candidate_id", "recall", "fpr", "complexity"))


METRICS = "SELECT tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(fp / (fp + tn), 6) AS fpr, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM (SELECT count(*) FILTER (WHERE truth = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE truth = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE truth = 1 AND predicted = 1) AS tp FROM prediction) c"


@query("a10_classification_metrics", METRICS)
def metrics(t: Tables) -> DataFrame:
    return rounded(A.metrics(t.prediction.withColumn("k", F.lit(1)), ["k"]).drop("k"))


@query("x04_label_concatenation", "SELECT truth, predicted, count(*) AS n FROM (SELECT 0 AS truth, predicted FROM prediction WHERE truth = 0 UNION ALL SELECT 1 AS truth, predicted FROM prediction WHERE truth = 1) x GROUP BY truth, predicted")
def labels(t: Tables) -> DataFrame:
    side = lambda n: t.prediction.where(F.col("truth") == n).select(F.lit(n).alias("truth"), "predicted")
    return side(0).unionByName(side(1)).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("k11_evaluation_outcomes", "SELECT doc_id, CASE WHEN truth = 0 AND predicted = 0 THEN 'TN' WHEN truth = 0 THEN 'FP' WHEN predicted = 0 THEN 'FN' ELSE 'TP' END AS outcome FROM prediction")
def outcomes(t: Tables) -> DataFrame:
    p, q = F.col("truth"), F.col("predicted")
    return t.prediction.select("doc_id", F.when((p == 0) & (q == 0), "TN").when(p == 0, "FP").when(q == 0, "FN").otherwise("TP").alias("outcome"))


@query("k14_misclassified", "SELECT doc_id, truth, predicted FROM prediction WHERE truth <> predicted")
def misclassified(t: Tables) -> DataFrame:
    return t.prediction.where("truth <> predicted")


@query("a08_timing_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def timings(t: Tables) -> DataFrame:
    return rounded(A.timing_summary(t.events, ["event_type"], "value"))


@query("a13_score_histogram", "SELECT e.event_type, CAST(CASE WHEN high = low THEN 0 ELSE least(floor((value - low) / ((high - low) / bins)), bins - 1) END AS INT) AS bin, count(*) AS n FROM events e, (SELECT min(value) AS low, max(value) AS high, greatest(10, least(80, 2 * floor(sqrt(count(*))))) AS bins FROM events) b GROUP BY 1, 2")
def histogram(t: Tables) -> DataFrame:
    return A.histogram(t.events, "event_type", "value")


@query("a21_percentile_threshold", "SELECT event_type, round(quantile_cont(value, 0.98), 6) AS threshold, quantile_cont(value, 0.98) > 1e-6 AS usable FROM events GROUP BY event_type")
def threshold(t: Tables) -> DataFrame:
    q = F.percentile("value", 0.98)
    return rounded(t.events.groupBy("event_type").agg(q.alias("threshold"), (q > 1e-6).alias("usable")))


@query("a22_throughput", "SELECT event_type, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY event_type")
def throughput(t: Tables) -> DataFrame:
    return rounded(t.events.groupBy("event_type").agg((F.lit(1000) / F.avg("value")).alias("per_second")))


@query("a07_frame_skew", "SELECT user_id, CASE WHEN count(*) < 2 THEN 0 ELSE (max(event_id) - min(event_id)) // 1000 END AS skew, count(*) >= 2 AND (max(event_id) - min(event_id)) // 1000 > 9 AS exceeded FROM events GROUP BY user_id")
def skew(t: Tables) -> DataFrame:
    span = F.when(F.count(F.lit(1)) < 2, 0).otherwise(F.floor((F.max("event_id") - F.min("event_id")) / 1000))
    return t.events.groupBy("user_id").agg(span.cast("bigint").alias("skew")).withColumn("exceeded", F.col("skew") > 9)


@query("f16_finite_or_null", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def finite_values(t: Tables) -> DataFrame:
    odd = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))
    return t.events.select("event_id", finite(odd).alias("value"))


@query("f17_ng_predicate", "SELECT event_id, value > 50 AS ng, round(value / 50, 6) AS score, value / 50 >= 1 - 0.05 AS ng_with_margin FROM events")
def ng(t: Tables) -> DataFrame:
    v = F.col("value")
    return rounded(t.events.select("event_id", (v > 50).alias("ng"), (v / 50).alias("score"), (v / 50 >= 1 - 0.05).alias("ng_with_margin")))


@query("f18_margin_predicate", "SELECT event_id, CASE WHEN threshold <= 0.000001 THEN 'threshold' END AS error, CASE WHEN threshold > 0.000001 THEN raw / threshold >= 1.0 - margin END AS ng FROM raw_score")
def margin(t: Tables) -> DataFrame:
    """A score at its boundary counts as NG; a threshold that is no more than the epsilon is an error."""
    fine = F.col("threshold") > 0.000001
    return t.raw_score.select("event_id", F.when(~fine, "threshold").alias("error"), F.when(fine, F.col("raw") / F.when(fine, F.col("threshold")) >= 1.0 - F.col("margin")).alias("ng"))


@query("s09_png_index", """WITH p AS (SELECT split, view, filename FROM image_file WHERE lower(filename) LIKE '%.png'), c AS (SELECT split, view, lower(filename) AS folded, count(DISTINCT filename) AS names FROM p GROUP BY ALL)
SELECT *, CASE WHEN files = 0 THEN 'empty' WHEN collision IS NOT NULL THEN 'collision' END AS error FROM (
  SELECT f.split, f.view, (SELECT count(DISTINCT filename) FROM p WHERE p.split = f.split AND p.view = f.view) AS files, (SELECT min(folded) FROM c WHERE c.split = f.split AND c.view = f.view AND names > 1) AS collision
  FROM (SELECT DISTINCT split, view FROM image_file) f) g""")
def png_index(t: Tables) -> DataFrame:
    """Folders by their PNG files, whatever the suffix's case: none, or names that differ in their case alone, are errors."""
    name = F.when(F.lower("filename").endswith(".png"), F.col("filename"))
    folded = t.image_file.groupBy("split", "view", F.lower(name).alias("folded")).agg(F.count_distinct(name).alias("names"))
    found = folded.groupBy("split", "view").agg(F.sum("names").alias("files"), F.min(F.when(F.col("names") > 1, F.col("folded"))).alias("collision"))
    return found.withColumn("error", F.when(F.col("files") == 0, "empty").when(F.col("collision").isNotNull(), "collision"))


@query("a11_or_over_views", "SELECT user_id, bool_or(value > 99) AS ng, round(max(value / 50), 6) AS station_score FROM events GROUP BY user_id")
def any_view(t: Tables) -> DataFrame:
    return rounded(t.events.groupBy("user_id").agg(F.bool_or(F.col("value") > 99).alias("ng"), F.max(F.col("value") / 50).alias("station_score")))


@query("m11_decision_time", "SELECT user_id, coalesce(min(CASE WHEN value > 90 THEN event_id END), sum(event_id)) AS decision_ms FROM events GROUP BY user_id")
def decision_time(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("value") > 90, F.col("event_id"))), F.sum("event_id")).alias("decision_ms"))


@query("m12_station_grouping", "SELECT CASE WHEN view LIKE 'CAM_A%' THEN 'A' ELSE 'B' END AS station, count(DISTINCT view) AS views, count(*) AS files FROM dataset_file GROUP BY 1")
def stations(t: Tables) -> DataFrame:
    return t.dataset_file.groupBy(F.when(F.col("view").startswith("CAM_A"), "A").otherwise("B").alias("station")).agg(F.count_distinct("view").alias("views"), F.count(F.lit(1)).alias("files"))


@query("c23_top_k_counts", "SELECT event_id, CAST(greatest(1, ceil((event_id % 900 + 1) * (event_id % 40 + 1) / 100.0)) AS BIGINT) AS k FROM events")
def k_counts(t: Tables) -> DataFrame:
    return t.events.select("event_id", top_k_count(F.col("event_id") % 900 + 1, F.col("event_id") % 40 + 1).cast("bigint").alias("k"))


@query("k15_exceeding_locations", f"WITH {PATCHES} SELECT vec_id, view, arg_max(patch, value) AS peak, min(patch) FILTER (WHERE value > 1) AS first_patch, max(patch) FILTER (WHERE value > 1) AS last_patch, round(avg(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM patches GROUP BY vec_id, view")
def locations(t: Tables) -> DataFrame:
    over = F.col("value") > 1
    rows = A.patches(t.embeddings).groupBy("vec_id", "view").agg(F.max_by("patch", "value").alias("peak"), F.min(F.when(over, F.col("patch"))).alias("first_patch"), F.max(F.when(over, F.col("patch"))).alias("last_patch"), F.avg(over.cast("int")).alias("share"))
    return rounded(rows)


@query("s09_image_index", "SELECT split, view, count(*) AS files, count(DISTINCT lower(filename)) AS names FROM dataset_file WHERE lower(filename) LIKE '%.png' GROUP BY split, view")
def image_index(t: Tables) -> DataFrame:
    return t.dataset_file.where(F.lower("filename").endswith(".png")).groupBy("split", "view").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(F.lower("filename")).alias("names"))


@query("j07_view_set_equality", "SELECT split, filename FROM dataset_file GROUP BY split, filename HAVING count(DISTINCT view) <> 4")
def view_sets(t: Tables) -> DataFrame:
    return t.dataset_file.groupBy("split", "filename").agg(F.count_distinct("view").alias("n")).where("n <> 4").select("split", "filename")


@query("x01_missing_files", "(SELECT filename, 'missing' AS side FROM dataset_file WHERE view = 'CAM_A_1' EXCEPT SELECT filename, 'missing' FROM dataset_file WHERE view = 'CAM_A_3') UNION ALL (SELECT filename, 'extra' FROM dataset_file WHERE view = 'CAM_A_3' EXCEPT SELECT filename, 'extra' FROM dataset_file WHERE view = 'CAM_A_1')")
def missing_files(t: Tables) -> DataFrame:
    """Files that one of two views lacks, both ways."""
    side = lambda v: t.dataset_file.where(F.col("view") == v).select(F.col("filename").alias("key"))
    return key_set_differences(side("CAM_A_1"), side("CAM_A_3")).select(F.col("key").alias("filename"), "side")


@query("a23_dataset_provenance", """WITH chunks AS (SELECT split, substr(sha256(filename), 1, 3) AS chunk, sha256(string_agg(view || '/' || filename || chr(10), '' ORDER BY filename, view)) AS digest FROM dataset_file GROUP BY ALL)
SELECT f.split, f.products, f.files, c.digest FROM (SELECT split, count(DISTINCT vec_id) AS products, count(*) AS files FROM dataset_file GROUP BY split) f
JOIN (SELECT split, sha256(string_agg(chunk || ' ' || digest || chr(10), '' ORDER BY chunk)) AS digest FROM chunks GROUP BY split) c ON c.split = f.split""")
def provenance(t: Tables) -> DataFrame:
    counted = t.dataset_file.groupBy("split").agg(F.count_distinct("vec_id").alias("products"), F.count(F.lit(1)).alias("files"))
    return counted.join(A.ordered_digest(t.dataset_file, ["split"], "filename", ["filename", "view"], F.concat_ws("/", "view", "filename")), "split")


@query("c26_largest_component", """WITH RECURSIVE cells AS (SELECT vec_id, v.view, p.patch, p.patch % 4 AS x, p.patch // 4 AS y FROM embeddings, range(4) v(view), range(16) p(patch) WHERE embedding[v.view * 16 + p.patch + 1] >= 0.02),
reach AS (SELECT vec_id, view, patch AS start, patch, x, y FROM cells UNION SELECT r.vec_id, r.view, r.start, c.patch, c.x, c.y FROM reach r JOIN cells c ON c.vec_id = r.vec_id AND c.view = r.view AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1),
labels AS (SELECT vec_id, view, patch, x, y, min(start) AS label FROM reach GROUP BY ALL), sizes AS (SELECT vec_id, view, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM labels GROUP BY ALL),
best AS (SELECT *, count(*) OVER (PARTITION BY vec_id, view) AS components, row_number() OVER (PARTITION BY vec_id, view ORDER BY area DESC, label) AS r FROM sizes)
SELECT e.vec_id, CAST(v.view AS INT) AS view, CAST(coalesce(components, 0) AS INT) AS components, CAST(coalesce(area, 0) AS INT) AS area, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(width AS INT) AS width, CAST(height AS INT) AS height
FROM embeddings e CROSS JOIN range(4) v(view) LEFT JOIN best b ON b.vec_id = e.vec_id AND b.view = v.view AND b.r = 1""")
def largest_component(t: Tables) -> DataFrame:
    """Foreground of the 4 x 4 patch map of every vector and view: how many parts, and area and box of the largest."""
    views = t.embeddings.select("vec_id", F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.slice("embedding", v * A.PATCHES + 1, A.PATCHES).alias("map")) for v in range(A.VIEWS)))).alias("m")).select("vec_id", "m.view", "m.map")
    grid = grids.bits(F.col("map"), A.PATCHES, lambda x: x >= 0.02)
    return views.select("vec_id", "view", grids.largest_component(grid, 4, 4).alias("c")).select("vec_id", "view", "c.*")


#: Vectors of the registered memory bank.
BANK_SIZE = 48


@query("m14_memory_bank", f"""WITH RECURSIVE points AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
greedy AS (SELECT 1 AS k, vec_id, v, CAST('infinity' AS DOUBLE) AS far, CAST(-1 AS BIGINT) AS center, first_value(vec_id) OVER (ORDER BY vec_id) AS pick, first_value(v) OVER (ORDER BY vec_id) AS pick_v FROM points
  UNION ALL SELECT k, vec_id, v, far, center, first_value(vec_id) OVER w AS pick, first_value(v) OVER w AS pick_v FROM (SELECT k + 1 AS k, vec_id, v, CASE WHEN vec_id = pick THEN -1 ELSE least(far, list_sum(list_transform(list_zip(v, pick_v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END AS far,
      CASE WHEN list_sum(list_transform(list_zip(v, pick_v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) < far THEN pick ELSE center END AS center FROM greedy WHERE k <= {BANK_SIZE}) g WINDOW w AS (ORDER BY far DESC, vec_id))
SELECT CAST(p.k AS INT) AS rank, p.pick AS vec_id, m.members, round(m.radius, 6) AS radius FROM (SELECT DISTINCT k, pick FROM greedy WHERE k <= {BANK_SIZE}) p JOIN (SELECT center, count(*) AS members, sqrt(greatest(max(far), 0)) AS radius FROM greedy WHERE k = {BANK_SIZE + 1} GROUP BY center) m ON m.center = p.pick""")
def memory_bank(t: Tables) -> DataFrame:
    """The bank that greedy chooses from all vectors, with what lies nearest to each of its members."""
    return rounded(coreset.memory_bank(t.embeddings, BANK_SIZE))


@query("t10_sorted_products", "SELECT DISTINCT filename FROM dataset_file WHERE split = 'test' ORDER BY filename")
def sorted_products(t: Tables) -> DataFrame:
    return t.dataset_file.where("split = 'test'").select("filename").distinct().orderBy("filename")


EXPECTED = ["SN0", "SN1", "SN2", "SN3"]


@query("f20_camera_inventory", "SELECT inventory, list_sort(list_distinct(list_filter(['SN0', 'SN1', 'SN2', 'SN3'], lambda x: NOT list_contains(list(serial), x)))) AS missing, count(DISTINCT serial) FILTER (WHERE serial NOT IN ('SN0', 'SN1', 'SN2', 'SN3')) AS unexpected, bool_and(model = 'MV-1') AS model_ok, count(DISTINCT firmware) = 1 AS one_firmware FROM camera_entry GROUP BY inventory")
def inventory(t: Tables) -> DataFrame:
    expected = F.array(*[F.lit(x) for x in EXPECTED])
    rows = t.camera_entry.groupBy("inventory").agg(F.collect_set("serial").alias("s"), F.bool_and(F.col("model") == "MV-1").alias("model_ok"), (F.count_distinct("firmware") == 1).alias("one_firmware"))
    return rows.select("inventory", F.array_sort(F.array_except(expected, "s")).alias("missing"), F.size(F.array_except("s", expected)).cast("bigint").alias("unexpected"), "model_ok", "one_firmware")


@query("j12_required_cameras", "SELECT inventory, count(DISTINCT serial) FILTER (WHERE serial IN ('SN0', 'SN1', 'SN2', 'SN3')) = 4 AND count(DISTINCT serial) = 4 AS complete FROM camera_entry GROUP BY inventory")
def required(t: Tables) -> DataFrame:
    expected = F.array(*[F.lit(x) for x in EXPECTED])
    rows = t.camera_entry.groupBy("inventory").agg(F.collect_set("serial").alias("s"))
    return rows.select("inventory", ((F.size(F.array_except(expected, "s")) == 0) & (F.size(F.array_except("s", expected)) == 0)).alias("complete"))


@query("c09_product_names", "SELECT event_id, 'P-' || substr('session-' || CAST(user_id AS VARCHAR), 1, 8) || '-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS product_id, regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9_.-]+', '_', 'g') AS reason FROM events")
def names(t: Tables) -> DataFrame:
    session = F.concat(F.lit("session-"), F.col("user_id").cast("string"))
    return t.events.select("event_id", X.product_id(session, F.col("event_id")).alias("product_id"), X.safe_reason(F.concat_ws(" ", "event_type", "props")).alias("reason"))


@query("c25_library_versions", "SELECT entry_no, CASE WHEN installed = required THEN 'ok' WHEN split_part(installed, '+', 1) = split_part(required, '+', 1) THEN 'suffix' ELSE 'mismatch' END AS state FROM version_pair")
def versions(t: Tables) -> DataFrame:
    return t.version_pair.select("entry_no", X.library_check(F.col("required"), F.col("installed")).alias("state"))


#: The check value bit by bit over the bytes of a body.
CRC = "list_reduce(list_prepend(65535, list_transform(range(1, length(body) + 1), lambda p: CAST(ascii(body[p]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(CAST(c AS BIGINT), b * 256), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 32768 <> 0 THEN xor(x * 2, 4129) ELSE x * 2 END & 65535))"


@query("c07_serial_frames", f"SELECT event_id, body || '|' || printf('%04X', {CRC}) || chr(10) AS line, CAST(CASE WHEN event_id % 9 = 0 THEN 0 ELSE len(string_split(body, '|')) END AS INT) AS fields FROM serial_line")
def frames(t: Tables) -> DataFrame:
    rows = t.serial_line.select("event_id", X.encode_frame(F.col("body")).alias("line"))
    broken = F.when(F.col("event_id") % 9 == 0, F.regexp_replace("line", "SENSOR", "SENSOB")).otherwise(F.col("line"))
    return rows.select("event_id", "line", F.coalesce(F.size(X.decode_frame(broken)), F.lit(0)).alias("fields"))


@query("c01_canonical_json")
def canonical(t: Tables) -> DataFrame:
    return t.envelope.select("event_id", F.sha2(X.canonical_json("payload_json"), 256).alias("digest"))


BENCH = """bench AS (SELECT user_id AS model_no, CAST(1 + event_id % 3 AS INT) AS streams, quantile_cont(value, 0.5) AS median_ms, quantile_cont(value, 0.95) AS p95_ms, user_id % 11 <> 0 OR 1 + event_id % 3 = 1 AS memory_safe FROM events GROUP BY ALL),
wide AS (SELECT model_no, max(median_ms) FILTER (WHERE streams = 1) AS m1, max(p95_ms) FILTER (WHERE streams = 1) AS p1, max(median_ms) FILTER (WHERE streams = 2 AND memory_safe) AS m2, max(p95_ms) FILTER (WHERE streams = 2 AND memory_safe) AS p2,
  max(median_ms) FILTER (WHERE streams = 3 AND memory_safe) AS m3, max(p95_ms) FILTER (WHERE streams = 3 AND memory_safe) AS p3 FROM bench GROUP BY model_no HAVING m1 IS NOT NULL),
two AS (SELECT *, coalesce(m2 <= m1 * 0.95 AND p2 <= p1, false) AS take2 FROM wide)"""


@query("a25_parallelism_choice", f"WITH {BENCH} SELECT model_no, CAST(CASE WHEN m3 <= CASE WHEN take2 THEN m2 ELSE m1 END * 0.95 AND p3 <= CASE WHEN take2 THEN p2 ELSE p1 END THEN 3 WHEN take2 THEN 2 ELSE 1 END AS INT) AS streams FROM two")
def parallelism(t: Tables) -> DataFrame:
    streams = (1 + F.col("event_id") % 3).cast("int")
    safe = (F.col("user_id") % 11 != 0) | (streams == 1)
    rows = t.events.select(F.col("user_id").alias("model_no"), streams.alias("streams"), safe.alias("memory_safe"), "value")
    return A.parallelism_choice(A.continuous_quantiles(rows, ["model_no", "streams", "memory_safe"], "value", {"median_ms": 0.5, "p95_ms": 0.95}), "model_no")


@query("c18_enum_names", "SELECT station_id, verdict, CASE verdict WHEN 1 THEN 'PASS' WHEN 2 THEN 'NG' WHEN 3 THEN 'FORCED_NG' END AS verdict_name, count(*) AS n FROM station_terminal GROUP BY 1, 2, 3")
def enums(t: Tables) -> DataFrame:
    from ..operators.flow import VERDICTS, named

    return t.station_terminal.groupBy("station_id", "verdict", named(F.col("verdict"), VERDICTS).alias("verdict_name")).agg(F.count(F.lit(1)).alias("n"))


@query("w09_latest_artifacts_of_product", "SELECT product_id, file_path FROM image_artifact QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY artifact_order DESC) <= 2")
def latest_artifacts(t: Tables) -> DataFrame:
    r = F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("artifact_order")))
    return t.image_artifact.withColumn("r", r).where("r <= 2").select("product_id", "file_path")
