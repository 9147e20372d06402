"""Session report: latest station results, product rows, latencies, timeouts, paging, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Samples of a station that a recommendation needs, and the factor on their 99.9th percentile.
MINIMUM_SAMPLES, SAFETY_FACTOR = 100, 1.2


def latest_terminals(terminals: DataFrame) -> DataFrame:
    """The highest revision of each station of a product; a failure before a result of the same revision, then by job."""
    w = W.partitionBy("session_id", "product_id", "station_id").orderBy(F.desc("revision"), F.when(F.col("terminal_kind") == "FAILURE", 0).otherwise(1), "inference_job_id")
    return terminals.withColumn("terminal_rank", F.row_number().over(w)).where("terminal_rank = 1").drop("terminal_rank")


def product_rows(products: DataFrame, terminals: DataFrame) -> DataFrame:
    """Each product with its latest result of either station, side by side from one pass over the terminals."""
    keep = ["terminal_kind", "verdict", "error_code", "model_forward_ms", "enqueue_to_result_ms", "capture_completed_monotonic_ns", "completed_monotonic_ns"]
    latest = latest_terminals(terminals)
    at = lambda station, c: F.max(F.when(F.col("station_id") == station, F.col(c)))  # noqa: E731  one row each
    wide = latest.groupBy("session_id", "product_id").agg(*[at(n, c).alias(f"{s}_{c}") for n, s in ((1, "a"), (2, "b")) for c in keep])
    done = F.coalesce("b_completed_monotonic_ns", "a_completed_monotonic_ns")
    total = (done - F.col("a_capture_completed_monotonic_ns")) / F.lit(1_000_000.0)
    names = [f"{s}_{c}" for s in "ab" for c in keep[:5]]
    return products.join(wide, ["session_id", "product_id"], "left").select("session_id", "fifo_sequence", "product_id", "final_verdict", "reason", *names, total.alias("product_total_ms"))


def only_value(c: str) -> Column:
    """The single distinct value of a column, empty if there are several or none."""
    return F.when(F.count_distinct(c) == 1, F.max(c)).otherwise("")


def station_samples(terminals: DataFrame) -> DataFrame:
    return terminals.where((F.col("terminal_kind") == "RESULT") & F.col("enqueue_to_result_ms").isNotNull())


def station_tuning(terminals: DataFrame, minimum: int = MINIMUM_SAMPLES, factor: float = SAFETY_FACTOR) -> DataFrame:
    """Samples, nearest-rank 99.9th percentile, identity and recommended timeout of each station of a session."""
    seen = station_samples(terminals).groupBy("session_id", "station_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.expr("percentile_disc(0.999) WITHIN GROUP (ORDER BY enqueue_to_result_ms)").alias("p999_ms"),
        only_value("model_version").alias("model_version"),
        only_value("model_sha256").alias("model_sha256"),
        only_value("config_fingerprint").alias("config_fingerprint"),
    )
    eligible = (F.col("sample_count") >= minimum) & (F.col("model_version") != "") & (F.col("model_sha256") != "") & (F.col("config_fingerprint") != "")
    return seen.withColumn("eligible", eligible).withColumn("timeout_ms", F.when(F.col("eligible") & (F.col("p999_ms") != 0), F.ceil(F.col("p999_ms") * factor)))


def tuning_document(tuning: DataFrame) -> DataFrame:
    """Sessions for which both stations have a recommendation under the same model and configuration."""
    side = lambda n, s: tuning.where(F.col("station_id") == n).select("session_id", *[F.col(c).alias(f"{s}_{c}") for c in ("model_version", "model_sha256", "config_fingerprint", "timeout_ms")])
    both = side(1, "a").join(side(2, "b"), "session_id")
    same = (F.col("a_model_version") == F.col("b_model_version")) & (F.col("a_model_sha256") == F.col("b_model_sha256")) & (F.col("a_config_fingerprint") == F.col("b_config_fingerprint"))
    return both.where(same & F.col("a_timeout_ms").isNotNull() & F.col("b_timeout_ms").isNotNull()).select(
        "session_id", F.col("a_model_version").alias("model_version"), F.col("a_model_sha256").alias("model_sha256"), F.col("a_config_fingerprint").alias("config_fingerprint"), "a_timeout_ms", "b_timeout_ms"
    )


def page(rows: DataFrame, partition: list[str], order: list, limit: int, offset: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of each partition, with whether more follow."""
    n = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    peeked = rows.withColumn("n", n).where((F.col("n") > offset) & (F.col("n") <= offset + limit + 1))
    more = F.max("n").over(W.partitionBy(*partition)) > offset + limit
    return peeked.withColumn("has_more", more).where(F.col("n") <= offset + limit)


def beyond_latest(artifacts: DataFrame, keep: int) -> DataFrame:
    """All but the ``keep`` latest artifacts. The latest are bounded by ``keep``, so the cut is one value, not a total order of all rows."""
    latest = artifacts.orderBy(F.desc("artifact_order")).limit(keep)
    cut = latest.agg(F.min("artifact_order").alias("cut"), F.count(F.lit(1)).alias("kept"))
    return artifacts.join(F.broadcast(cut), (F.col("kept") == keep) & (F.col("artifact_order") < F.col("cut"))).drop("cut", "kept")  # one row


def gpu_metrics(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("util").alias("mean_util"), F.avg("vram").alias("mean_vram"), F.max("vram").alias("peak_vram"), F.max_by("total_vram", "sampled_at").alias("total_vram")
    )
