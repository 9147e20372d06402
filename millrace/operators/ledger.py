"""The station ledger: what becomes of every message of a station, and the verdict at the lock.

All of it is windows over the messages of one station of one product, so a ledger of any length sorts and spills like other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .contracts import NG
from .flow import final_verdict

STATION_A, STATION_B = 1, 2


def station_outcomes(messages: DataFrame) -> DataFrame:
    """``messages`` with ``outcome``: APPLIED, IGNORED, CONFLICT, IDENTITY or LATE; lock rows have none.

    ``messages`` holds product_id, station_id, arrival, kind (RESULT, FAILURE, CONTRACT, LOCK), revision, verdict, and the identities
    capture_id, expected_capture, frame_batch_id, inference_job_id; the latter two have names, as the message gate sees to. ``expected_capture``
    is the capture that the station was given, the same for all its messages.

    The first message with the station's capture fixes frame batch and job. From then on other identities are refused. A result counts if its
    revision is above all before it. Station A's NG is final: another verdict after it is a conflict.
    """
    station = W.partitionBy("product_id", "station_id").orderBy("arrival")
    before = station.rowsBetween(W.unboundedPreceding, -1)
    own = F.struct("frame_batch_id", "inference_job_id")
    named = F.col("kind").isin("RESULT", "FAILURE")
    rows = (
        messages.withColumn("__lock", F.min(F.when(F.col("kind") == "LOCK", F.col("arrival"))).over(W.partitionBy("product_id")))
        .withColumn("__open", F.col("__lock").isNull() | (F.col("arrival") < F.col("__lock")))
        .withColumn("__placed", named & (F.col("capture_id") == F.col("expected_capture")))
        .withColumn("__owner", F.first(F.when(F.col("__placed") & F.col("__open"), own), ignorenulls=True).over(before))
        .withColumn("__fits", F.col("__placed") & F.coalesce(F.col("__owner") == own, F.lit(True)))
        .withColumn("__result", F.when(F.col("__fits") & F.col("__open") & (F.col("kind") == "RESULT"), F.struct("revision", (-F.col("arrival")).alias("turn"), "verdict")))
        .withColumn("__failed", F.when(F.col("__fits") & F.col("__open") & (F.col("kind") == "FAILURE"), F.col("revision")))
        .withColumn("__held", F.max("__result").over(before))  # of the highest revision the first that came
        .withColumn("__held_failure", F.max("__failed").over(before))
        .withColumn("__rises", F.col("__result").isNotNull() & F.coalesce(F.col("revision") > F.col("__held.revision"), F.lit(True)))
        .withColumn("__final", F.coalesce(F.max(F.col("__rises") & (F.col("verdict") == NG) & (F.col("station_id") == STATION_A)).over(before), F.lit(False)))
    )
    open_ = F.col("__open")
    outcome = (
        F.when(F.col("kind") == "LOCK", F.lit(None).cast("string"))
        .when(named & ~F.col("__fits"), "IDENTITY")
        .when(~open_, "LATE")
        .when(F.col("kind") == "CONTRACT", "APPLIED")
        .when(F.col("kind") == "FAILURE", F.when(F.coalesce(F.col("revision") > F.col("__held_failure"), F.lit(True)), "APPLIED").otherwise("IGNORED"))
        .when(F.col("__final"), F.when(F.col("verdict") == NG, "IGNORED").otherwise("CONFLICT"))
        .when(F.col("__rises"), "APPLIED")
        .when((F.col("revision") == F.col("__held.revision")) & ~F.col("verdict").eqNullSafe(F.col("__held.verdict")), "CONFLICT")
        .otherwise("IGNORED")
    )
    return rows.withColumn("outcome", outcome).select(*messages.columns, "outcome")


def locked_products(judged: DataFrame) -> DataFrame:
    """product_id, verdict, locks, replays: the verdict at the first lock; later locks repeat its event id or contradict it."""

    def at(station: int, short: str) -> list:
        here = F.col("station_id") == station
        applied = here & (F.col("outcome") == "APPLIED")
        spoilt = (here & (F.col("outcome") == "CONFLICT")) | (applied & (F.col("kind") == "CONTRACT"))
        return [
            F.coalesce(F.bool_or(applied & (F.col("kind") == "FAILURE")), F.lit(False)).alias(f"{short}_failed"),
            F.coalesce(F.bool_or(spoilt), F.lit(False)).alias(f"{short}_conflicted"),
            F.max_by("verdict", F.when(applied & (F.col("kind") == "RESULT"), F.col("arrival"))).alias(f"{short}_verdict"),
        ]

    is_lock = F.col("kind") == "LOCK"
    first = F.min_by("inference_job_id", F.when(is_lock, F.col("arrival"))).over(W.partitionBy("product_id"))
    rows = judged.withColumn("__first", first)
    facts = rows.groupBy("product_id").agg(*at(STATION_A, "a"), *at(STATION_B, "b"), F.count_if(is_lock).alias("locks"), (F.count_if(is_lock & (F.col("inference_job_id") == F.col("__first"))) - 1).alias("replays"))
    return facts.where("locks > 0").select("product_id", final_verdict().alias("verdict"), "locks", "replays")
