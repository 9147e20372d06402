"""Contracts between the line's nodes: capture results, batches, model outputs, heartbeats, actuations, key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_sha256_hex
from .events import tri_state

# Fixed values of the contracts.
CAMERAS = {1: ["CAM0", "CAM1", "CAM2"], 2: ["CAM3"]}
PIXEL_FORMAT = "MONO8_PNG"
PASS, NG = 1, 2
SYSTEM_STATES = 8
INTERFACE_VERSION = "2.0"


def _required(station: Column) -> Column:
    return F.when(station == 1, F.array(*map(F.lit, CAMERAS[1]))).when(station == 2, F.array(*map(F.lit, CAMERAS[2])))


def _cameras(images: DataFrame, *fine: Column) -> DataFrame:
    """capture_no, station_id, named (cameras, sorted), one Boolean for each condition on all images."""
    checks = [F.bool_and(F.coalesce(c, F.lit(False))).alias(f"fine{i}") for i, c in enumerate(fine)]
    return images.groupBy("capture_no", "station_id").agg(F.sort_array(F.collect_list("camera_id")).alias("named"), *checks)  # a station's cameras


def complete_results(images: DataFrame) -> DataFrame:
    """capture_no, complete: a result that has its batch, its inference job and at least one attempt, each required camera once and no other, and whole images of some size."""
    whole = is_sha256_hex(F.col("sha256")) & (F.col("file_path") != "") & (F.col("file_size") > 0) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("pixel_format") == PIXEL_FORMAT)
    found = _cameras(images, (F.col("frame_batch_id") != "") & (F.col("inference_job_id") != "") & (F.col("attempt_count") >= 1), whole)
    return found.select("capture_no", (F.col("fine0") & F.col("fine1") & (F.col("named") == _required(F.col("station_id")))).alias("complete"))


def batch_errors(images: DataFrame) -> DataFrame:
    """capture_no, error: the first rule of a capture batch that is broken, null if none."""
    found = _cameras(
        images, F.col("requested_ns") > 0, F.col("returned_ns") >= F.col("requested_ns"), F.col("lost_packets") == 0, F.col("file_path").startswith("/"), is_sha256_hex(F.col("sha256")), F.col("file_size") > 0,
        F.col("requested_wall_ns") > 0, F.col("returned_wall_ns") >= F.col("requested_wall_ns"), F.col("pixel_format") == PIXEL_FORMAT,
    )
    named = F.col("named")
    return found.select(
        "capture_no",
        F.when(~F.col("fine0"), "trigger missing")
        .when(~F.col("fine1"), "trigger order")
        .when(~F.col("fine6"), "wall clock missing")
        .when(~F.col("fine7"), "wall clock order")
        .when(F.size(F.array_distinct(named)) != F.size(named), "duplicate camera")
        .when(named != _required(F.col("station_id")), "cameras differ")
        .when(~F.col("fine2"), "packet loss")
        .when(~F.col("fine3"), "path not absolute")
        .when(~F.col("fine4"), "digest")
        .when(~F.col("fine5"), "file size")
        .when(~F.col("fine8"), "pixel format")
        .alias("error"),
    )


def valid_outputs(views: DataFrame) -> DataFrame:
    """job_id, valid: as many views and image paths as the station has, verdicts PASS or NG, the verdict NG if any view's is, finite scores, the result's own too."""
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    wanted = F.when(F.col("station_id") == 1, 3).otherwise(1)
    made = views.groupBy("job_id", "station_id", "verdict").agg(
        F.count(F.lit(1)).alias("views"), every(F.col("view_verdict").isin(PASS, NG) & finite("view_score") & finite("score") & (F.col("image_paths") == wanted)).alias("fine"), F.max(F.col("view_verdict") == NG).alias("any_ng")
    )
    return made.select("job_id", ((F.col("views") == wanted) & F.col("fine") & (F.col("verdict") == F.when(F.col("any_ng"), NG).otherwise(PASS))).alias("valid"))


def beat_outcomes(beats: DataFrame, session: str) -> DataFrame:
    """``beats`` with ``outcome`` and ``epoch``, the node's command epoch after each: other versions, other sessions and stale epochs are dropped; an unknown system state is a fault, but its epoch counts.

    The epoch is a running maximum over the beats that pass the first two gates, since one below it changes nothing.
    """
    ours = (F.col("interface_version") == INTERFACE_VERSION) & (F.col("session_id") == session)
    before = W.partitionBy("node_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.when(ours, F.col("command_epoch"))).over(before), F.lit(0))
    outcome = (
        F.when(F.col("interface_version") != INTERFACE_VERSION, "VERSION")
        .when(F.col("session_id") != session, "SESSION")
        .when(F.col("command_epoch") < F.col("__known"), "STALE")
        .when(~F.col("system_state").between(0, SYSTEM_STATES - 1), "FAULT")
        .otherwise("ALIVE")
    )
    rows = beats.withColumn("__known", known).withColumn("outcome", outcome)
    return rows.withColumn("epoch", F.when(F.col("outcome").isin("FAULT", "ALIVE"), F.col("command_epoch")).otherwise(F.col("__known"))).drop("__known")


def actuations(requests: DataFrame) -> DataFrame:
    """arrival, command, state: PASS goes through, all else is diverted; a used id with the same product and command is a replay, with others a conflict."""
    command = F.when(F.col("verdict") == "PASS", "PASS_THROUGH").otherwise("DIVERT_NG")
    rows = requests.withColumn("command", command).withColumn("meaning", F.concat_ws("/", "product_id", command))
    return tri_state(rows, rows.limit(0).select("actuation_id", "meaning"), ["actuation_id"], "meaning", ["arrival"]).select("arrival", "command", "state")


def key_differences(text: Column, wanted: list[str]) -> tuple[Column, Column]:
    """Keys that a JSON object lacks, and those that it has beyond the wanted ones, each sorted; both empty if the sets are equal. What isn't an object has no keys."""
    expected, keys = F.array(*map(F.lit, wanted)), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.sort_array(F.array_except(expected, keys)), F.sort_array(F.array_except(keys, expected))
