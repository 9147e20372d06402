"""What becomes of work in progress: inference jobs, phases with a deadline, actuation commands, discarded images, product snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import uuid4_of

# The phases of a station and of an actuation, event types, and the splits and libraries of the older tools.
CAPTURING = ("CAPTURE_GOAL", "WAITING_CAPTURE_RESULT")
DISCARDED, CANCELED = "VISION_CAPTURE_DISCARDED", "VISION_INFERENCE_CANCELED"
OLD_SPLITS = ("training_set", "val_set", "test_set_normal", "test_set_anomaly")
LIBRARIES = {"anomalib": "2.6.0", "torch": "2.12.1+cu132", "lightning": "2.6.5"}

MS = 1_000_000


def job_outcomes(jobs: DataFrame, images: DataFrame) -> DataFrame:
    """job_id, outcome, load_ms, forward_ms, total_ms: how a job ended, and its timing if the model ran to its end.

    A job is looked at when it is taken, while an image is read again, when all are read and when the model is done; a cancellation counts
    before a deadline. Reading is tried twice, but not if the image itself is refused. Of several images that fail, the first decides.
    A job without timeout is never late; one without images fails at none. Images of a job are as many as its station's cameras.
    """
    late = lambda at: F.coalesce(at - F.col("enqueued_ns") > F.col("timeout_ms") * MS, F.lit(False))
    gone = lambda at: F.coalesce(F.col("cancelled_ns") <= at, F.lit(False))

    def failure(x: Column) -> Column:
        again = F.when(late(x["retried_ns"]), "TIMEOUT").when(x["second_error"] == "preprocessing", "PREPROCESSING").when(x["second_error"] != "", "FILE_READ")
        return F.when(x["first_error"] == "preprocessing", "PREPROCESSING").when(x["first_error"] != "", again)

    tries = images.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("image_no", "first_error", "second_error", "retried_ns"))).alias("__tries"))
    rows = jobs.join(tries, "job_id", "left")
    unread = F.get(F.filter(F.transform("__tries", failure), lambda o: o.isNotNull()), F.lit(0))
    error = F.col("forward_error")
    stopped = (
        F.when(gone(F.col("dequeued_ns")), "DEQUEUED_BEFORE_LOAD")
        .when(late(F.col("dequeued_ns")), "TIMEOUT")
        .when(unread.isNotNull(), unread)
        .when(gone(F.col("loaded_ns")), "LOADED_BEFORE_FORWARD")
        .when(late(F.col("loaded_ns")) | (error == "deadline"), "TIMEOUT")
        .when(F.lower(error).contains("cuda out of memory"), "CUDA_OOM")
        .when(error != "", "MODEL")
    )
    ended = F.when(gone(F.col("completed_ns")), "DISCARDED_AFTER_FORWARD").when(late(F.col("completed_ns")), "TIMEOUT").otherwise("SUCCESS")
    took = lambda start, end: F.when(F.col("__stopped").isNull(), (F.col(end) - F.col(start)) / MS)
    return rows.withColumn("__stopped", stopped).select(
        "job_id",
        F.coalesce("__stopped", ended).alias("outcome"),
        took("dequeued_ns", "loaded_ns").alias("load_ms"),
        took("loaded_ns", "completed_ns").alias("forward_ms"),
        took("enqueued_ns", "completed_ns").alias("total_ms"),
    )


def overdue(timers: DataFrame) -> DataFrame:
    """``timers`` with ``action``: what a phase past its deadline calls for, null before it or without one. Either way a deadline fires once.

    A capture that the queue holds back only loses its deadline. A conveyor that still runs never began to position, so its station pauses;
    once it has stopped, nobody knows where the product is.
    """
    phase = F.col("phase")
    action = (
        F.when(phase.isin(*CAPTURING), F.when(F.col("queue_paused"), "HELD").otherwise("CAPTURE_FAILURE"))
        .when(phase == "WAITING_POSITION", F.when(F.coalesce("conveyor_running", F.lit(False)), "PAUSE_STATION").otherwise("FAULT_STOP"))
        .when(phase == "RESUME_PENDING", "PAUSE_AND_RESUME_LATER")
        .when(phase == "WAITING_RESULT", "FAULT_STOP")
        .when(phase == "GOAL_PENDING", "PAUSE_DEVICE")
        .otherwise("CLEARED")
    )
    return timers.withColumn("action", F.when((F.col("deadline_ns") != 0) & (F.col("now_ns") > F.col("deadline_ns")), action))


def executed_actuations(goals: DataFrame) -> DataFrame:
    """``goals`` with ``state``, ``success``, ``actuation_id`` and ``reason``. A command runs once, by its first goal with a valid header; later ones of the same
    digest get that answer again, a failure as well, others are conflicts. Every id is remembered. Ids follow from the command, so that a task that is run again gives the same.
    """
    by_command = W.partitionBy("header_valid", "command_id").orderBy("arrival")
    first = lambda c: F.first(c).over(by_command)
    rows = goals.withColumn("__digest", first("payload_digest")).withColumn("__answer", first("answer")).withColumn("__turn", F.row_number().over(by_command))
    state = F.when(~F.col("header_valid"), "HEADER").when(F.col("payload_digest") != F.col("__digest"), "CONFLICT").when(F.col("__turn") > 1, "REPLAY").otherwise("EXECUTED")
    known, success = F.col("state").isin("EXECUTED", "REPLAY"), F.coalesce(F.col("__answer") == "OK", F.lit(False))
    return (
        rows.withColumn("state", state)
        .withColumn("success", known & success)
        .withColumn("actuation_id", F.when(known & success, uuid4_of(F.col("command_id"))).otherwise(""))
        .withColumn("reason", F.when(known, F.when(success, "done").when(F.col("__answer").isNull(), "timeout").otherwise(F.concat(F.lit("rejected: "), "__answer"))).otherwise(F.lower("state")))
        .drop("__digest", "__answer", "__turn")
    )


def retained_images(events: DataFrame) -> DataFrame:
    """event_id, position, file_path: images of discarded captures, which retention deletes. Those of cancelled jobs are stored with their event alone."""
    paths = F.from_json(F.get_json_object("payload_json", "$.image_paths"), "array<string>")
    return events.where(F.col("event_type") == DISCARDED).select("event_id", F.posexplode(paths).alias("position", "file_path")).where("file_path <> ''")


def view_differences(files: DataFrame, first_view: str) -> DataFrame:
    """split, view, filename, side: names that a view lacks or has beyond the first view's, in one shuffle. ``files`` holds every view of every split at least once."""
    views = files.select("split", "view").distinct()  # a few rows: splits by views
    held = files.groupBy("split", "filename").agg(F.collect_set("view").alias("held"))
    both = held.join(F.broadcast(views.groupBy("split").agg(F.collect_set("view").alias("wanted"))), "split")
    wrong = F.when(F.array_contains("held", first_view), F.array_except("wanted", "held")).otherwise(F.array_except("held", F.array(F.lit(first_view))))
    return both.select("split", F.explode(wrong).alias("view"), "filename", F.when(F.array_contains("held", first_view), "missing").otherwise("extra").alias("side"))


def library_error(installed: Column) -> Column:
    """The first library of a map of name to version that isn't exactly the wanted one, null if all are."""
    wrong = [F.when(~F.coalesce(installed[name] == version, F.lit(False)), name) for name, version in LIBRARIES.items()]
    return F.coalesce(*wrong)


def product_snapshots(stations: DataFrame) -> DataFrame:
    """product_id, snapshot: one JSON document for each product. Maps by station hold every station, those of reasons only stations that have one; an open product is PENDING.

    ``stations`` has one row for each product and station; the product's own columns are the same in both.
    """
    rows = F.sort_array(F.collect_list(F.struct("station", "capture_id", "result", "failure_reason", "skip_reason")))
    made = stations.groupBy("product_id", "fifo_sequence", "physical_state", "revision", "verdict").agg(rows.alias("s"))
    named = lambda field: F.map_from_entries(F.transform("s", lambda x: F.struct(x["station"], x[field])))
    given = lambda field: F.map_filter(named(field), lambda _, v: F.coalesce(v != "", F.lit(False)))
    document = F.struct(
        "product_id",
        "fifo_sequence",
        "physical_state",
        "revision",
        named("capture_id").alias("capture_ids"),
        named("result").alias("station_results"),
        given("failure_reason").alias("station_failure_reasons"),
        given("skip_reason").alias("station_skip_reasons"),
        F.coalesce("verdict", F.lit("PENDING")).alias("final_verdict"),
    )
    return made.select("product_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("snapshot"))


def sensor_identities(passed: DataFrame) -> DataFrame:
    """``passed`` with ``outcome``: the first event of a product at a sensor is RECORDED, the same event again changes nothing, another one is a CONFLICT."""
    seen = W.partitionBy("product_id", "sensor_index").orderBy("arrival")
    rows = passed.withColumn("__first", F.first("sensor_event").over(seen)).withColumn("__turn", F.row_number().over(seen))
    outcome = F.when(F.col("sensor_event") != F.col("__first"), "CONFLICT").when(F.col("__turn") > 1, "KEPT").otherwise("RECORDED")
    return rows.withColumn("outcome", outcome).drop("__first", "__turn")
