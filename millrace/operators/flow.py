"""Product flow: verdicts, late messages, sequences, prefixes, gates, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# States and their transitions (state, event, rule, next state).
SYSTEM_STATES = ["BOOT", "INITIALIZING", "READY", "RUN_SYS", "PAUSING", "PAUSED", "FAULT_STOP", "RESETTING"]
TRANSITIONS = [
    ("BOOT", "APP_STARTED", "SYS-01", "INITIALIZING"),
    ("INITIALIZING", "INIT_DONE", "SYS-02", "READY"),
    ("INITIALIZING", "INIT_FAILED", "SYS-03", "INITIALIZING"),
    ("INITIALIZING", "INIT_TIMEOUT", "SYS-03", "INITIALIZING"),
    ("READY", "START_REQUEST", "SYS-04", "READY"),
    ("READY", "START_FAILED", "SYS-04", "READY"),
    ("READY", "ALL_CONVEYORS_RUNNING", "SYS-04", "RUN_SYS"),
    ("RUN_SYS", "PAUSE_REQUEST", "SYS-05", "PAUSING"),
    ("RUN_SYS", "RECOVERABLE_DEVICE_FAULT", "SYS-05A", "PAUSING"),
    ("PAUSING", "ALL_CONVEYORS_STOPPED", "SYS-06", "PAUSED"),
    ("PAUSING", "PAUSE_FAILED", "SYS-07", "FAULT_STOP"),
    ("PAUSING", "PAUSE_TIMEOUT", "SYS-07", "FAULT_STOP"),
    ("PAUSED", "RESUME_REQUEST", "SYS-08", "PAUSED"),
    ("PAUSED", "DEVICE_RECOVERED", "SYS-08", "PAUSED"),
    ("PAUSED", "RESUME_FAILED", "SYS-08", "PAUSED"),
    ("PAUSED", "ALL_CONVEYORS_RUNNING", "SYS-08", "RUN_SYS"),
    ("FAULT_STOP", "RESET_REQUEST", "SYS-11", "RESETTING"),
    ("RESETTING", "RESET_SUCCEEDED_EMPTY_LINE", "SYS-12", "READY"),
    ("RESETTING", "RESET_SUCCEEDED_IN_PLACE", "SYS-12A", "PAUSED"),
    ("RESETTING", "RESET_FAILED", "SYS-13", "RESETTING"),
    ("RESETTING", "RESET_TIMEOUT", "SYS-13", "RESETTING"),
]
#: Accepted in every state: event, rule.
FAULTS = [("CRITICAL_FAULT", "SYS-10"), ("ESTOP_ASSERTED", "SYS-15")]
VERDICTS = {1: "PASS", 2: "NG", 3: "FORCED_NG"}


def named(number: Column, names: dict[int, str]) -> Column:
    """Name of an enumerated number, null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), number)


def final_verdict() -> Column:
    """Verdict of a product from what its stations reported, in a fixed order of rules."""
    return (
        F.when(F.col("a_failed") | F.col("a_conflicted"), "FORCED_NG")
        .when(F.col("a_verdict") == 2, "NG")
        .when(F.col("b_failed") | F.col("b_conflicted"), "FORCED_NG")
        .when(F.col("a_verdict").isNull() | F.col("b_verdict").isNull(), "FORCED_NG")
        .when((F.col("a_verdict") == 1) & (F.col("b_verdict") == 1), "PASS")
        .otherwise("NG")
    )


def verdict_reason() -> Column:
    return (
        F.when(F.col("a_failed") | F.col("a_conflicted"), "Station A failed")
        .when(F.col("a_verdict") == 2, "Station A terminal NG")
        .when(F.col("b_failed") | F.col("b_conflicted"), "Station B failed")
        .when(F.col("a_verdict").isNull() | F.col("b_verdict").isNull(), "station result incomplete at Sensor3")
        .otherwise("both station results completed")
    )


def actuation(verdict: Column) -> Column:
    return F.when(verdict == "PASS", "PASS_THROUGH").otherwise("DIVERT_NG")


def classify_messages(messages: DataFrame, ledger: DataFrame, owners: DataFrame, active: DataFrame, retired: DataFrame) -> DataFrame:
    """``messages`` with the outcome that the ledger gives them, late ones included: nothing is dropped, everything is named."""
    known = ledger.select("product_id", F.col("fifo_sequence").alias("known_fifo"), "removed", "locked")
    gone = retired.select("product_id", F.col("fifo_sequence").alias("gone_fifo"))
    rows = (
        messages.join(known, "product_id", "left")
        .join(owners, "capture_id", "left")
        .join(gone, "product_id", "left")
        .join(active.withColumnRenamed("station_id", "station_id_raw"), ["product_id", "station_id_raw"], "left")
    )
    member = F.col("known_fifo") == F.col("fifo_sequence")
    inside = F.coalesce(member, F.lit(False))
    owned = F.coalesce((F.col("owner_product") == F.col("product_id")) & (F.col("owner_station") == F.col("station_id_raw")), F.lit(False))
    expects = F.col("expects_verdict")
    no_score = expects & F.col("score").isNull()
    incomplete = (expects & ~F.col("verdict_raw").isin(1, 2, 3)) | (F.col("result_revision") < 1) | (F.col("frame_batch_id") == "") | (F.col("inference_job_id") == "")
    outcome = (
        F.when(~F.col("station_id_raw").isin(1, 2), "INVALID_STATION_ID")
        .when(~inside & (F.col("gone_fifo") == F.col("fifo_sequence")), "EXPIRED_PRODUCT")
        .when(~inside & F.col("owner_product").isNotNull(), "CAPTURE_OWNER_CONFLICT")
        .when(~inside, "UNKNOWN_PRODUCT")
        .when(~owned, "UNREGISTERED_CAPTURE")
        .when(F.col("removed"), "REMOVED_PRODUCT")
        .when(F.coalesce(F.col("active_capture_id"), F.lit("")) != F.col("capture_id"), "SUPERSEDED_CAPTURE")
        .when(F.col("locked"), "LATE_AFTER_LOCK")
        .when(no_score | incomplete, "CONTRACT_INCOMPLETE")
        .otherwise("ACCEPTED")
    )
    defect = F.when(outcome != "CONTRACT_INCOMPLETE", "NONE").when(no_score, "SCORE_NOT_FINITE").otherwise("PAYLOAD_INCOMPLETE")
    return rows.withColumn("outcome", outcome).withColumn("defect", defect)


#: What follows from an outcome.
ACTIONS = [("INVALID_STATION_ID", "fault_stop"), ("EXPIRED_PRODUCT", "ignore"), ("CAPTURE_OWNER_CONFLICT", "fault_stop"), ("UNKNOWN_PRODUCT", "fault_stop"), ("UNREGISTERED_CAPTURE", "fault_stop"), ("REMOVED_PRODUCT", "ignore"), ("SUPERSEDED_CAPTURE", "ignore"), ("LATE_AFTER_LOCK", "ignore"), ("CONTRACT_INCOMPLETE", "force_ng"), ("ACCEPTED", "apply")]


def transitions(spark) -> DataFrame:  # noqa: ANN001
    """state, event, rule, next_state, with the faults that every state accepts."""
    rows = TRANSITIONS + [(s, e, rule, "FAULT_STOP") for s in SYSTEM_STATES for e, rule in FAULTS]
    return spark.createDataFrame(rows, "state string, event string, rule string, next_state string")


def completed_prefix(ledger: DataFrame) -> DataFrame:
    """Products from the front of the queue up to the first that isn't done. That first is one value, so no total order is needed."""
    stop = ledger.where(~F.col("completed")).agg(F.min("fifo_sequence").alias("stop"))
    return ledger.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("fifo_sequence") < F.col("stop"))).drop("stop")  # one row


def ready_run(locked: DataFrame, partition: str, sequence: str, first: int) -> DataFrame:
    """Rows that a reorder buffer lets go: the unbroken run of sequences from ``first``."""
    w = W.partitionBy(partition).orderBy(sequence)
    rows = locked.where(F.col(sequence) >= first).dropDuplicates([partition, sequence])
    return rows.withColumn("island", F.col(sequence) - F.row_number().over(w)).where(F.col("island") == first - 1).drop("island")


def sequence_steps(events: DataFrame) -> DataFrame:
    """The step from the sequence before: exact up to a sensor's first gap; the state machine goes on from there."""
    w = W.partitionBy("sensor_id").orderBy("arrival")
    before = F.lag("sequence").over(w)
    return events.withColumn("step", F.when(before.isNull(), "FIRST").when(F.col("sequence") <= before, "OUT_OF_ORDER").when(F.col("sequence") != before + 1, "SEQUENCE_GAP").otherwise("NEXT"))


def heartbeats(beats: DataFrame) -> DataFrame:
    """Whether a heartbeat is news: a sequence over all earlier ones of its instance; and whether the instance changed."""
    own = W.partitionBy("node_id", "instance_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    line = W.partitionBy("node_id").orderBy("arrival")
    top = F.max("sequence").over(own)
    return beats.withColumn("accepted", top.isNull() | (F.col("sequence") > top)).withColumn("restarted", F.coalesce(F.lag("instance_id").over(line) != F.col("instance_id"), F.lit(False)))


def later_heartbeats(beats: DataFrame) -> DataFrame:
    """node_id, arrival, later: for each heartbeat, how many of its instance have its sequence or a higher one, itself included."""
    own = W.partitionBy("node_id", "instance_id").orderBy("sequence").rangeBetween(W.currentRow, W.unboundedFollowing)
    return beats.where("node_id IS NOT NULL AND instance_id IS NOT NULL AND sequence IS NOT NULL").select("node_id", "arrival", F.count(F.lit(1)).over(own).alias("later"))


FSM_SCHEMA = T.StructType([T.StructField(n, T.StringType() if n != "arrival" else T.LongType()) for n in ("session_id", "arrival", "event", "state", "rule", "next_state")])


def neighbours(line: DataFrame, order: str, value: str, width: int = 100_000) -> DataFrame:
    """order, value, follows, next_state: every row of one line but the last, beside the row after it.

    The line is cut into stretches of ``width`` numbers; neighbours within one meet in a window, the ends of stretches in a table of two rows for each.
    """
    stretch = F.floor(F.col(order) / width)
    rows = line.select(order, value, stretch.alias("stretch"))
    own = W.partitionBy("stretch").orderBy(order, F.desc(value))
    inside = rows.select(order, value, F.lead(order).over(own).alias("follows"), F.lead(value).over(own).alias("next_state")).where("follows IS NOT NULL")
    first, last = F.min(F.struct(F.col(order), -F.col(value))), F.max(F.struct(F.col(order), -F.col(value)))
    ends = rows.groupBy("stretch").agg(first.alias("first"), last.alias("last"))
    line_up = W.orderBy("stretch")
    across = ends.select(F.col("last")[order].alias(order), (-F.col("last")["col2"]).alias(value), F.lead(F.col("first")[order]).over(line_up).alias("follows"), (-F.lead(F.col("first")["col2"]).over(line_up)).alias("next_state"))
    return inside.unionByName(across.where("follows IS NOT NULL"))


def retirement(messages: DataFrame, removals: DataFrame, keep_ms: int = 600_000, tombstones: int = 4096) -> DataFrame:
    """``messages`` (session_id, product_id, at_ms) with life: ACTIVE before the product's removal, REMOVED while its record is kept, RETIRED while its tombstone is, then FORGOTTEN.

    ``removals``: session_id, product_id, removed_ms, one row for each product that was removed. A record is kept for ``keep_ms``; then a tombstone takes its place, and a session
    keeps the last ``tombstones`` of them, in the order of their retirement, then of their names. A product retires at its time, whether or not messages come. Only counts by window, no state.
    """
    own = W.partitionBy("session_id").orderBy("retired_ms", "product_id")
    gone = removals.select("session_id", "product_id", "removed_ms", (F.col("removed_ms") + keep_ms).alias("retired_ms"))
    placed = gone.withColumn("place", F.row_number().over(own))
    moments = messages.select("session_id", "at_ms").distinct().select("session_id", "at_ms", F.lit(0).alias("retired")).unionByName(gone.select("session_id", F.col("retired_ms").alias("at_ms"), F.lit(1).alias("retired")))
    upto = W.partitionBy("session_id").orderBy("at_ms").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = moments.withColumn("passed", F.sum("retired").over(upto)).where("retired = 0").select("session_id", "at_ms", "passed")
    rows = messages.join(counted, ["session_id", "at_ms"]).join(placed, ["session_id", "product_id"], "left")
    life = F.when(F.col("removed_ms").isNull() | (F.col("at_ms") < F.col("removed_ms")), "ACTIVE").when(F.col("at_ms") < F.col("retired_ms"), "REMOVED").when(F.col("place") > F.col("passed") - tombstones, "RETIRED").otherwise("FORGOTTEN")
    return rows.withColumn("life", life).select(*messages.columns, "life")


def oldest_in_states(ledger: DataFrame) -> DataFrame:
    """physical_state, oldest, behind: of the products not removed, the first of each state, and the first of those before it that are in a lower one (null if none is)."""
    active = ledger.where("NOT removed")
    oldest = active.groupBy("physical_state").agg(F.min("fifo_sequence").alias("oldest"))
    limits = F.broadcast(oldest.withColumnRenamed("physical_state", "state"))  # a row for each state that there is
    late = active.join(limits, (F.col("fifo_sequence") < F.col("oldest")) & (F.col("physical_state") < F.col("state"))).groupBy("state").agg(F.min_by("product_id", "fifo_sequence").alias("behind"))
    return oldest.join(late.withColumnRenamed("state", "physical_state"), "physical_state", "left").select("physical_state", "oldest", "behind")
