"""Event store: validation, idempotent append, projections, acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import sha256_text

RESULT, FAILURE = "VISION_STATION_RESULT_DURABLE", "VISION_STATION_FAILURE_DURABLE"
DISCARDED, LOCKED, TIMING = "VISION_CAPTURE_DISCARDED", "PRODUCT_RESULT_LOCKED", "VISION_CAPTURE_TIMING"
GPU = ("VISION_SESSION_METRICS", "VISION_GPU_METRICS_SNAPSHOT")


def with_reject_reason(events: DataFrame) -> DataFrame:
    """``events`` with ``reject_reason``: the first rule that an event breaks, null if none.

    A field of the envelope is held against its column if the envelope has it, be it JSON null; the envelope is parsed once. Null columns break their rules.
    """
    parsed = events.withColumn("__v", F.try_parse_json("payload_json"))
    value = lambda name, kind: F.try_variant_get("__v", f"$.{name}", kind)
    has = lambda name: value(name, "variant").isNotNull()
    differs = lambda name: has(name) & F.coalesce(value(name, "string") != F.col(name), F.lit(True))
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    below = lambda name, least: F.coalesce(F.col(name), F.lit(least - 1)) < least
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    severity = value("severity", "double").cast("bigint")
    reason = (
        F.when(empty("log_id"), "log_id")
        .when(below("revision", 1), "revision")
        .when(empty("event_type"), "event_type")
        .when(empty("source_node"), "source_node")
        .when(empty("producer_instance_id"), "producer_instance_id")
        .when(below("occurred_at_ns", 0), "occurred_at_ns")
        .when(F.coalesce(sha256_text(F.col("payload_json")) != F.col("payload_digest"), F.lit(True)), "payload_digest")
        .when(F.col("__v").isNull(), "payload_json")
        .when(~is_object(F.col("__v")), "payload_root")
        .when(has("schema_version") & F.coalesce(value("schema_version", "string") != "2", F.lit(True)), "schema_version")
    )
    for name in ("event_type", "source_node", "producer_instance_id", "product_id"):
        reason = reason.when(differs(name), f"{name} differs")
    reason = reason.when(has("severity") & F.coalesce(severity != F.col("severity"), F.lit(True)), "severity differs").when(has("payload") & ~is_object(value("payload", "variant")), "payload")
    return parsed.withColumn("reject_reason", reason).drop("__v")


def tri_state(incoming: DataFrame, stored: DataFrame, keys: list[str], digest: str, order: list | None = None) -> DataFrame:
    """``incoming`` with ``state``: NEW key, REPLAY of the same digest, or CONFLICT with another.

    Of several rows of one new key the first in ``order`` (by digest if none is given) is NEW; the others are held against it.
    """
    known = stored.select(*keys, F.col(digest).alias("__known"))
    arrival = W.partitionBy(*keys).orderBy(*(order or [digest]))
    rows = incoming.join(known, keys, "left").withColumn("__turn", F.row_number().over(arrival)).withColumn("__first", F.first(digest).over(arrival))
    state = F.when(F.col("__known").isNull() & (F.col("__turn") == 1), "NEW").when(F.coalesce("__known", "__first") == F.col(digest), "REPLAY").otherwise("CONFLICT")
    return rows.withColumn("state", state).drop("__known", "__turn", "__first")


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def last_wins(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return first_wins(rows, keys, [F.desc(arrival)])


def projectable(envelopes: DataFrame) -> DataFrame:
    """Envelopes whose payload is an object and whose session has a name; the session is the envelope's."""
    body = F.get_json_object("payload_json", "$.payload")
    session = F.get_json_object("payload_json", "$.session_id")
    return envelopes.withColumn("session_id", session).withColumn("payload", body).where(F.col("payload").startswith("{") & (F.coalesce(F.col("session_id"), F.lit("")) != ""))


def field(name: str, kind: str = "string", default: object = None) -> Column:
    """A payload field, its default if it is absent."""
    value = F.get_json_object("payload", f"$.{name}")
    value = value if kind == "string" else value.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def station_terminals(envelopes: DataFrame) -> DataFrame:
    """Typed terminals, the first of each key by arrival."""
    rows = projectable(envelopes.where(F.col("event_type").isin(RESULT, FAILURE))).select(
        "event_id",
        "session_id",
        field("inference_job_id", default="").alias("inference_job_id"),
        field("result_revision", "int", 1).alias("revision"),
        F.when(F.col("event_type") == RESULT, "RESULT").otherwise("FAILURE").alias("terminal_kind"),
        F.coalesce(field("product_id"), F.col("product_id")).alias("product_id"),
        field("fifo_sequence", "bigint", 0).alias("fifo_sequence"),
        field("station_id", "int", 0).alias("station_id"),
        field("verdict", "int").alias("verdict"),
        field("score", "double").alias("score"),
        field("reason", default="").alias("reason"),
    )
    return first_wins(rows, ["session_id", "inference_job_id", "revision", "terminal_kind"], ["event_id"])


def image_paths(envelopes: DataFrame) -> DataFrame:
    """Image paths of results, failures and discarded captures; the first event of a path counts, empty paths don't."""
    rows = projectable(envelopes.where(F.col("event_type").isin(RESULT, FAILURE, DISCARDED)))
    paths = F.from_json(F.get_json_object("payload", "$.image_paths"), "array<string>")
    listed = rows.select("event_id", "session_id", F.coalesce(field("product_id"), F.col("product_id")).alias("product_id"), field("station_id", "int", 0).alias("station_id"), F.explode(paths).alias("file_path"))
    return first_wins(listed.where("file_path <> ''"), ["file_path"], ["event_id"])


def acknowledged(acks: DataFrame) -> DataFrame:
    """Batches of acknowledgements as two arrays, and back to one row for each usable identity: no blank id, no revision under 1."""
    pairs = acks.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("log_id", "revision"))).alias("p"))  # a batch is one message
    return pairs.select("batch", F.col("p.log_id").alias("log_ids"), F.col("p.revision").alias("revisions"))


def identities(batches: DataFrame) -> DataFrame:
    """Rows of the arrays; batches whose arrays differ in length are refused whole."""
    fine = batches.where(F.size("log_ids") == F.size("revisions"))
    rows = fine.select(F.explode(F.arrays_zip("log_ids", "revisions")).alias("z")).select(F.col("z.log_ids").alias("log_id"), F.col("z.revisions").alias("revision"))
    return rows.where((F.trim("log_id") != "") & (F.col("revision") > 0)).distinct()
