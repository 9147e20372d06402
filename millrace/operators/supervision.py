"""Gates of workers and operators: goals, routed commands, readiness, acknowledgements of serial commands, option lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_uuid4, sha256_text
from .anomaly import aggregations, normalizations
from .contracts import CAMERAS

# Operator commands by number, and the field of each normalization.
COMMANDS = {1: "INITIALIZE", 2: "START", 3: "PAUSE", 4: "RESUME", 5: "RESET", 6: "CONFIRM_LINE_CLEAR"}
OPTION_FIELDS = {"epsilon": "epsilon_ratio", "std_floor": "std_floor_ratio", "shrinkage": "shrinkage_lambda", "mad": "mad_epsilon_ratio"}
FAULT_STOP, READY = 6, 1
PREPROCESSING_KEYS = ["check_connection", "connectivity", "remove_disconnected_noise", "v_threshold"]


def routed(commands: DataFrame) -> DataFrame:
    """``commands`` with ``route``: the handler's name, or why there is none. An id counts by its first payload; one without an id stands alone."""
    digest = sha256_text(F.concat_ws("|", F.col("command_type").cast("string"), "reason", "operator_id"))
    own = W.partitionBy(F.when(F.col("request_id") == "", F.concat(F.lit("#"), F.col("arrival").cast("string"))).otherwise(F.col("request_id"))).orderBy("arrival")
    rows = commands.withColumn("__digest", digest).withColumn("__first", F.first("__digest").over(own)).withColumn("__turn", F.row_number().over(own))
    handler = F.element_at(F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair]), F.col("command_type"))
    route = (
        F.when((F.col("request_id") != "") & ~is_uuid4(F.col("request_id")), "INVALID_ID")
        .when(F.col("__digest") != F.col("__first"), "CONFLICT")
        .when(F.col("__turn") > 1, "REPLAY")
        .when(handler.isNull(), "UNKNOWN")
        .when((handler == "CONFIRM_LINE_CLEAR") & (F.col("operator_id") == ""), "OPERATOR_MISSING")
        .otherwise(handler)
    )
    return rows.withColumn("route", route).drop("__digest", "__first", "__turn")


def accepted_goals(goals: DataFrame) -> DataFrame:
    """capture_id, accepted: a capture goal with its ids, a known station, that station's cameras in their order, and no cancelled scope."""
    wanted = F.when(F.col("station_id") == 1, F.array(*map(F.lit, CAMERAS[1]))).when(F.col("station_id") == 2, F.array(*map(F.lit, CAMERAS[2])))
    fine = ~F.col("shutdown") & (F.col("product_id") != "") & (F.col("capture_id") != "") & (F.col("command_id") != "") & ~F.col("cancelled") & F.coalesce(F.col("cameras") == wanted, F.lit(False))
    return goals.select("goal_no", "capture_id", fine.alias("accepted"))


def readiness(workers: DataFrame, session: str, epoch: int, version: str, timeout_ns: int) -> DataFrame:
    """``workers`` with ``ready``: an action, a status and a fresh heartbeat of one instance, all of this session, version and epoch."""
    ready = (
        F.col("action_ready")
        & F.col("status_verified")
        & (F.col("status_instance") == F.col("beat_instance"))
        & (F.col("status_session") == session)
        & (F.col("beat_session") == session)
        & (F.col("interface_version") == version)
        & (F.col("command_epoch") == epoch)
        & (F.col("beat_sequence") >= F.col("status_sequence"))
        & F.col("status_ready")
        & F.col("master_alive")
        & (F.col("status_health") == READY)
        & (F.col("beat_health") == READY)
        & (F.col("received_ns") > 0)
        & (F.col("now_ns") - F.col("received_ns") <= timeout_ns)
    )
    return workers.withColumn("ready", F.coalesce(ready, F.lit(False)))


def late_operation(details: Column, operation: Column, correlation: Column) -> Column:
    """The caller's fields with the operation and its correlation, which no field of the caller's can replace."""
    fixed = F.create_map(F.lit("operation"), operation, F.lit("correlation_id"), correlation)
    return F.map_concat(F.map_filter(details, lambda k, _: ~k.isin("operation", "correlation_id")), fixed)


def acknowledged(sent: DataFrame, answers: DataFrame, timeout_ms: int) -> DataFrame:
    """sequence, outcome: the first answer to a serial command in time: OK, ``rejected: ...``, or ``timeout``."""
    first = (
        sent.join(answers.select("sequence", "received_ms", "status"), "sequence", "left")
        .groupBy("sequence", "sent_ms")
        .agg(F.min(F.when((F.col("received_ms") >= F.col("sent_ms")) & (F.col("received_ms") < F.col("sent_ms") + timeout_ms), F.struct("received_ms", "status"))).alias("answer"))
    )
    status = F.col("answer.status")
    return first.select("sequence", F.when(status.isNull(), "timeout").when(status == "OK", "OK").otherwise(F.concat(F.lit("rejected: "), status)).alias("outcome"))


def uncollected(answers: DataFrame, sent: DataFrame, now_ms: int, keep_ms: int = 15_000) -> DataFrame:
    """Answers that belong to no command sent, with ``stale``: those older than ``keep_ms`` are forgotten."""
    return answers.join(sent.select("sequence"), "sequence", "left_anti").withColumn("stale", F.col("received_ms") < now_ms - keep_ms)


def _listed(method: Column, value: Column, options: list[tuple[str, float]]) -> Column:
    by = {m: [v for n, v in options if n == m] for m, _ in options}
    found = F.lit(False)
    for m, values in by.items():
        found = found | ((method == m) & value.isin(values))
    return F.coalesce(found, F.lit(False))


def _told(parts: dict[str, Column], judge: Callable[[Column], Column]) -> Column:
    """``judge`` of a struct of ``parts``, each worked out once however often it is named."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), judge), F.lit(0))


def _option(text: Column, fields: Iterable[str], judge: Callable[[Column], Column]) -> Column:
    """``judge`` of an option's sorted keys, its method, and the fields named."""

    def parts(o: Column) -> Column:
        keys = F.array_sort(F.coalesce(F.json_object_keys(o["text"]), F.array().cast("array<string>")))
        return _told({"keys": keys, "method": F.coalesce(F.get_json_object(o["text"], "$.method"), F.lit("")), **{f: F.get_json_object(o["text"], f"$.{f}") for f in fields}}, judge)

    return _told({"text": text}, parts)


def normalization_error(text: Column) -> Column:
    """Why a normalization option is refused, null if it isn't: its keys, its value, or that it is no candidate."""

    def valued(o: Column) -> Column:
        raw = F.lit(None).cast("string")
        for m, f in OPTION_FIELDS.items():
            raw = F.when(o["method"] == m, o[f]).otherwise(raw)
        field = F.element_at(F.create_map(*[F.lit(x) for pair in OPTION_FIELDS.items() for x in pair]), o["method"])
        return _told({"keys": o["keys"], "method": o["method"], "field": field, "value": raw.try_cast("double")}, error)

    def error(o: Column) -> Column:
        value = o["value"]
        return (
            F.when(F.coalesce(o["keys"] != F.array_sort(F.array(F.lit("method"), o["field"])), F.lit(True)), "keys")
            .when(value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf")), "value")
            .when(~_listed(o["method"], value, normalizations()), "candidate")
        )

    return _option(text, dict.fromkeys(OPTION_FIELDS.values()), valued)


def aggregation_error(text: Column) -> Column:
    """The same of an aggregation option."""
    names = lambda *n: F.array(*[F.lit(x) for x in sorted(n)])

    def valued(o: Column) -> Column:
        share = o["method"] == "top_k_percent_average"
        value = F.when(share, o["top_k_percent"]).otherwise(o["percentile"]).try_cast("double")
        return _told({"share": share, "value": value, **{n: o[n] for n in ("keys", "method", "rounding", "minimum_patch_count")}}, error)

    def error(o: Column) -> Column:
        return (
            F.when(~o["method"].isin("percentile", "top_k_percent_average"), "method")
            .when(o["keys"] != F.when(o["share"], names("method", "top_k_percent", "rounding", "minimum_patch_count")).otherwise(names("method", "percentile")), "keys")
            .when(~_listed(o["method"], o["value"], aggregations()), "candidate")
            .when(o["share"] & F.coalesce(o["rounding"] != "ceil", F.lit(True)), "rounding")
            .when(o["share"] & F.coalesce(o["minimum_patch_count"].try_cast("double") != 1, F.lit(True)), "minimum")
        )

    return _option(text, ("top_k_percent", "percentile", "rounding", "minimum_patch_count"), valued)


def preprocessing_error(text: Column) -> Column:
    """Why preprocessing settings are refused, null if they aren't. Types come from the JSON itself: a number in quotes is none."""
    v = F.try_parse_json(text)
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit(""))
    whole = lambda n: F.try_variant_get(v, f"$.{n}", "long")
    flag = lambda n: F.try_variant_get(v, f"$.{n}", "boolean")
    keys = F.array_sort(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))
    typed = (kind("v_threshold") == "BIGINT") & (kind("connectivity") == "BIGINT") & (kind("remove_disconnected_noise") == "BOOLEAN") & (kind("check_connection") == "BOOLEAN")
    return (
        F.when(keys != F.array(*map(F.lit, PREPROCESSING_KEYS)), "keys")
        .when(~typed, "types")
        .when(~whole("v_threshold").between(0, 255), "threshold")
        .when(whole("connectivity") != 8, "connectivity")
        .when(~flag("remove_disconnected_noise") | flag("check_connection"), "policy")
    )


def fingerprint(settings: dict[str, Column]) -> Column:
    """SHA-256 of the settings as one JSON object, keys sorted, no spaces, nulls kept."""
    return sha256_text(F.to_json(F.struct(*[settings[n].alias(n) for n in sorted(settings)]), {"ignoreNullFields": "false"}))


def model_identity_error(path: Column, version: Column, expected: Column, actual: Column) -> Column:
    """Why a model's identity is refused, null if it isn't. ``actual`` is the digest of its folder."""
    return (
        F.when(~path.startswith("/"), "path")
        .when(F.coalesce(version, F.lit("")) == "", "version")
        .when(~F.coalesce(F.lower(expected).rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
        .when(F.lower(expected) != actual, "differs")
    )


def tuned_timeouts(text: Column, identity: dict[str, str], samples: int, factor: float) -> tuple[Column, Column, Column]:
    """(error, station_a, station_b) of a generated tuning document: another model's or an ineligible one is refused, timeouts count if positive."""
    v = F.try_parse_json(text)
    get = lambda n, kind: F.try_variant_get(v, f"$.{n}", kind)
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    same = F.lit(True)
    for name, value in identity.items():
        same = same & (F.coalesce(get(name, "string"), F.lit("")) == value)
    stations = F.array_sort(F.json_object_keys(F.get_json_object(text, "$.timeouts_ms")))
    fit = (get("schema_version", "int") == 1) & (get("minimum_samples", "int") >= samples) & (get("safety_factor", "double") == factor) & (stations == F.array(F.lit("station_a"), F.lit("station_b")))
    error = F.when(~is_object(v), "document").when(~same, "identity").when(~F.coalesce(fit, F.lit(False)), "eligibility")
    timeout = lambda n: F.when(error.isNull() & (get(f"timeouts_ms.{n}", "long") > 0), get(f"timeouts_ms.{n}", "long"))
    return error, timeout("station_a"), timeout("station_b")


def spatial_errors(patches: DataFrame, size: int) -> DataFrame:
    """payload_no, error: the first rule that a spatial calibration of ``size`` patches breaks, null if none."""
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    found = patches.groupBy("payload_no").agg(
        F.count_distinct("patch").alias("n"),
        every(finite("center") & finite("denominator") & finite("raw_scale")).alias("finite"),
        every(F.col("denominator") > 0).alias("denominator"),
        every(F.col("raw_scale") >= 0).alias("raw_scale"),
        every(finite("scale_reference") & (F.col("scale_reference") > 0) & (F.col("sample_count") >= 2)).alias("metadata"),
    )
    error = F.when(F.col("n") != size, "grid").when(~F.col("finite"), "not finite").when(~F.col("denominator"), "denominator").when(~F.col("raw_scale"), "raw scale").when(~F.col("metadata"), "metadata")
    return found.select("payload_no", error.alias("error"))


def key_set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, side: keys that only one of two tables of one column ``key`` has: ``missing`` on the right or ``extra`` there. One shuffle."""
    both = left.select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("key", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r").select("key", F.when(F.col("l") == 1, "missing").otherwise("extra").alias("side"))
