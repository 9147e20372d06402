"""Queries of the event store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import clamp_limit
from ..functions.text import is_sha256_hex, is_uuid4, sha256_text
from ..operators import events as E
from ..sources.tables import Tables
from .registry import query

REJECT = """
SELECT event_id, CASE WHEN log_id = '' THEN 'log_id' WHEN revision < 1 THEN 'revision' WHEN event_type = '' THEN 'event_type' WHEN source_node = '' THEN 'source_node'
  WHEN producer_instance_id = '' THEN 'producer_instance_id' WHEN occurred_at_ns < 0 THEN 'occurred_at_ns' WHEN sha256(payload_json) <> payload_digest THEN 'payload_digest'
  WHEN NOT json_valid(payload_json) THEN 'payload_json' WHEN json_type(payload_json) <> 'OBJECT' THEN 'payload_root'
  WHEN json_extract_string(payload_json, '$.schema_version') <> '2' THEN 'schema_version'
  WHEN json_extract_string(payload_json, '$.event_type') <> event_type THEN 'event_type differs' WHEN json_extract_string(payload_json, '$.source_node') <> source_node THEN 'source_node differs'
  WHEN json_extract_string(payload_json, '$.product_id') <> product_id THEN 'product_id differs' WHEN json_extract_string(payload_json, '$.severity') <> CAST(severity AS VARCHAR) THEN 'severity differs'
  WHEN json_type(payload_json, '$.payload') <> 'OBJECT' THEN 'payload' END AS reject_reason FROM log_event"""


@query("f01_validate_event", REJECT)
def validate(t: Tables) -> DataFrame:
    return E.with_reject_reason(t.log_event).select("event_id", "reject_reason")


@query("f02_reject_counts", f"SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM ({REJECT}) r GROUP BY 1")
def reject_counts(t: Tables) -> DataFrame:
    return validate(t).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


GATE = "json_type(payload_json, '$.payload') = 'OBJECT' AND coalesce(json_extract_string(payload_json, '$.session_id'), '') <> ''"
P = "json_extract_string(payload_json, '$.payload.{}')"


@query("f03_projection_gate", f"SELECT event_type, count(*) AS n FROM envelope WHERE {GATE} GROUP BY event_type")
def gate(t: Tables) -> DataFrame:
    return E.projectable(t.envelope).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("f04_event_router", "SELECT event_id, CASE WHEN event_type IN ('VISION_STATION_RESULT_DURABLE', 'VISION_STATION_FAILURE_DURABLE') THEN 'terminals' WHEN event_type = 'VISION_CAPTURE_DISCARDED' THEN 'images' WHEN event_type = 'PRODUCT_RESULT_LOCKED' THEN 'products' WHEN event_type = 'VISION_CAPTURE_TIMING' THEN 'timings' WHEN event_type IN ('VISION_SESSION_METRICS', 'VISION_GPU_METRICS_SNAPSHOT') THEN 'gpu' END AS target, CASE event_type WHEN 'VISION_STATION_RESULT_DURABLE' THEN 'RESULT' WHEN 'VISION_STATION_FAILURE_DURABLE' THEN 'FAILURE' END AS kind FROM envelope")
def router(t: Tables) -> DataFrame:
    e = F.col("event_type")
    target = F.when(e.isin(E.RESULT, E.FAILURE), "terminals").when(e == E.DISCARDED, "images").when(e == E.LOCKED, "products").when(e == E.TIMING, "timings").when(e.isin(*E.GPU), "gpu")
    return t.envelope.select("event_id", target.alias("target"), F.when(e == E.RESULT, "RESULT").when(e == E.FAILURE, "FAILURE").alias("kind"))


TERMINALS = f"""SELECT event_id, json_extract_string(payload_json, '$.session_id') AS session_id, coalesce({P.format('inference_job_id')}, '') AS inference_job_id, CAST(coalesce({P.format('result_revision')}, '1') AS INT) AS revision,
  CASE event_type WHEN 'VISION_STATION_RESULT_DURABLE' THEN 'RESULT' ELSE 'FAILURE' END AS terminal_kind, coalesce({P.format('product_id')}, product_id) AS product_id, CAST(coalesce({P.format('fifo_sequence')}, '0') AS BIGINT) AS fifo_sequence,
  CAST(coalesce({P.format('station_id')}, '0') AS INT) AS station_id, CAST({P.format('verdict')} AS INT) AS verdict, CAST({P.format('score')} AS DOUBLE) AS score, coalesce({P.format('reason')}, '') AS reason
  FROM envelope WHERE event_type IN ('VISION_STATION_RESULT_DURABLE', 'VISION_STATION_FAILURE_DURABLE') AND {GATE}"""


@query("f05_terminal_projection", f"SELECT * FROM ({TERMINALS}) t QUALIFY row_number() OVER (PARTITION BY session_id, inference_job_id, revision, terminal_kind ORDER BY event_id) = 1")
def terminals(t: Tables) -> DataFrame:
    return E.station_terminals(t.envelope)


@query("f06_image_paths", f"""SELECT event_id, session_id, product_id, station_id, file_path FROM (SELECT event_id, json_extract_string(payload_json, '$.session_id') AS session_id, coalesce({P.format('product_id')}, product_id) AS product_id,
  CAST(coalesce({P.format('station_id')}, '0') AS INT) AS station_id, unnest(CAST(json_extract(payload_json, '$.payload.image_paths') AS VARCHAR[])) AS file_path FROM envelope WHERE event_type IN ('VISION_STATION_RESULT_DURABLE', 'VISION_STATION_FAILURE_DURABLE') AND {GATE}) u
  WHERE file_path <> '' QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY event_id) = 1""")
def images(t: Tables) -> DataFrame:
    return E.image_paths(t.envelope)


@query("f07_replay_clamps", "SELECT event_id, CAST(greatest(1, least(CASE WHEN event_id % 1500 = 0 THEN 100 ELSE event_id % 1500 END, 1000)) AS BIGINT) AS page_size FROM events")
def clamps(t: Tables) -> DataFrame:
    return t.events.select("event_id", clamp_limit(F.col("event_id") % 1500).cast("bigint").alias("page_size"))


@query("f08_path_guard", "SELECT artifact_order, file_path, starts_with(file_path, '/data/') AS removable FROM image_artifact")
def path_guard(t: Tables) -> DataFrame:
    return t.image_artifact.select("artifact_order", "file_path", F.col("file_path").startswith("/data/").alias("removable"))


@query("s02_session_filter", "SELECT count(*) AS n FROM envelope WHERE session_id = 's3'")
def session_filter(t: Tables) -> DataFrame:
    return t.envelope.where("session_id = 's3'").agg(F.count(F.lit(1)).alias("n"))


@query("s03_outbox_scan", "SELECT log_id, revision, created_at FROM spool ORDER BY created_at, log_id, revision LIMIT 100")
def outbox(t: Tables) -> DataFrame:
    return t.spool.orderBy("created_at", "log_id", "revision").limit(100).select("log_id", "revision", "created_at")


BATCH = "SELECT batch, list(log_id ORDER BY log_id, revision) AS log_ids, list(revision ORDER BY log_id, revision) AS revisions FROM ack GROUP BY batch"


@query("k02_ack_message", BATCH)
def ack_message(t: Tables) -> DataFrame:
    return E.acknowledged(t.ack)


@query("k03_ack_deletes_outbox", "SELECT log_id, revision FROM spool s WHERE NOT EXISTS (SELECT 1 FROM ack a WHERE a.log_id = s.log_id AND a.revision = s.revision AND trim(a.log_id) <> '' AND a.revision > 0)")
def outbox_after_ack(t: Tables) -> DataFrame:
    return t.spool.join(E.identities(E.acknowledged(t.ack)), ["log_id", "revision"], "left_anti").select("log_id", "revision")


@query("j04_outbox_anti_ack", "SELECT count(*) AS pending FROM spool s WHERE NOT EXISTS (SELECT 1 FROM ack a WHERE a.log_id = s.log_id AND a.revision = s.revision)")
def pending(t: Tables) -> DataFrame:
    return t.spool.join(t.ack, ["log_id", "revision"], "left_anti").agg(F.count(F.lit(1)).alias("pending"))


TRI = "SELECT i.log_id, i.revision, CASE WHEN s.payload_digest IS NULL THEN 'NEW' WHEN s.payload_digest = i.payload_digest THEN 'REPLAY' ELSE 'CONFLICT' END AS state FROM incoming i LEFT JOIN stored s ON s.log_id = i.log_id AND s.revision = i.revision"


@query("j05_digest_tri_state", TRI)
def states(t: Tables) -> DataFrame:
    return E.tri_state(t.incoming, t.stored, ["log_id", "revision"], "payload_digest").select("log_id", "revision", "state")


@query("u01_append_if_absent", f"SELECT state, count(*) AS n FROM ({TRI}) x GROUP BY state UNION ALL SELECT 'STORED' AS state, (SELECT count(*) FROM stored) + (SELECT count(*) FROM ({TRI}) y WHERE state = 'NEW') AS n")
def append(t: Tables) -> DataFrame:
    found = states(t)
    after = t.stored.select("log_id", "revision").unionByName(found.where("state = 'NEW'").select("log_id", "revision"))
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("n")).unionByName(after.agg(F.lit("STORED").alias("state"), F.count(F.lit(1)).alias("n")))


@query("u02_insert_or_ignore", "SELECT session_id, capture_id, station_id, event_id FROM (SELECT event_id, session_id, 'cap-' || CAST(event_id % 900 AS VARCHAR) AS capture_id, 1 + event_id % 2 AS station_id FROM envelope) e QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY event_id) = 1")
def ignore(t: Tables) -> DataFrame:
    rows = t.envelope.select("event_id", "session_id", F.concat(F.lit("cap-"), (F.col("event_id") % 900).cast("string")).alias("capture_id"), (1 + F.col("event_id") % 2).alias("station_id"))
    return E.first_wins(rows, ["capture_id"], ["event_id"])


TIMING = f"""SELECT event_id, json_extract_string(payload_json, '$.session_id') AS session_id, {P.format('capture_id')} AS capture_id, CAST({P.format('capture_and_save_ms')} AS DOUBLE) AS capture_and_save_ms, CAST({P.format('validation_ms')} AS DOUBLE) AS validation_ms,
  CAST({P.format('capture_timeout_candidate_ms')} AS DOUBLE) AS timeout_candidate_ms FROM envelope WHERE event_type = 'VISION_CAPTURE_TIMING' AND {GATE}"""


@query("u03_insert_or_replace", f"SELECT * FROM ({TIMING}) t QUALIFY row_number() OVER (PARTITION BY session_id, capture_id ORDER BY event_id DESC) = 1")
def replace(t: Tables) -> DataFrame:
    rows = E.projectable(t.envelope.where(F.col("event_type") == E.TIMING)).select(
        "event_id", "session_id", E.field("capture_id", default="").alias("capture_id"), *[E.field(a, "double", 0.0).alias(b) for a, b in (("capture_and_save_ms", "capture_and_save_ms"), ("validation_ms", "validation_ms"), ("capture_timeout_candidate_ms", "timeout_candidate_ms"))]
    )
    return E.last_wins(rows, ["session_id", "capture_id"], "event_id")


@query("u04_on_conflict_update", f"SELECT session_id, product_id, CAST({P.format('fifo_sequence')} AS BIGINT) AS fifo_sequence, {P.format('reason')} AS reason FROM (SELECT *, json_extract_string(payload_json, '$.session_id') AS sid FROM envelope WHERE event_type = 'PRODUCT_RESULT_LOCKED' AND {GATE}) e QUALIFY row_number() OVER (PARTITION BY sid, product_id ORDER BY event_id DESC) = 1")
def upsert(t: Tables) -> DataFrame:
    rows = E.projectable(t.envelope.where(F.col("event_type") == E.LOCKED)).select("event_id", "session_id", "product_id", E.field("fifo_sequence", "bigint", 0).alias("fifo_sequence"), E.field("reason", default="").alias("reason"))
    return E.last_wins(rows, ["session_id", "product_id"], "event_id").drop("event_id")


@query("u05_guarded_upsert", """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS n FROM gpu_snapshot),
fold AS (SELECT session_id, n, sample_count, normal_shutdown, mean_vram_used_mib FROM numbered WHERE n = 1 UNION ALL
  SELECT f.session_id, x.n, CASE WHEN x.sample_count >= f.sample_count AND (NOT f.normal_shutdown OR x.normal_shutdown) THEN x.sample_count ELSE f.sample_count END, CASE WHEN x.sample_count >= f.sample_count AND (NOT f.normal_shutdown OR x.normal_shutdown) THEN x.normal_shutdown ELSE f.normal_shutdown END,
    CASE WHEN x.sample_count >= f.sample_count AND (NOT f.normal_shutdown OR x.normal_shutdown) THEN x.mean_vram_used_mib ELSE f.mean_vram_used_mib END FROM fold f JOIN numbered x ON x.session_id = f.session_id AND x.n = f.n + 1)
SELECT session_id, sample_count, normal_shutdown, mean_vram_used_mib FROM fold QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1""")
def guarded(t: Tables) -> DataFrame:
    """Snapshots fold in order of arrival: taken if no smaller and if a normal shutdown isn't undone.

    Until a normal shutdown comes, the state is the latest snapshot that reaches the running maximum; from the first accepted normal one on,
    only normal ones count. Both are window maxima, so nothing is folded row by row.
    """
    w = W.partitionBy("session_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    rows = t.gpu_snapshot
    before = rows.withColumn("top", F.max("sample_count").over(w)).withColumn("reaches", F.coalesce(F.col("sample_count") >= F.col("top"), F.lit(True)))
    # while none was normal, acceptance is exactly reaching the maximum of all before
    normal_first = before.withColumn("starts", F.col("reaches") & F.col("normal_shutdown"))
    since = normal_first.withColumn("sticky", F.max("starts").over(w))
    open_ = since.where(~F.coalesce("sticky", F.lit(False)) & F.col("reaches"))
    start = since.where("starts").groupBy("session_id").agg(F.min("arrival").alias("from"))
    after = rows.where("normal_shutdown").join(start, "session_id").where(F.col("arrival") >= F.col("from")).drop("from")
    taken = after.withColumn("top", F.max("sample_count").over(w)).where(F.col("top").isNull() | (F.col("sample_count") >= F.col("top")))
    every = open_.select(*rows.columns).unionByName(taken.select(*rows.columns))
    return E.last_wins(every, ["session_id"], "arrival").drop("arrival")


@query("u06_delete_by_key", "SELECT count(*) AS kept FROM image_artifact WHERE file_path NOT IN (SELECT file_path FROM image_artifact WHERE artifact_order % 5 = 0)")
def delete(t: Tables) -> DataFrame:
    gone = t.image_artifact.where("artifact_order % 5 = 0").select("file_path")
    return t.image_artifact.join(gone, "file_path", "left_anti").agg(F.count(F.lit(1)).alias("kept"))


@query("u07_castable_before_store", f"SELECT event_id, TRY_CAST({P.format('station_id')} AS INT) IS NOT NULL OR {P.format('station_id')} IS NULL AS storable FROM envelope WHERE {GATE} AND event_type <> 'PRODUCT_RESULT_LOCKED'")
def castable(t: Tables) -> DataFrame:
    """A payload value that can't be cast refuses the event too, so casts are tried before anything is written."""
    rows = E.projectable(t.envelope.where(F.col("event_type") != E.LOCKED))
    ok = lambda name, kind: E.field(name).isNull() | E.field(name, kind).isNotNull()
    return rows.select("event_id", ok("station_id", "int").alias("storable"))


@query("c02_digest_functions", "SELECT event_id, sha256(props) AS digest, regexp_matches(sha256(props), '^[0-9a-f]{64}$') AS is_hex FROM events")
def digests(t: Tables) -> DataFrame:
    return t.events.select("event_id", sha256_text(F.col("props")).alias("digest"), is_sha256_hex(sha256_text(F.col("props"))).alias("is_hex"))


@query("c05_identifier_checks", "SELECT command_no, regexp_matches(command_id, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS uuid4, regexp_matches(payload_digest, '^[0-9a-f]{64}$') AS hex64 FROM command")
def identifiers(t: Tables) -> DataFrame:
    return t.command.select("command_no", is_uuid4(F.col("command_id")).alias("uuid4"), is_sha256_hex(F.col("payload_digest")).alias("hex64"))
