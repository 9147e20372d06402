"""Durable append of a stream of events: judged, committed, and only then acknowledged.

A micro-batch is written under its number: first every row with its verdict, then the new events, and when they stand, the acknowledgements. Each
of the three replaces what an earlier try of the same batch left, and a batch is held against the events of earlier batches alone. So a run
that dies anywhere, between commit and acknowledgement too, is repeated with the same outcome: nothing is stored twice, and nothing is
acknowledged that isn't stored.

Only the keys of a batch are looked up in the stored events; where they are few, the store is read without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import tri_state, with_reject_reason

KEYS, DIGEST, ARRIVAL = ["log_id", "revision"], "payload_digest", "arrival"
EVENTS, VERDICTS, ACKS = "events", "verdicts", "acks"


def _fields(part: str, schema: T.StructType) -> T.StructType:
    """Columns of one of the three tables. ``schema``: that of the stream."""
    more = {EVENTS: (), VERDICTS: ("reject_reason", "state"), ACKS: ("state",)}[part]
    own = schema.fields if part != ACKS else [schema[n] for n in (ARRIVAL, *KEYS)]
    return T.StructType([*own, *(T.StructField(n, T.StringType()) for n in more)])


def committed(spark: SparkSession, folder: str, part: str, schema: T.StructType) -> DataFrame:
    """Rows of one of the three tables, with the number of their batch."""
    return spark.read.schema(T.StructType([*_fields(part, schema), T.StructField("batch_id", T.LongType())])).parquet(f"{folder}/{part}")


def _replace(rows: DataFrame, folder: str, part: str, number: int) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{part}/batch_id={number}")


def judge(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``batch`` with reject_reason and state: REJECTED by a rule of the envelope, else NEW, REPLAY or CONFLICT in the order of arrival."""
    checked = with_reject_reason(batch)
    known = stored.join(batch.select(*KEYS).distinct(), KEYS, "left_semi")
    fine = tri_state(checked.where("reject_reason IS NULL"), known, KEYS, DIGEST, [ARRIVAL])
    return fine.unionByName(checked.where("reject_reason IS NOT NULL").withColumn("state", F.lit("REJECTED")))


def commit(batch: DataFrame, number: int, folder: str) -> None:
    """One micro-batch: verdicts, events, acknowledgements, in this order."""
    spark, schema = batch.sparkSession, batch.schema
    _replace(judge(batch, committed(spark, folder, EVENTS, schema).where(F.col("batch_id") < number)), folder, VERDICTS, number)
    verdicts = committed(spark, folder, VERDICTS, schema).where(F.col("batch_id") == number)
    _replace(verdicts.where("state = 'NEW'").select(*schema.names), folder, EVENTS, number)
    acknowledge(verdicts, folder, number)


def acknowledge(verdicts: DataFrame, folder: str, number: int) -> None:
    """New events and repeats of stored ones are acknowledged; conflicts and rejected ones never."""
    _replace(verdicts.where(F.col("state").isin("NEW", "REPLAY")).select(ARRIVAL, *KEYS, "state"), folder, ACKS, number)


def prepare(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Empty tables, so that the first batch finds a store to read; what is there stays."""
    for part in (EVENTS, VERDICTS, ACKS):
        spark.createDataFrame([], _fields(part, schema)).write.mode("ignore").parquet(f"{folder}/{part}/batch_id=-1")


def run_to_end(spark: SparkSession, source: str, folder: str, schema: T.StructType, files: int = 1000) -> None:
    """All that has arrived under ``source`` since the last run goes through ``commit``, ``files`` files a batch; progress is kept under ``folder``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: commit(batch, number, folder)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
