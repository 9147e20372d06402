"""The corpus pipeline: bad texts, near duplicates and benchmark passages go; personal data is replaced; what stays is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the columns of documents; other
columns of ``docs`` don't go on. Rows of one id, or of none, are judged and packed each on its own. Null texts count as empty: such rows
stand by the classifier's score of the empty text, are copies of nothing, hold no item, and are packed as the end id alone. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, packing, pii, quality
from millrace.llm.common import fold_of, forget, materialise, with_row_key, without_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold. The model learns from the labelled rows outside fold 0 of 5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels, fold_of(F.col("doc_id"), 5) != 0)
    return _documents(quality.score(spark, docs, model, "quality_score").where(F.col("quality_score") >= quality.THRESHOLD))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, and one of its rows if several have that id; null ids come last.
    Every row counts on its own, whatever its id. Texts without words are in no group and stay."""
    keyed = with_row_key(docs, "row_key")
    found = materialise(jaccard_join.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text")))
    copies = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("row_key"))
    return _documents(without_ids(keyed, "row_key", copies))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; each is judged by its own text."""
    return _documents(decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms; n_chars is that of the new text."""
    return _documents(pii.pseudonymise(docs, pii.DEMO_KEY).withColumn("n_chars", F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark passages", drop_benchmark_passages),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Neither the classifier nor the tokenizer can be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to shared storage and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
