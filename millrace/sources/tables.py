"""Input tables: Parquet files or folders by name, read by Spark alone."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Tables of one folder, and the derived inputs of ``fixtures``, as attributes: ``Tables(spark, folder).events``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in NAMES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                from .fixtures import FIXTURES, needs, spark_text

                if name not in FIXTURES:
                    raise AttributeError(name)
                inputs = {n: getattr(self, n) for n in needs(FIXTURES[name])}
                text = spark_text(FIXTURES[name])
                self._made[name] = self.spark.sql(text, **inputs)
        return self._made[name]

    @cached_property
    def timed_events(self) -> DataFrame:
        """Events with a timestamp that watermarks accept (the files hold one without time zone)."""
        return self.events.withColumn("ts", F.col("ts").cast("timestamp"))
