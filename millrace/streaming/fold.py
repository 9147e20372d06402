"""Ordered folds over keyed events, in batch and in Structured Streaming, with the same state machines.

Lateness is a matter of state here, not of time: a watermark would drop rows that have to be classified. The state of a key is
one string in the state store; it is bounded by the machines' own capacities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _run(machine, rows: pd.DataFrame, arrival: str) -> pd.DataFrame:  # noqa: ANN001
    rows = rows.sort_values(arrival, kind="stable")
    out = [machine.take(r) for r in rows.astype(object).where(rows.notna(), None).to_dict("records")]
    for i, name in enumerate(machine.columns):
        rows[name] = [x[i] for x in out]
    return rows


def output_schema(rows: DataFrame, kind: type, types: dict[str, T.DataType] | None = None) -> T.StructType:
    kinds = types or {}
    return T.StructType([*rows.schema.fields, *[T.StructField(n, kinds.get(n, T.StringType())) for n in kind.columns]])


def fold(rows: DataFrame, key: str, arrival: str, kind: type, types: dict[str, T.DataType] | None = None, **options: object) -> DataFrame:
    """``rows`` with the machine's columns, each key's rows taken in the order of arrival."""
    schema = output_schema(rows, kind, types)
    return rows.groupBy(key).applyInPandas(lambda g: _run(kind(None, **options), g, arrival)[schema.names], schema)


def fold_stream(rows: DataFrame, key: str, arrival: str, kind: type, types: dict[str, T.DataType] | None = None, **options: object) -> DataFrame:
    """The same over a stream: each micro-batch continues from the key's saved state."""
    schema = output_schema(rows, kind, types)

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = kind(state.get[0] if state.exists else None, **options)
        batch = pd.concat(list(frames), ignore_index=True)  # a micro-batch of one key; the source bounds it
        out = _run(machine, batch, arrival)
        state.update((machine.saved(),))
        yield out[schema.names]

    return rows.groupBy(key).applyInPandasWithState(step, schema, T.StructType([T.StructField("state", T.StringType())]), "append", GroupStateTimeout.NoTimeout)


def replay(source: DataFrame, sink: str, folder: str, transform: Callable[[DataFrame], DataFrame], schema: T.StructType, mode: str = "append") -> DataFrame:
    """Run a stream over the files of ``folder`` to its end and return what it wrote to ``sink``."""
    spark = source.sparkSession
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)
