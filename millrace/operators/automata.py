"""Finite machines over ordered rows, a key's rows in as many tasks as there are.

Rows are dealt by ranges of (key, order), so a long key lies in several partitions. Within one, a key that begins there is followed state by state. The
first key may have begun in an earlier partition: of its rows it is only known which state each possible state has become, a map. Maps compose,
and those that occur are few, so each row is one lookup of (map, symbol). A row for each partition then tells where its first key
really stood, and the maps are read there. Nothing is gathered by key, and the states come out as if one task had read all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import stored


def explored(first: Hashable, symbols: list, step: Callable) -> tuple[list, list[list[int]]]:
    """States that can be reached from ``first`` and, for each symbol, the number of the state after each; ``step(state, symbol)`` gives the next one."""
    states, number, after = [first], {first: 0}, []
    for state in states:  # grows while it is read
        row = []
        for symbol in symbols:
            reached = step(state, symbol)
            if reached not in number:
                number[reached] = len(states)
                states.append(reached)
            row.append(number[reached])
        after.append(row)
    return states, [[row[i] for row in after] for i in range(len(symbols))]


class Maps:
    """Maps from state to state that arise by composing those of the symbols, by number; 0 changes nothing."""

    def __init__(self, table: list[list[int]]) -> None:
        self.table = table
        self.maps = [tuple(range(len(table[0])))]
        self.number = {self.maps[0]: 0}
        self.known: dict[tuple[int, int], int] = {}

    def then(self, number: int, symbol: int) -> int:
        found = self.known.get((number, symbol))
        if found is None:
            composed = tuple(self.table[symbol][s] for s in self.maps[number])
            if composed not in self.number:
                self.number[composed] = len(self.maps)
                self.maps.append(composed)
            found = self.known[number, symbol] = self.number[composed]
        return found


_UNSET = object()


def _follow(names: list[str], key: str, symbol: str, table: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, maps, at = TaskContext.get().partitionId(), Maps(table), 0
        current, carried, place, state = _UNSET, True, 0, 0
        for batch in batches:
            before, become = [], []
            for k, s in zip(batch.column(key).to_pylist(), batch.column(symbol).to_pylist(), strict=True):
                if k != current or current is _UNSET:
                    carried = current is _UNSET
                    current, state = k, 0
                if carried:
                    before.append(None)
                    become.append(maps.maps[place])
                    place = maps.then(place, s)
                else:
                    before.append(state)
                    become.append(None)
                    state = table[s][state]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(before, pa.int16()), pa.array(become, pa.list_(pa.int16()))], names=names)
            at += n

    return run


def _starts(ends: list, table: list[list[int]]) -> list[tuple[int, int]]:
    """(part, state) of the first key of each partition. ``ends``: a row for each partition, in order."""
    out, last_key, state = [], _UNSET, 0
    for r in ends:
        start = state if r["first_key"] == last_key else 0
        out.append((r["part"], start))
        before = r["last"]["before"] if r["last"]["before"] is not None else r["last"]["become"][start]
        last_key, state = r["last"]["key"], table[r["last"]["symbol"]][before]
    return out


def states_before(rows: DataFrame, key: str, order: str, symbol: str, table: list[list[int]], column: str = "state") -> DataFrame:
    """``rows`` with the number of the state in which each row finds its key's machine. Every key starts in state 0.

    ``table[symbol][state]`` is the next state; ``symbol`` is an int column without nulls, ``order`` has no ties within a key. A null key is a key.
    """
    names = [*rows.columns, "__part", "__at", "__before", "__become"]
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__before", T.ShortType()), T.StructField("__become", T.ArrayType(T.ShortType()))])
    followed = stored(rows.repartitionByRange(key, order).sortWithinPartitions(key, order).mapInArrow(_follow(names, key, symbol, table), schema))
    ends = followed.groupBy(F.col("__part").alias("part")).agg(
        F.min_by(F.col(key), "__at").alias("first_key"), F.max_by(F.struct(F.col(key).alias("key"), F.col(symbol).alias("symbol"), F.col("__before").alias("before"), F.col("__become").alias("become")), "__at").alias("last")
    )
    starts = _starts(sorted(ends.collect()), table)  # a row for each partition of the range
    known = followed.sparkSession.createDataFrame(starts, "__part int, __start int")
    told = followed.join(F.broadcast(known), "__part", "left")
    return told.withColumn(column, F.coalesce("__before", F.element_at("__become", F.col("__start") + 1)).cast("int")).select(*rows.columns, column)


def numbered(values: list) -> dict[Hashable, int]:
    return {v: i for i, v in enumerate(values)}
