"""Sharding by best-fit-decreasing bin packing.

Rows of one group (equal texts) stay together. Groups, the largest first, go where they leave the least room: a balanced
search tree over the bins' remaining capacities gives the tightest bin that still fits. ``pack`` uses as few bins of a fixed
capacity as this rule finds; ``level`` searches the least capacity for a fixed number of bins, so that they come out nearly equal.

The driver never sees all groups. Only groups of at least ``1 / (shards * grain)`` of all bytes are items of their own
(no more than ``shards * grain`` can be); the others are summed into ``shards * grain`` hash buckets, which are items too. So a plan has at
most ``2 * shards * grain`` items at any size of input, and every group still lands in one shard whole.

Null texts are one group, empty texts another; each row counts its UTF-8 bytes plus 8. Repeated rows each get a slot of their own.
A group larger than an equal share takes a shard alone, and the rest is levelled over the other shards.
Only doc_id and text are read; other columns, whatever their names, don't go on. An empty table gives an empty one; null ids pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialise

SHARDS, GRAIN, ROW_BYTES = 24, 512, 8


class RoomTree:
    """Treap over (room, bin): insert, remove, and the least entry with at least a given room, in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.seed = 0x2545F491

    def _priority(self) -> int:
        self.seed ^= (self.seed << 13) & 0xFFFFFFFF
        self.seed ^= self.seed >> 17
        self.seed ^= (self.seed << 5) & 0xFFFFFFFF
        return self.seed

    def _split(self, node: list | None, key: tuple) -> tuple:
        """Entries below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(), None, None]), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found


def pack(items: Iterable[tuple[int, str]], capacity: int) -> tuple[dict[str, int], list[int]]:
    """Bin of each named item and the load of each bin. Larger items first, ties by name; a larger item than the capacity gets a bin of its own."""
    tree, where, loads = RoomTree(), {}, []
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        spot = tree.tightest(size)
        if spot is None:
            number, room = len(loads), max(capacity, size)
            loads.append(0)
        else:
            room, number = spot
            tree.remove(spot)
        loads[number] += size
        where[name] = number
        tree.insert((room - size, number))
    return where, loads


def level(items: list[tuple[int, str]], bins: int) -> dict[str, int]:
    """Bin of each item, with the least capacity for which ``pack`` needs no more than ``bins``."""
    rest = sorted(items, key=lambda x: (-x[0], x[1]))
    where: dict[str, int] = {}
    alone = 0
    total = sum(s for s, _ in rest)
    while rest and bins - alone > 1 and rest[0][0] * (bins - alone) >= total:
        size, name = rest.pop(0)
        where[name] = alone
        total -= size
        alone += 1
    if rest:
        left = bins - alone
        low = max(rest[0][0], -(-total // left))
        high, best = low, None
        while best is None:
            got, loads = pack(rest, high)
            if len(loads) <= left:
                best = got
            else:
                low, high = high + 1, high + max(1, high // 64)
        while low < high:
            middle = (low + high) // 2
            got, loads = pack(rest, middle)
            if len(loads) <= left:
                best, high = got, middle
            else:
                low = middle + 1
        where |= {name: alone + n for name, n in best.items()}
    return where


def shard(docs: DataFrame, shards: int = SHARDS, *, grain: int = GRAIN, slot_rows: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("group"),
        )
    )
    buckets = shards * grain
    bucket = F.concat(F.lit("bucket "), F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("string"))
    groups = materialise(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes").alias("t")).first()["t"] or 0
    heavy = F.col("bytes") * buckets >= max(total, 1)  # at most ``buckets`` groups
    items = groups.groupBy(F.when(heavy, F.col("group")).otherwise(bucket).alias("item")).agg(F.sum("bytes").alias("bytes")).collect()
    where = level([(r["bytes"], r["item"]) for r in items], shards)
    # at most 2 * shards * grain short rows
    plan = F.broadcast(spark.createDataFrame(list(where.items()), T.StructType([T.StructField("item", T.StringType()), T.StructField("shard", T.IntegerType())])))
    own = plan.select(F.col("item").alias("group"), F.col("shard").alias("own"))
    shared = plan.select("item", F.col("shard").alias("shared"))
    placed = rows.withColumn("item", bucket).join(own, "group", "left").join(shared, "item", "left")
    lanes = max(16, math.ceil(rows.count() / slot_rows))
    placed = placed.select("row", "doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int").alias("lane"))
    counts = placed.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("shard"), F.col("lane"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = placed.withColumn("at", F.row_number().over(W.partitionBy("shard", "lane").orderBy("row")) - 1)
    return ranked.join(starts, ["shard", "lane"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def op10_shard_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, over 24 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
