"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins on the edges, written to shared storage. Edges are first contracted within each
partition, so that a large group arrives as stars. A node with very many edges is one key of a join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

MAX_ROUNDS = 60


class Forest:
    """Union-find in which the least member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while (y := self.up.get(x, x)) != root:
            self.up[x] = root
            x = y
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the components of a part of the edges; at most ``LIMIT`` nodes are held at a time."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        nodes = [x for x in list(forest.up) if forest.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.up) > LIMIT:
            yield stars()
            forest = Forest()
    yield stars()


#: Nodes that the contraction of a partition holds at a time.
LIMIT = 1_000_000


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars already: no node has two roots, and no root has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of an edge (columns a, b, long); the component is its least node. Loops and repeated edges don't matter.
    Without edges there are no nodes."""
    clean = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    now = materialise(clean.mapInArrow(_contract, "u long, v long").distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are shuffles, of which Spark may split a hot node's
        least = materialise(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        after = large.join(small, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(after)
        for done in (least, large, small, now):
            forget(done)
        now = after
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
