"""Exact top-k inner products by KD-trees, one tree for each shard of the vectors.

Vectors are turned into integers and dealt into cells by the median splits of a bounded sample (``SAMPLE`` rows), at most ``CELLS`` of them; each cell's tight
bounding box goes to all tasks. A cell of more than ``SHARD_ROWS`` rows is dealt further into shards by hash. A shard's tree is built once,
by median splits of the widest dimension with a tight box for each node, and stored.

The best score that a query can reach in a box is ``sum(max(q * low, q * high))``. A query first searches one shard of its own cell; its kth
score there goes along to the shards of all cells whose bound reaches it, and to no others. In a shard, nodes are opened from the root while
their bound reaches the kth score so far, and leaves are visited in the order of their bounds, best first; a query stops at the first leaf below its kth score.

A task reads a shard's tree and then streams the queries that come to it through it, in blocks. Where more than ``TASK_QUERIES`` queries may come to a shard, they are
dealt into several tasks, and the tree goes to those that have some.

Scores are exact: in double precision where no sum can reach 2**53, in 64-bit integers where none can reach 2**63, else in whole numbers of any size; a
score that a long can't hold is an error, as is a component of 2**62 or more.

Vectors that are null, hold null or non-finite components or have another length than the queries take no part, nor do rows with a null
id. A query's own row and other rows of its id are no candidates for it. Of several rows with a query's id, the least vector
asks. Rows with equal ids, and repeated rows, are candidates each on their own. Ties go to the smaller id. Vectors of other lengths than the most frequent one are dealt by
hash alone. Without vectors or queries the result is empty. Other columns don't go on.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, materialise

SHARD_ROWS, BLOCK_QUERIES, LEAF, CELLS, SAMPLE, TASK_QUERIES = 4096, 1024, 256, 256, 8192, 4096
NONE = np.iinfo(np.int64).min


class KDTree:
    """Tree over the rows of an integer matrix, as arrays; node 0 is the root."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = 0) -> None:
        leaf = leaf or LEAF
        order = np.arange(len(rows))
        low, high, self.child, self.span = [], [], [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            part = rows[order[start:end]]
            node = len(low)
            low.append(part.min(0))
            high.append(part.max(0))
            self.span.append((start, end))
            self.child.append([-1, -1])
            if parent >= 0:
                self.child[parent][side] = node
            wide = high[-1].astype(float) - low[-1]
            widest = int(np.argmax(wide))
            if end - start > leaf and wide[widest] > 0:
                middle = (end - start) // 2
                split = np.argpartition(part[:, widest], middle)
                order[start:end] = order[start:end][split]
                todo += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.low, self.high = np.array(low, float), np.array(high, float)
        self.most = int(max(self.high[0].max(), -self.low[0].min())) if rows.size else 0
        least = next((k for k in (np.int16, np.int32) if self.most < np.iinfo(k).max), np.int64)
        self.rows, self.ids = rows[order].astype(least), ids[order]


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The best score that each query can reach in each box, rounded up where sums may not be exact."""
    q = queries.astype(float)
    best = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    room = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
    return best + np.where(room < 2**53, 0.0, room * 1e-12)


def reach(floor: np.ndarray) -> np.ndarray:
    """Floors as numbers to hold bounds against; -inf where there is none."""
    return np.where(floor == NONE, -np.inf, np.nextafter(floor.astype(float), -np.inf))


def products(queries: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products; ``most`` bounds their size."""
    if most < 1 << 53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return queries @ rows.astype(np.int64).T
    whole = queries.astype(object) @ rows.T.astype(object)
    if whole.size and (whole.max() >= 1 << 63 or whole.min() <= NONE):
        raise OverflowError("an inner product needs more than 64 bits")
    return whole.astype(np.int64)


def leaves(tree: KDTree, queries: np.ndarray, floor: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Leaves that some query may need and their bounds; a node that no query needs is not opened."""
    level, found, told = [0], [], []
    while level:
        b = bounds(queries, tree.low[level], tree.high[level])
        live = (b >= floor[:, None]).any(0)
        after = []
        for j in np.flatnonzero(live):
            node = level[j]
            if tree.child[node][0] < 0:
                found.append(node)
                told.append(b[:, j])
            else:
                after += tree.child[node]
        level = after
    return found, np.array(told).T.reshape(len(queries), len(found))


def search(tree: KDTree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number of the query, id and score of the k best of each query whose score is at least its floor; fewer if there are no more."""
    n = len(queries)
    most = int(np.abs(queries).max(initial=0)) * tree.most * queries.shape[1]
    best_score = np.full((n, k), NONE)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    floor = floor.copy()
    found, told = leaves(tree, queries, reach(floor))
    turn = np.argsort(-told, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(len(found)):
        leaf_of = turn[active, step]
        go = told[active, leaf_of] >= reach(floor[active])
        active, leaf_of = active[go], leaf_of[go]
        if not len(active):
            break
        for leaf in np.unique(leaf_of):
            who = active[leaf_of == leaf]
            start, end = tree.span[found[leaf]]
            scores = products(queries[who], tree.rows[start:end], most)
            out = (query_ids[who][:, None] == tree.ids[None, start:end]) | (scores < floor[who][:, None])
            scores[out] = NONE
            hot = np.flatnonzero(~out.all(1))
            if not len(hot):
                continue
            who, scores = who[hot], scores[hot]
            names = np.broadcast_to(tree.ids[start:end], scores.shape)
            if scores.shape[1] > k:  # what ties with the kth stays in until ids are compared
                kth = np.partition(scores, -k, axis=1)[:, -k]
                wide = min(int((scores >= kth[:, None]).sum(1).max()), scores.shape[1])
                pick = np.argsort(scores, axis=1, kind="stable")[:, ::-1][:, :wide] if wide > 4 * k else np.argpartition(scores, -wide, axis=1)[:, -wide:]
                scores, names = np.take_along_axis(scores, pick, 1), np.take_along_axis(names, pick, 1)
            both = np.concatenate([best_score[who], scores], 1)
            named = np.where(both == NONE, np.iinfo(np.int64).max, np.concatenate([best_id[who], names], 1))
            rank = np.lexsort((named, -np.maximum(both, NONE + 1)), axis=1)[:, :k]
            best_score[who] = np.take_along_axis(both, rank, 1)
            best_id[who] = np.take_along_axis(named, rank, 1)
            floor[who] = np.maximum(floor[who], best_score[who, -1])
    q, r = np.nonzero(best_score > NONE)
    return q, best_id[q, r], best_score[q, r]


# ---------------------------------------------------------------- cells and shards


class Cells:
    """Median splits of a sample: rows of an integer matrix -> numbers of cells. ``boxes`` and ``shards`` come when the cells are known."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.width = sample.shape[1]
        self.dim, self.cut, self.child = [0], [0], [[-1, -1]]
        parts = [(len(sample), 0, sample)]
        while parts and len(parts) < cells:
            parts.sort(key=lambda x: -x[0])
            size, node, rows = parts[0]
            wide = rows.max(0).astype(float) - rows.min(0) if size else np.zeros(self.width)
            d = int(np.argmax(wide)) if self.width else 0
            if size < 2 or wide[d] <= 0:
                parts[0] = (0, node, rows)  # all rows equal: not to be split
                if parts[0][0] == max(x[0] for x in parts):
                    break
                continue
            cut = int(np.sort(rows[:, d])[size // 2])
            if cut == rows[:, d].min():
                cut += 1
            left = rows[:, d] < cut
            self.dim[node], self.cut[node] = d, cut
            for side, mask in ((0, left), (1, ~left)):
                self.child[node][side] = len(self.dim)
                self.dim.append(0)
                self.cut.append(0)
                self.child.append([-1, -1])
                parts.append((int(mask.sum()), self.child[node][side], rows[mask]))
            parts.pop(0)
        self.leaves = np.array(sorted(node for _, node, _ in parts))
        self.low = self.high = np.zeros((0, self.width))
        self.numbers = np.zeros(0, int)
        self.shards: dict[int, int] = {}

    def of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), int)
        child, dim, cut = np.array(self.child), np.array(self.dim), np.array(self.cut)
        while len(who := np.flatnonzero(child[node, 0] >= 0)):
            at = node[who]
            node[who] = child[at, (rows[who, dim[at]] >= cut[at]).astype(int)]
        return np.searchsorted(self.leaves, node)


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each width in a column of lists, and their matrix."""
    sizes = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
    for width in np.unique(sizes):
        who = np.flatnonzero(sizes == width)
        yield who, flat[(ends[who] - width)[:, None] + np.arange(width)]


KEY = "width int, cell int, shard int"
_ASK = f"{KEY}, query_id long, v binary, kth long, tree binary"


def _batch(key: tuple, who: list | np.ndarray, rows: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
    n = len(who)
    return pa.RecordBatch.from_arrays([*(pa.array(np.broadcast_to(x, n).astype(np.int32)) for x in key), pa.array(who, pa.int64()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary()), pa.array(kth, pa.int64()), pa.nulls(n, pa.binary())], names=[x.split()[0] for x in _ASK.split(", ")])


def _place(cells: Cells | None):  # noqa: ANN202
    """vec_id, v -> width, cell, row, vec_id, v: ``row`` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for who, rows in _matrices(batch.column(1)):
                own = cells is not None and rows.shape[1] == cells.width
                cell = cells.of(rows) if own else np.full(len(who), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), rows.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(made + np.arange(len(who))), pa.array(ids[who]), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], names=["width", "cell", "row", "vec_id", "v"])
                made += len(who)

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """width, cell, v -> cell, n, low, high of a partition's rows of each cell."""
    held: dict[int, list] = {}
    for batch in batches:
        cells = batch.column(1).to_numpy()
        for c in np.unique(cells):
            who = np.flatnonzero(cells == c)
            rows = np.stack([np.frombuffer(x, "<i8") for x in batch.column(2).take(pa.array(who)).to_pylist()])
            n, low, high = held.get(c, (0, rows[0], rows[0]))
            held[c] = [n + len(rows), np.minimum(low, rows.min(0)), np.maximum(high, rows.max(0))]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), *(pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.int64())) for i in (1, 2))], names=["cell", "n", "low", "high"])


def _trees(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's rows -> its tree as one row."""
    tree = KDTree(np.stack([np.frombuffer(x, "<i8") for x in rows["v"]]), rows["vec_id"].to_numpy(np.int64))
    return pd.DataFrame({**{c: rows[c].iloc[:1] for c in ("width", "cell", "shard")}, "query_id": [0], "v": [b""], "kth": [NONE], "tree": [pickle.dumps(tree, protocol=5)]})


def _stream(k: int, block: int):  # noqa: ANN202
    """Rows sorted by shard, its tree first: the queries of each shard go through its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2, 7)], 1)  # shard and block
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if tuple(keys[low]) != key:
                    key, tree = tuple(keys[low]), None
                if batch.column(6)[low].is_valid:
                    tree = pickle.loads(batch.column(6)[low].as_py())  # noqa: S301  written by _trees
                    low += 1
                if tree is None:
                    continue  # no vector has the queries' width
                for at in range(low, high, block):
                    part = batch.slice(at, min(block, high - at))
                    rows, ids = np.stack([np.frombuffer(x, "<i8") for x in part.column(4).to_pylist()]), part.column(3).to_numpy()
                    q, found, scores = search(tree, rows, ids, part.column(5).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def _home(cells: Cells | None, others: int):  # noqa: ANN202
    """query_id, v -> the query at one shard of its own cell; where that has no rows, of the cell with the greatest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for who, rows in _matrices(batch.column(1)):
                if cells is not None and rows.shape[1] == cells.width and len(cells.numbers):
                    cell = cells.of(rows)
                    empty = ~np.isin(cell, cells.numbers)
                    cell[empty] = cells.numbers[bounds(rows[empty], cells.low, cells.high).argmax(1)]
                    count = np.array([cells.shards[c] for c in cell.tolist()])
                else:
                    cell, count = np.full(len(who), -1), np.full(len(who), others)
                yield _batch((rows.shape[1], cell, ids[who] % count), ids[who], rows, np.full(len(who), NONE))

    return run


def _elsewhere(cells: Cells | None, others: int):  # noqa: ANN202
    """Queries with their homes and kth scores -> a row for every other shard that the query may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, cell, shard, ids = (batch.column(i).to_numpy() for i in range(4))
            kth = batch.column(5).to_numpy()
            for w in np.unique(width):
                who = np.flatnonzero(width == w)
                rows = np.stack([np.frombuffer(x, "<i8") for x in batch.column(4).take(pa.array(who)).to_pylist()])
                if cells is not None and w == cells.width and len(cells.numbers):
                    needs, places = bounds(rows, cells.low, cells.high) >= reach(kth[who])[:, None], [(i, c, s) for i, c in enumerate(cells.numbers.tolist()) for s in range(cells.shards[c])]
                else:
                    needs, places = np.ones((len(who), 1), bool), [(0, -1, s) for s in range(others)]
                for i, c, s in places:
                    go = needs[:, i] & ~((cell[who] == c) & (shard[who] == s))
                    if go.any():
                        yield _batch((w, c, s), ids[who[go]], rows[go], kth[who[go]])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, task_queries: int = TASK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best inner products of each query.

    ``vectors``: vec_id long, v array of long; ``queries``: query_id long, v array of long, each id once.
    """
    vectors = vectors.select("vec_id", "v").where(F.size("v") > 0)
    widths = vectors.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    sizes = widths.agg(F.sum("n").alias("all"), F.max(F.struct("n", "width")).alias("main")).first()
    cells, others = None, 1
    if sizes["all"]:
        main = sizes["main"]["width"]
        # rows below an even hash; repeated rows share it and count once
        own = vectors.where(F.size("v") == main).select("v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)).alias("h"))
        bound = min(1 << 40, (SAMPLE << 40) // sizes["main"]["n"] + 1)
        sample = [r["v"] for r in own.where(F.col("h") < bound).dropDuplicates(["h"]).collect() or own.limit(1).collect()]  # some SAMPLE rows
        cells = Cells(np.array(sample, np.int64), min(CELLS, math.ceil(sizes["main"]["n"] / shard_rows)))
        others = max(1, math.ceil((sizes["all"] - sizes["main"]["n"]) / shard_rows))
    placed = materialise(vectors.mapInArrow(_place(cells), "width int, cell int, row long, vec_id long, v binary"))
    if cells is not None:
        parts = placed.where(F.col("cell") >= 0).select("width", "cell", "v").mapInArrow(_boxes, "cell int, n long, low array<long>, high array<long>")
        ends = parts.groupBy("cell").agg(F.sum("n").alias("n"), *(f(F.col(side)[i]).alias(f"{side}{i}") for side, f in (("low", F.min), ("high", F.max)) for i in range(cells.width)))
        told = sorted(ends.collect())  # CELLS rows at most
        cells.numbers, cells.shards = np.array([r["cell"] for r in told], int), {r["cell"]: math.ceil(r["n"] / shard_rows) for r in told}
        cells.low, cells.high = (np.array([[r[f"{side}{i}"] for i in range(cells.width)] for r in told], float).reshape(-1, cells.width) for side in ("low", "high"))
    count = F.lit(others)
    for c, n in (cells.shards if cells is not None else {}).items():
        count = F.when(F.col("cell") == c, n).otherwise(count) if n > 1 or others > 1 else count
    sharded = placed.withColumn("shard", F.pmod(F.xxhash64("row"), count).cast("int"))
    trees = materialise(sharded.groupBy("width", "cell", "shard").applyInPandas(_trees, _ASK), "none")
    forget(placed)

    at_home = materialise(queries.select("query_id", "v").mapInArrow(_home(cells, others), _ASK))
    blocks = math.ceil(at_home.count() / task_queries)
    key = ["width", "cell", "shard"]

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).cast("int"))
        if blocks > 1:
            asked = materialise(asked)
            copies = trees.join(asked.select(*key, "block").distinct(), key)
        else:
            copies = trees.withColumn("block", F.lit(0))
        rows = copies.unionByName(asked).repartition(*key, "block").sortWithinPartitions(*key, "block", F.col("tree").isNull())
        return rows.mapInArrow(_stream(k, block_queries), "query_id long, vec_id long, score long")

    first = materialise(meet(at_home))
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("found"))
    known = at_home.join(kth, "query_id", "left").select("width", "cell", "shard", "query_id", "v", F.coalesce("found", F.lit(int(NONE))).alias("kth"))
    rest = meet(known.mapInArrow(_elsewhere(cells, others), _ASK))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * x) of every vector that is whole and finite; a component that reaches 2**62 is an error."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.raise_error(F.lit("a vector's component needs more than 62 bits")).cast("long")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))  # noqa: E731  Spark may look at these before it leaves their rows out
    whole = lambda x: F.when(odd(x), None).when(F.abs(F.lit(scale) * x.cast("double")) < float(1 << 62), F.floor(F.lit(scale) * x.cast("double"))).otherwise(large)
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, whole).alias("v"))


def ask(vectors: DataFrame, which: Column) -> DataFrame:
    """Of the rows that ask, one for each id: the least vector."""
    return vectors.where(which).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))


def op4_topk_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 best of every vec_id divisible by 20."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, ask(vectors, F.col("vec_id") % 20 == 0), 20)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 20
"""
