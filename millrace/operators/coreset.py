"""k-center greedy on distributed vectors, and the memory bank that it makes.

Every vector holds its squared distance to the nearest chosen one. In a round the ``CANDIDATES`` farthest vectors come to the driver. Greedy goes on among them:
a candidate is the farthest of all as long as its distance, brought up to date, is not below that of the last candidate when the round began, since every other
vector was no farther than that one and distances only shrink. The vectors chosen in the round then go to all tasks, which bring the
distances up to date. So each round chooses several vectors, and they are those that plain greedy chooses, in its order.

Ties go to the smaller id. The first vector is the one with the smallest id. Vectors that are null or hold nulls or other than finite numbers take no part, nor do rows without an id; of rows with
one id the least vector counts. With a size of at least the number of vectors every one is chosen. An empty table has an empty coreset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import forget, stored

CANDIDATES = 256
#: In place of a distance: the vector is chosen.
CHOSEN = -1.0


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: one finite vector for each id."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.transform(e, lambda x: x.cast("double"))).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _nearer(chosen: list[tuple[int, np.ndarray]]):  # noqa: ANN202
    """vec_id, v, far, center with what ``chosen`` (CANDIDATES at most) changes; of centers at equal distance the one chosen first stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, far, center = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
            for name, v in chosen:
                d = ((rows - v) ** 2).sum(1)
                near = d < far
                far[near], center[near] = d[near], name
                far[ids == name] = CHOSEN
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far), pa.array(center)], names=["vec_id", "v", "far", "center"])

    return run


def _round(rows: list, room: int, floor: float | None) -> list[tuple[int, np.ndarray]]:
    """Greedy among the farthest vectors (vec_id, v, far), while the next one is known to be the farthest of all. ``floor``: the distance of the last of them, None if there are no others."""
    ids, x, far = [r["vec_id"] for r in rows], np.array([r["v"] for r in rows]), np.array([r["far"] for r in rows])
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, x, far = [ids[i] for i in order], x[order], far[order]
    chosen = []
    while len(chosen) < min(room, len(ids)):
        i = int(np.argmax(far))  # the first, so the smallest id
        if far[i] == CHOSEN or (chosen and floor is not None and far[i] <= floor):
            break
        chosen.append((ids[i], x[i]))
        far = np.where(far == CHOSEN, far, np.minimum(far, ((x - x[i]) ** 2).sum(1)))
        far[i] = CHOSEN
    return chosen


def k_center(embeddings: DataFrame, size: int) -> tuple[list[int], DataFrame]:
    """Ids of the chosen vectors in their order, and vec_id, center, distance of every vector: the chosen one nearest to it. ``size`` ids come to the driver."""
    schema = "vec_id long, v array<double>, far double, center long"
    now = stored(clean(embeddings).select("vec_id", "v", F.lit(float("inf")).alias("far"), F.lit(-1).cast("long").alias("center")))
    order: list[int] = []
    chosen = [(r["vec_id"], np.array(r["v"])) for r in now.orderBy("vec_id").limit(1).collect()] if size > 0 else []
    while chosen:
        order += [i for i, _ in chosen]
        after = stored(now.mapInArrow(_nearer(chosen), schema))
        forget(now)
        now = after
        if len(order) >= size:
            break
        top = now.where(F.col("far") != CHOSEN).orderBy(F.desc("far"), "vec_id").limit(CANDIDATES).collect()
        chosen = _round(top, size - len(order), top[-1]["far"] if len(top) == CANDIDATES else None) if top else []
    return order, now.select("vec_id", "center", F.sqrt(F.greatest("far", F.lit(0.0))).alias("distance"))


def memory_bank(embeddings: DataFrame, size: int) -> DataFrame:
    """rank, vec_id, members, radius of each chosen vector: how many vectors are nearest to it, and the farthest of them."""
    order, nearest = k_center(embeddings, size)
    ranks = embeddings.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(order)], "rank int, vec_id long")  # ``size`` rows
    found = nearest.groupBy(F.col("center").alias("vec_id")).agg(F.count(F.lit(1)).alias("members"), F.max("distance").alias("radius"))
    return found.join(F.broadcast(ranks), "vec_id").select("rank", "vec_id", "members", "radius")
