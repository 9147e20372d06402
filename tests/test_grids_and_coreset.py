"""Components of grids by flood fill, k-center greedy by plain numpy, digests under any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import anomaly as A
from millrace.operators import coreset as C
from millrace.operators import grids as G


def flood(mask, rows, columns):
    left, best, count = {i for i in range(rows * columns) if mask >> i & 1}, [], 0
    while left:
        todo = [min(left)]
        own = set(todo)
        while todo:
            y, x = divmod(todo.pop(), columns)
            for n in ((y + a) * columns + x + b for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= y + a < rows and 0 <= x + b < columns):
                if n in left and n not in own:
                    own.add(n)
                    todo.append(n)
        left -= own
        count += 1
        best = sorted(own) if len(own) > len(best) else best
    if not best:
        return (0, 0, None, None, None, None)
    ys, xs = zip(*(divmod(i, columns) for i in best), strict=True)
    return (count, len(best), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)


@pytest.mark.parametrize(("rows", "columns"), [(4, 4), (1, 9), (9, 1), (7, 8), (3, 5), (2, 31)])
def test_components_match_flood_fill(spark, rows, columns):
    draw = random.Random(rows * 100 + columns)
    masks = [0, (1 << (rows * columns)) - 1] + [sum((draw.random() < p) << i for i in range(rows * columns)) for p in (0.2, 0.4, 0.6) for _ in range(25)]
    found = spark.createDataFrame([(m,) for m in masks], "m long").select("m", G.largest_component(F.col("m"), rows, columns).alias("c")).select("m", "c.*").collect()
    assert {r.m: tuple(r)[1:] for r in found} == {m: flood(m, rows, columns) for m in masks}


def test_grids_of_nulls(spark):
    rows = spark.createDataFrame([([0.5, None, -1.0],), ([],), (None,)], "v array<double>")
    assert [r.g for r in rows.select(G.bits(F.col("v"), 4, lambda x: x > 0).alias("g")).collect()] == [1, 0, 0]
    assert tuple(rows.select(G.largest_component(F.lit(None).cast("long"), 4, 4).alias("c")).first().c) == (0, 0, None, None, None, None)
    with pytest.raises(ValueError, match="1 to 62"):
        G.largest_component(F.lit(0), 8, 8)


def greedy(points, size):
    ids = sorted(points)
    x = np.array([points[i] for i in ids])
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(size, len(ids)):
        far[chosen] = -1
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return [ids[i] for i in chosen]


@pytest.mark.parametrize(("n", "size", "candidates"), [(300, 40, 256), (300, 40, 7), (60, 100, 16), (200, 150, 5)])
def test_k_center_is_plain_greedy(spark, monkeypatch, n, size, candidates):
    monkeypatch.setattr(C, "CANDIDATES", candidates)
    rng = np.random.default_rng(n + candidates)
    points = {int(i): [float(v) for v in rng.integers(0, 12, 3)] for i in rng.permutation(5 * n)[:n]}  # many ties and equal points
    frame = spark.createDataFrame([(i, v) for i, v in points.items()], "vec_id long, embedding array<float>").repartition(4)
    order, nearest = C.k_center(frame, size)
    assert order == greedy(points, size)
    for r in nearest.collect():
        d = min(np.linalg.norm(np.array(points[r.vec_id]) - points[c]) for c in order)
        assert abs(r.distance - d) < 1e-9 and abs(np.linalg.norm(np.array(points[r.vec_id]) - points[r.center]) - d) < 1e-9
    radius = max(r.distance for r in nearest.collect())
    for _ in range(50):  # no choice of as many centers is better by more than a factor of two
        other = [points[i] for i in rng.choice(list(points), min(size, n), replace=False)]
        assert radius <= 2 * max(min(np.linalg.norm(np.array(p) - c) for c in other) for p in points.values()) + 1e-9


def test_k_center_edges(spark):
    rows = [(1, [0.0, 0.0]), (1, [5.0, 5.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert C.k_center(frame, 9)[0] == [1, 4, 5] and C.k_center(frame, 0)[0] == [] and C.k_center(frame.limit(0), 3)[0] == []


def test_digest_of_any_partitioning(spark):
    rows = [("a" if i % 2 else "b", f"f{i % 90}", i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "split string, filename string, view int")
    told = lambda f: {r.split: r.digest for r in A.ordered_digest(f, ["split"], "filename", ["filename", "view"], F.concat_ws("/", "view", "filename")).collect()}
    first = told(frame)
    assert first == told(frame.repartition(7)) == told(frame.orderBy(F.desc("filename"))) and len(set(first.values())) == 2
    assert told(frame.where("filename <> 'f7'"))["a"] != first["a"] and told(frame.where("filename <> 'f7'"))["b"] == first["b"]
