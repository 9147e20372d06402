"""Connected components of small grids, in DataFrame functions: a grid is the bits of a long, cell ``y * columns + x`` at that bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a grid: a long without its sign, and one to spare.
MOST_CELLS = 62


def bits(values: Column, cells: int, holds) -> Column:  # noqa: ANN001
    """The grid of the first ``cells`` values of an array for which ``holds(value)`` is true; nulls aren't."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.aggregate(F.sequence(F.lit(0), F.lit(cells - 1)), F.lit(0).cast("long"), lambda m, i: F.when(F.coalesce(holds(F.get(values, i)), F.lit(False)), m.bitwiseOR(one(i))).otherwise(m))


def _column(rows: int, columns: int, x: int) -> int:
    return sum(1 << (y * columns + x) for y in range(rows))


def grown(mask: Column, rows: int, columns: int) -> Column:
    """The cells of ``mask`` and their eight neighbours."""
    every = (1 << (rows * columns)) - 1
    from_left = F.shiftleft(mask.bitwiseAND(F.lit(every & ~_column(rows, columns, columns - 1))), 1)
    from_right = F.shiftright(mask.bitwiseAND(F.lit(every & ~_column(rows, columns, 0))), 1)
    wide = mask.bitwiseOR(from_left).bitwiseOR(from_right)
    return wide.bitwiseOR(F.shiftleft(wide, columns).bitwiseAND(F.lit(every))).bitwiseOR(F.shiftright(wide, columns))


def largest_component(mask: Column, rows: int, columns: int) -> Column:
    """components, area, x, y, width, height of the largest 8-connected component; of equal ones the first in reading order. An empty or null grid has none: 0, 0 and nulls."""
    cells = rows * columns
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"grids have 1 to {MOST_CELLS} cells")
    long = lambda n: F.lit(n).cast("long")
    places = F.sequence(F.lit(0), F.lit(cells - 1))

    def flood(seed: Column, of: Column) -> Column:
        return F.aggregate(places, seed, lambda m, _: grown_in(m, of))

    def grown_in(m: Column, of: Column) -> Column:
        # one variable, used once: the array makes Spark compute it once
        return F.element_at(F.transform(F.array(m), lambda x: grown(x, rows, columns)), 1).bitwiseAND(of)

    def state(rest: Column, best: Column, count: Column) -> Column:
        return F.struct(rest.cast("long").alias("rest"), best.cast("long").alias("best"), count.cast("int").alias("count"))

    def visit(s: Column, i: Column) -> Column:
        seed = F.call_function("shiftleft", long(1), i)

        def with_component(c: Column) -> Column:
            return state(s["rest"].bitwiseAND(F.bitwise_not(c)), F.when(F.bit_count(c) > F.bit_count(s["best"]), c).otherwise(s["best"]), s["count"] + 1)

        found = F.element_at(F.transform(F.array(flood(seed, s["rest"])), with_component), 1)
        return F.when(s["rest"].bitwiseAND(seed) != 0, found).otherwise(s)

    def boxed(s: Column) -> Column:
        own = F.filter(places, lambda i: F.call_function("shiftright", s["best"], i).bitwiseAND(long(1)) == 1)
        xs, ys = F.transform(own, lambda i: i % columns), F.transform(own, lambda i: F.floor(i / columns).cast("int"))
        return F.struct(
            s["count"].alias("components"),
            F.bit_count(s["best"]).cast("int").alias("area"),
            F.array_min(xs).alias("x"),
            F.array_min(ys).alias("y"),
            (F.array_max(xs) - F.array_min(xs) + 1).alias("width"),
            (F.array_max(ys) - F.array_min(ys) + 1).alias("height"),
        )

    return F.aggregate(places, state(F.coalesce(mask, long(0)), long(0), F.lit(0)), visit, boxed)
