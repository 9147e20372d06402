"""Exact rolling medians and median deviations of event series, sharded by time slice and value range.

A series' window at a time t holds its values with times in (t - window, t]. Rows of a series are dealt into slices of time, and of a hot series, one with more
than an eighth of all rows, also into ranges of values, at its own quantiles. A slice also gets the rows of the window before it. A block is the rows of
one series, slice and range, as one packed row. Nothing else moves row by row.

1. Each block reports how many of its values every window holds (as its times, from which the counts follow); added over the ranges, they say in
   which range a window's middle ranks lie, and at which rank there. 2. That block answers the values: the doubled median m.
3. Deviations |2c - m| are bisected at the borders of the ranges: for each border, how many values lie on the far side of its mirror image; the one block that
   holds the mirror image counts. That leaves a stretch of deviations whose values lie in one range left of the median and one right of it.
4. The two blocks meet, and a bisection over how many of the deviations come from the left one ends at the exact one.

Within a block, ranks and counts of windows come from a wavelet matrix: values coded by rank, one bit at a time, each step of all windows at once.

Slices are the wider, the sparser a series is, so that blocks have some ``BLOCK_ROWS`` rows; a hot series has the more ranges, the fuller its fullest window is (up to
``MOST_RANGES``). The driver sees a row for each hot series, at most seven, and one for all others; only that goes to all tasks.

Rows without a time or an id take no part; rows without a value get their window, and are in none. Rows of one id count once: of those that differ, the least (time, series, value) with nulls first. Equal values
at equal times each count. A null series is a series. Values may have 59 bits; above that the query fails and says so. An empty table gives an empty one. Other columns don't go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise

BLOCK_ROWS, LEAST_RANGES, MOST_RANGES, HOT_SHARE = 4096, 4, 64, 8
MINUTES_15 = 15 * 60 * 1_000_000
FAR = 1 << 62
_KINDS = ("<i1", "<i2", "<i4", "<i8")


def pack(numbers: np.ndarray) -> bytes:
    """Long integers as their first and compressed differences of the least width."""
    if not len(numbers):
        return b""
    steps = np.diff(np.asarray(numbers, np.int64))
    most = max((int(steps.max()), -1 - int(steps.min()))) if len(steps) else 0
    kind = sum(most > np.iinfo(k).max for k in _KINDS[:3])
    return bytes([kind]) + int(numbers[0]).to_bytes(8, "little", signed=True) + zstandard.compress(steps.astype(_KINDS[kind]).tobytes(), 1)


def unpack(held: bytes | None) -> np.ndarray:
    if not held:
        return np.zeros(0, np.int64)
    steps = np.frombuffer(zstandard.decompress(held[9:]), _KINDS[held[0]]).astype(np.int64)
    return np.cumsum(np.concatenate([[np.int64(int.from_bytes(held[1:9], "little", signed=True))], steps]))


class Ranked:
    """Wavelet matrix over values in order of time: ranks and counts of many ranges of places at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, codes = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(0, len(self.values) - 1).bit_length())):
            one = (codes >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            codes = np.concatenate([codes[~one], codes[one]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) of the places low .. high - 1, each range having more than k."""
        code = np.zeros(len(k), np.int64)
        for bit, zeros, n in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, n + low - a, a), np.where(one, n + high - b, b)
            code |= one.astype(np.int64) << bit
        return self.values[code]

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the places low .. high - 1 are less than x."""
        code = np.searchsorted(self.values, x, "left")
        whole, total = code >= len(self.values), np.zeros(len(x), np.int64)
        start, end = low, high
        for bit, zeros, n in self.levels:
            a, b = zeros[low], zeros[high]
            one = (code >> bit & 1).astype(bool)
            total += np.where(one, b - a, 0)
            low, high = np.where(one, n + low - a, a), np.where(one, n + high - b, b)
        return np.where(whole, end - start, total)


class Block:
    """Values of a block by time."""

    def __init__(self, times: bytes | None, values: bytes | None, window: int) -> None:
        self.times, self.window = unpack(times), window
        self.ranked = Ranked(unpack(values))

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the windows that end at the times ``at``."""
        return np.searchsorted(self.times, at - self.window, "right"), np.searchsorted(self.times, at, "right")


def nearest(left: Block, right: Block, at: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The q-th (from 1) and the next least deviation |2c - m| from ``low`` to ``high`` of each window; c up to m / 2 is in ``left``, the others in ``right``."""
    (l0, l1), (r0, r1) = left.places(at), right.places(at)
    above = np.maximum(low, 1)
    top = left.ranked.below(l0, l1, (m - low) // 2 + 1)
    n_left = top - left.ranked.below(l0, l1, -((high - m) // 2))
    bottom = right.ranked.below(r0, r1, -((-m - above) // 2))
    n_right = right.ranked.below(r0, r1, (m + high) // 2 + 1) - bottom

    def from_left(who: np.ndarray, i: np.ndarray) -> np.ndarray:
        return m[who] - 2 * left.ranked.kth(l0[who], l1[who], top[who] - 1 - i)

    def from_right(who: np.ndarray, i: np.ndarray) -> np.ndarray:
        return 2 * right.ranked.kth(r0[who], r1[who], bottom[who] + i) - m[who]

    first, last = np.maximum(0, q - n_right), np.minimum(q, n_left)
    while len(who := np.flatnonzero(first < last)):
        middle = (first[who] + last[who]) // 2
        more = from_left(who, middle) < from_right(who, q[who] - middle - 1)
        first[who[more]] = middle[more] + 1
        last[who[~more]] = middle[~more]
    taken = first
    here, after = np.full(len(q), -1, np.int64), np.full(len(q), FAR, np.int64)
    for side, i, n in ((from_left, taken, n_left), (from_right, q - taken, n_right)):
        who = np.flatnonzero(i > 0)
        here[who] = np.maximum(here[who], side(who, i[who] - 1))
        who = np.flatnonzero(i < n)
        after[who] = np.minimum(after[who], side(who, i[who]))
    return here, after


# ---------------------------------------------------------------- packed rows between the steps

MESSAGE = "series string, start long, shard int, other int, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
STATE = -1


def _message(series: str, start: int, shard: int, *parts: np.ndarray, other: int = 0) -> tuple:
    return (series, start, shard, other, *map(pack, parts), *[b""] * (6 - len(parts)))


def _combine(step: Callable) -> Callable:
    """Function of a pandas frame with all messages of a slice: ``step`` gets series, start, the state's arrays and the others as (shard, arrays)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, others = [], []
        for r in rows.itertuples(index=False):
            arrays = [unpack(x) for x in r[4:]]
            if r.shard == STATE:
                state = arrays
            else:
                others.append((r.shard, arrays))
        others.sort(key=lambda x: x[0])
        return pd.DataFrame(list(step(rows["series"].iloc[0], int(rows["start"].iloc[0]), state, others)), columns=_NAMES)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by series, start, shard, time become blocks."""
    names = ["series", "start", "shard", "times", "values", "ids", "bare_times", "bare_ids"]

    def block(name: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        known = rows.column("value").is_valid().to_numpy()
        ts, ids = rows.column("ts").to_numpy(), rows.column("id").to_numpy()
        values = rows.column("value").drop_null().to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.string()), pa.array([name[1]], pa.int64()), pa.array([name[2]], pa.int32()), *(pa.array([pack(x)], pa.binary()) for x in (ts[known], values, ids[known], ts[~known], ids[~known]))], names=names)

    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.columns[:3]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in key:
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            name = tuple(c[low].as_py() for c in key)
            if name != held:
                if parts:
                    yield block(held, parts)
                held, parts = name, []
            parts.append(batch.slice(low, high - low))
    if parts:
        yield block(held, parts)


def _answer(window: int, step: Callable, others: int = 1) -> Callable:
    """Function over asks joined with the blocks that they go to: ``step`` gets the blocks and the asked arrays and gives arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                blocks = [Block(r[f"times{i}"], r[f"values{i}"], window) for i in range(others)]
                out = step(*blocks, *(unpack(r[c]) for c in "abcdef"))
                row = _message(r["series"], r["start"], r["shard"], *out, other=r["other"])
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), pa.array([row[1]], pa.int64()), *(pa.array([x], pa.int32()) for x in row[2:4]), *(pa.array([x], pa.binary()) for x in row[4:])], names=_NAMES)

    return run


# ---------------------------------------------------------------- the steps of a slice


def _reports(window: int) -> Callable:
    """Times of all blocks of a slice -> where the middle ranks lie. State: windows, ranges that have rows, counts range by range."""

    def step(series: str, start: int, state: list, blocks: list) -> Iterator[tuple]:
        own = [x[x >= start] for _, arrays in blocks for x in arrays[:2]]
        windows = np.unique(np.concatenate(own))
        if not len(windows):
            return
        counts = np.array([np.searchsorted(a[0], windows, "right") - np.searchsorted(a[0], windows - window, "right") for _, a in blocks])
        upto, n = np.cumsum(counts, 0), counts.sum(0)
        shards = np.array([s for s, _ in blocks])
        yield _message(series, start, STATE, windows, shards, counts.ravel())
        asks = []
        for target, rank, wanted in ((0, (n - 1) // 2, n > 0), (1, n // 2, (n > 0) & (n % 2 == 0))):
            who = np.flatnonzero(wanted)
            at = (upto[:, who] <= rank[who]).sum(0)
            asks.append((who * 2 + target, at, rank[who] - (upto - counts)[at, who]))
        index, at, rank = (np.concatenate(x) for x in zip(*asks, strict=True))
        for k, shard in enumerate(shards):
            mine = np.flatnonzero(at == k)
            if len(mine):
                mine = mine[np.argsort(index[mine])]
                yield _message(series, start, int(shard), index[mine], windows[index[mine] // 2], rank[mine])

    return step


def _medians(splits: dict[str, list[int]]) -> Callable:
    """Middle values -> doubled medians, and for each border of ranges a count on the far side of its mirror image. State: windows, ranges, counts, medians."""

    def step(series: str, start: int, state: list, answers: list) -> Iterator[tuple]:
        windows, shards, counts = state[0], state[1], state[2].reshape(len(state[1]), -1)
        n = counts.sum(0)
        middle = np.zeros((2, len(windows)), np.int64)
        for _, (index, values, *_rest) in answers:
            middle[index % 2, index // 2] = values
        m = np.where(n % 2 == 0, middle.sum(0), 2 * middle[0])
        yield _message(series, start, STATE, windows, shards, counts.ravel(), m)
        borders = np.array(splits.get(series, []), np.int64)
        parts = []
        for j, border in enumerate(borders):
            x = m - border  # values below x are asked for
            place = np.searchsorted(shards, np.searchsorted(borders, x - 1, "left"))
            place = np.where((n > 0) & (place < len(shards)), place, -1)
            held = np.where((place >= 0) & (shards[place] == np.searchsorted(borders, x - 1, "left")), counts[place, np.arange(len(windows))], 0)
            who = np.flatnonzero(held > 0)
            parts.append((who * len(borders) + j, place[who], x[who]))
        if parts:
            index, place, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            for k, shard in enumerate(shards):
                mine = np.flatnonzero(place == k)
                if len(mine):
                    mine = mine[np.argsort(index[mine])]
                    yield _message(series, start, int(shard), index[mine], windows[index[mine] // len(borders)], x[mine])

    return step


def _stretches(splits: dict[str, list[int]]) -> Callable:
    """Counts at mirror images -> for each rank of deviations the stretch that holds it, and the two ranges that hold that stretch. State: windows, n, medians."""

    def step(series: str, start: int, state: list, answers: list) -> Iterator[tuple]:
        windows, shards, m = state[0], state[1], state[3]
        counts = state[2].reshape(len(shards), -1)
        n = counts.sum(0)
        borders = np.array(splits.get(series, []), np.int64)
        inside = np.zeros((len(borders), len(windows)), np.int64)
        for _, (index, values, *_rest) in answers:
            inside[index % max(1, len(borders)), index // max(1, len(borders))] = values
        yield _message(series, start, STATE, windows, n, m)
        upto = np.array([counts[shards <= j].sum(0) for j in range(len(borders) + 1)])
        ranks = [(n - 1) // 2 + 1, n // 2 + 1]
        low, high, passed = (np.full((2, len(windows)), x, np.int64) for x in (0, FAR, 0))
        for j, border in enumerate(borders):
            x = m - border
            range_of = np.searchsorted(borders, x - 1, "left")
            far = np.where(range_of > 0, upto[range_of - 1, np.arange(len(windows))], 0) + inside[j]
            right = 2 * border >= m
            edge = np.abs(2 * border - m)
            # right of the median the border itself is inside, left of it outside
            within, last = np.where(right, upto[j] - far, far - upto[j]), np.where(right, edge, edge - 1)
            for t in (0, 1):
                reached = within >= ranks[t]
                high[t] = np.where(reached, np.minimum(high[t], last), high[t])
                later = ~reached & (last + 1 > low[t])
                low[t], passed[t] = np.where(later, last + 1, low[t]), np.where(later, within, passed[t])
        same = (low[0] == low[1]) & (high[0] == high[1])
        asks = [(np.flatnonzero(n > 0), 0), (np.flatnonzero((n > 0) & ~same & (n % 2 == 0)), 1)]
        index = np.concatenate([who * 2 + t for who, t in asks])
        w, t = index // 2, index % 2
        lo, hi, q = low[t, w], high[t, w], np.where(t == 0, ranks[0][w], ranks[1][w]) - passed[t, w]
        left = np.searchsorted(borders, (m[w] - lo) // 2, "left")
        right = np.searchsorted(borders, -((-m[w] - np.maximum(lo, 1)) // 2), "left")
        pair = left * (len(borders) + 1) + right
        for p in np.unique(pair):
            mine = np.flatnonzero(pair == p)
            mine = mine[np.argsort(index[mine])]
            at = w[mine]
            yield _message(series, start, int(left[mine[0]]), index[mine], windows[at], m[at], lo[mine], hi[mine], q[mine], other=int(right[mine[0]]))

    return step


def _results(series: str, start: int, state: list, answers: list) -> Iterator[tuple]:
    """Deviations at the middle ranks -> windows, n, doubled median, doubled median deviation."""
    windows, n, m = state[:3]
    found = np.full((2, len(windows)), -1, np.int64)
    for second in (0, 1):  # a second rank that was asked for by itself stands, whatever came with the first
        for _, (index, here, after, *_rest) in answers:
            w = index[index % 2 == second] // 2
            found[second, w] = here[index % 2 == second]
            if not second:
                found[1, w] = after[index % 2 == 0]
    yield _message(series, start, 0, windows, n, m, np.where(n % 2 == 0, found.sum(0), 2 * found[0]))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            windows, n, m, mad = (unpack(r[c]) for c in "abcd")
            times, values, ids = (unpack(r[c]) for c in ("times", "values", "ids"))
            own = times >= r["start"]
            times, values, ids = times[own], values[own], ids[own]
            bare, bare_ids = unpack(r["bare_times"]), unpack(r["bare_ids"])
            at = np.searchsorted(windows, np.concatenate([times, bare]))
            if not len(at):
                continue
            none, no_value = n[at] < 1, np.arange(len(at)) >= len(times)
            far = np.abs(2 * np.concatenate([values, np.zeros(len(bare), np.int64)]) - m[at]) > mad[at]
            name = r["series"][1:] if r["series"] else None
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, bare_ids])), pa.array([name] * len(at), pa.string()), pa.array(n[at]), pa.array(m[at], mask=none), pa.array(mad[at], mask=none), pa.array(far, mask=no_value)], names=["id", "series", "n", "median2", "mad4", "far"]
            )


# ---------------------------------------------------------------- slices, ranges, rounds


def _power(x: float) -> int:
    """The greatest power of two up to x, at least 1."""
    return 1 << max(0, int(math.log2(x))) if x > 1 else 1


def plan(rows: DataFrame, window: int, block_rows: int) -> tuple[dict[str, int], int, dict[str, list[int]]]:
    """Width in windows of the slices of each hot series, that of all others, and the borders of a hot series' ranges: at most seven hot series."""
    total = rows.count()
    cells = rows.groupBy("series", F.floor(F.col("ts") / window).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    series = cells.groupBy("series").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("cells"))
    hot = F.when(F.col("n") * HOT_SHARE > total, F.col("series"))
    found = series.groupBy(hot.alias("hot")).agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("cells").alias("cells")).collect()  # HOT_SHARE rows at most
    widths, ranges, rest = {}, {}, 1
    for r in found:
        if r["hot"] is None:
            rest = _power(block_rows * 4 / r["most"])
        else:
            ranges[r["hot"]] = min(MOST_RANGES, max(LEAST_RANGES, 2 * _power(r["most"] / block_rows)))
            widths[r["hot"]] = _power(ranges[r["hot"]] * block_rows / (r["n"] / r["cells"]))
    borders = {}
    if ranges:
        every = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
        at = rows.where(F.col("series").isin(list(ranges)) & F.col("value").isNotNull()).groupBy("series").agg(F.percentile_approx("value", every, 10_000).alias("at")).collect()  # a row for each hot series
        borders = {r["series"]: sorted(set(r["at"][MOST_RANGES // ranges[r["series"]] - 1 :: MOST_RANGES // ranges[r["series"]]])) for r in at}
    return widths, rest, borders


def _by_series(series: Column, known: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in known.items():
        out = F.when(series == name, value).otherwise(out)
    return out


def rolling_medians(events: DataFrame, window: int = MINUTES_15, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, series, n, median2, mad4, far of every row. ``events``: id long, series string, ts long, value long.

    n values in the row's window, twice their median, twice the median of |2 * value - median2|, and whether the row's own |2 * value - median2| exceeds mad4."""
    series = F.coalesce(F.concat(F.lit("="), F.col("series")), F.lit(""))
    few = F.when(F.abs(F.col("value")) < (1 << 59), F.col("value")).when(F.col("value").isNotNull(), F.raise_error(F.lit("rolling medians take values below 2**59")).cast("long"))
    whole = events.where(F.col("id").isNotNull() & F.col("ts").isNotNull()).select("id", F.struct("ts", series.alias("series"), few.alias("value")).alias("row"))
    rows = materialise(whole.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.ts", "row.series", "row.value"))
    widths, rest, borders = plan(rows, window, block_rows)
    width = _by_series(F.col("series"), {k: F.lit(w * window) for k, w in widths.items()}, F.lit(rest * window)).cast("long")
    shard = _by_series(F.col("series"), {k: sum(((F.col("value") > b).cast("int") for b in at), F.lit(0)) for k, at in borders.items()}, F.lit(0))
    placed = rows.withColumn("width", width).withColumn("shard", F.coalesce(shard, F.lit(0)).cast("int")).withColumn("start", (F.floor(F.col("ts") / F.col("width")) * F.col("width")).cast("long"))
    next_too = F.col("value").isNotNull() & (F.col("ts") > F.col("start") + F.col("width") - window)
    dealt = placed.select("series", F.explode(F.when(next_too, F.array("start", F.col("start") + F.col("width"))).otherwise(F.array("start"))).alias("start"), "shard", "ts", "value", "id")
    key = ["series", "start", "shard"]
    blocks = materialise(dealt.repartition(*key).sortWithinPartitions(*key, "ts").mapInArrow(_cut, "series string, start long, shard int, times binary, values binary, ids binary, bare_times binary, bare_ids binary"), "none")
    forget(rows)

    def combine(messages: DataFrame, step: Callable) -> DataFrame:
        return materialise(messages.groupBy("series", "start").applyInPandas(_combine(step), MESSAGE), "none")

    def ask(messages: DataFrame, step: Callable, others: int = 1) -> DataFrame:
        asks = messages.where(F.col("shard") != STATE)
        for i, name in enumerate(("shard", "other")[:others]):
            there = blocks.select("series", "start", F.col("shard").alias(name), F.col("times").alias(f"times{i}"), F.col("values").alias(f"values{i}"))
            asks = asks.join(there, ["series", "start", name], "left")
        return asks.mapInArrow(_answer(window, step, others), MESSAGE).unionByName(messages.where(F.col("shard") == STATE))

    no = F.lit(None).cast("binary")
    times = blocks.select(*key, F.lit(0).alias("other"), F.col("times").alias("a"), F.col("bare_times").alias("b"), *(no.alias(c) for c in "cdef"))
    reported = combine(times, _reports(window))
    middles = combine(ask(reported, lambda block, index, at, rank, *_: (index, block.ranked.kth(*block.places(at), rank))), _medians(borders))
    counted = combine(ask(middles, lambda block, index, at, x, *_: (index, block.ranked.below(*block.places(at), x))), _stretches(borders))
    results = combine(ask(counted, lambda left, right, index, at, *stretch: (index, *nearest(left, right, at, *stretch)), 2), _results)
    for done in (reported, middles, counted):
        forget(done)
    told = results.select("series", "start", *"abcd").join(blocks.drop("shard"), ["series", "start"])
    return told.mapInArrow(_emit, "id long, series string, n long, median2 long, mad4 long, far boolean")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp's wall clock since 1970, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling doubled medians of the cents of every click."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "kind", "ts", "value")
    finite = F.abs(F.col("value")) < F.lit(float("inf"))
    cents = F.when(finite & (F.abs(F.col("value")) < float(1 << 52)), F.floor(F.col("value") * 100 + 0.5)).when(finite, F.lit((1 << 63) - 1))
    events = clicks.select(F.col("click_id").cast("long").alias("id"), F.col("kind").alias("series"), micros(F.col("ts")).alias("ts"), cents.cast("long").alias("value"))
    return rolling_medians(events).withColumnsRenamed({"id": "click_id", "series": "kind"})


ORACLE_SQL = """
WITH c AS (
  SELECT click_id, kind, ts, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents FROM clicks WHERE click_id IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, kind NULLS FIRST, value NULLS FIRST) = 1
), w AS (
  SELECT *, list_sort(list_filter(list(cents) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 899999999 MICROSECONDS PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS v FROM c
), m AS (SELECT *, len(v) AS n, v[(len(v) + 1) // 2] + v[len(v) // 2 + 1] AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(v, lambda x: abs(2 * x - median2))) AS d FROM m),
r AS (SELECT *, d[(n + 1) // 2] + d[n // 2 + 1] AS mad4 FROM d)
SELECT click_id, kind, n, CASE WHEN n > 0 THEN median2 END AS median2, CASE WHEN n > 0 THEN mad4 END AS mad4, CASE WHEN n > 0 THEN 2 * abs(2 * cents - median2) > 2 * mad4 END AS far FROM r
"""
