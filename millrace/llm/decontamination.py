"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

A document holds an item if at least ``SHARE`` of the item's distinct word shingles are among the document's shingles.

* Items are partitioned by the size of their shingle sets; partition c holds sizes from 2**c to 2**(c+1) - 1.
* For each partition a document is cut into windows of 2 * 2**(c+1) shingles, half a window apart, so that any passage as long as an item
  of the partition lies whole in one of them. Item and window are then of comparable size, and containment turns into
  a Jaccard similarity that MinHash can see: at least 0.19 where ``SHARE`` of the smallest item is in the window.
* A window is a candidate for an item if one of ``HASHES`` minima agrees. At 0.19 all of them differ with probability 0.81**48, some 4e-5.
* Every candidate is verified by exact shingle containment in the whole document: shingles by 64-bit hash, then word for word.

Minima of a partition's windows come from those of the next smaller one, and whole batches of documents are hashed at once. No shuffle.

Items are indexed in blocks of bounded number and words (``BLOCK_ITEMS``, ``BLOCK_WORDS``), each a broadcast of its own. A task hashes a chunk of documents
once and holds it against one block after another, of which it keeps one in memory. ``PASS_BLOCKS`` blocks make a pass over the documents.

An item with fewer words than a shingle is one shingle of its own width, which is looked up at every place of every document.

Null and empty items and documents have no shingles: they hold nothing and are held by nothing. Repeated items and documents are compared each on their own.
Texts of any length are searched whole. Empty tables, of documents or items, give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, WORDS_SQL, shingle_hashes, words_of

SHARE = (80, 100)
HASHES = 48
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 4_000_000
PASS_BLOCKS = 32
#: Places of a filter for each item.
FILTER_ROOM = 16
BATCH = 256
_RNG = np.random.default_rng(20240229)
MULTIPLIERS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class ItemIndex:
    """Shingles of the items, and for each partition and hash the items' minima, sorted, with a filter of some of their first bits.

    Bytes grow with the items' words and number alone: a filter has ``FILTER_ROOM`` to twice as many places for each item of its partition.
    """

    ids: list
    sets: list[np.ndarray]
    texts: list[bytes]  # words with one space between
    minima: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # partition: values, items, filter
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # number of words below a shingle's: hashes, items

    def shingles(self, item: int) -> dict[int, bytes]:
        words = self.texts[item].split(b" ")
        return dict(zip(shingle_hashes(words).tolist(), grams(words), strict=True))

    def size(self) -> int:
        """Bytes of the arrays and texts."""
        arrays = [*self.sets, *(x for hashes in self.minima.values() for row in hashes for x in row), *(x for row in self.short.values() for x in row)]
        return sum(x.nbytes for x in arrays) + sum(map(len, self.texts))


def grams(words: list[bytes]) -> list[bytes]:
    k = min(5, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []


def _top_bits(seen: np.ndarray) -> np.uint64:
    """How far a minimum is shifted to give its place in a filter."""
    return np.uint64(65 - len(seen).bit_length())


def build_index(rows: list[tuple]) -> ItemIndex:
    """Index of (id, text) rows."""
    index = ItemIndex([], [], [], {}, {})
    parts: dict[int, list[int]] = {}
    short: dict[int, list[int]] = {}
    for item_id, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        kept = np.unique(shingle_hashes(words))
        if len(words) < SHINGLE_WORDS:
            short.setdefault(len(words), []).append(len(index.ids))
        else:
            parts.setdefault(int(len(kept)).bit_length() - 1, []).append(len(index.ids))
        index.ids.append(item_id)
        index.sets.append(kept)
        index.texts.append(b" ".join(words))
    for width, members in sorted(short.items()):
        values = np.concatenate([index.sets[i] for i in members])
        order = np.argsort(values, kind="stable")
        index.short[width] = values[order], np.array(members, np.int32)[order]
    for c, members in sorted(parts.items()):
        index.minima[c] = []
        for m in MULTIPLIERS:
            values = np.array([(index.sets[i] * m).min() for i in members], np.uint64)
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << max(8, (FILTER_ROOM * len(members)).bit_length()), bool)
            seen[values >> _top_bits(seen)] = True
            index.minima[c].append((values[order], np.array(members, np.int32)[order], seen))
    return index


def _starts(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``step`` within each of several stretches laid end to end, and the number of runs of each stretch."""
    runs = -(-sizes // step)
    first = np.cumsum(sizes) - sizes
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(first, runs) + within * step, runs


def candidates(index: ItemIndex, hashes: list[np.ndarray]) -> set[tuple[int, int]]:
    """(document, item) pairs of which some window's minimum agrees with the item's."""
    found: set[tuple[int, int]] = set()
    sizes = np.array([len(h) for h in hashes])
    if not index.minima or not sizes.sum():
        return found
    flat = np.concatenate(hashes)
    low, high = min(index.minima), max(index.minima)
    plans = []  # starts of this level's runs among the level below, stretch of each run, last run of its stretch
    below, step = sizes, 1 << (low + 1)
    for _ in range(low, high + 1):
        starts, runs = _starts(below, step)
        owner = np.repeat(np.arange(len(sizes)), runs)
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        plans.append((starts, owner, last))
        below, step = runs, 2
    for j, m in enumerate(MULTIPLIERS):
        level = flat * m
        for c, (starts, owner, last) in zip(range(low, high + 1), plans, strict=True):
            level = np.minimum.reduceat(level, starts)
            if c not in index.minima:
                continue
            after = np.append(level[1:], _NONE)
            after[last] = _NONE
            windows = np.minimum(level, after)
            values, items, seen = index.minima[c][j]
            maybe = np.flatnonzero(seen[windows >> _top_bits(seen)])
            if len(maybe):
                a, b = np.searchsorted(values, windows[maybe]), np.searchsorted(values, windows[maybe], "right")
                for w, i, k in zip(maybe[b > a], a[b > a], b[b > a], strict=True):
                    found.update((int(owner[w]), int(item)) for item in items[i:k])
    return found


def match_batch(index: ItemIndex, words: list[list[bytes]], hashes: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(document's place, item's place, item's shingles, shared shingles) of the pairs that hold."""
    out, shingles = [], {}
    for d, i in sorted(candidates(index, hashes)):
        wanted, have = index.sets[i], hashes[d]
        order = np.argsort(have, kind="stable")
        at = np.searchsorted(have[order], wanted)
        at = np.minimum(at, len(have) - 1)
        hit = have[order[at]] == wanted
        k = min(5, len(words[d]))
        if i not in shingles:
            shingles[i] = index.shingles(i)
        shared = sum(b" ".join(words[d][p : p + k]) == shingles[i][int(h)] for p, h in zip(order[at[hit]].tolist(), wanted[hit].tolist(), strict=True))
        if shared * SHARE[1] >= SHARE[0] * len(wanted):
            out.append((d, i, len(wanted), int(shared)))
    for width, (values, items) in index.short.items():
        for d, own in enumerate(words):
            have = shingle_hashes(own, width) if len(own) >= width else own
            if not len(have):
                continue
            a, b = np.searchsorted(values, have), np.searchsorted(values, have, "right")
            found = {int(i) for p in np.flatnonzero(b > a) for i in items[a[p] : b[p]] if b" ".join(own[p : p + width]) == index.texts[i]}
            out += [(d, i, 1, 1) for i in sorted(found)]
    return out


class Search:
    """Items in the documents of a task: blocks of the index one after another, one in memory if there are several."""

    def __init__(self, blocks: list) -> None:
        self.blocks = blocks

    def __call__(self, texts: list[str | None], batch: int = BATCH) -> Iterator[tuple[int, int, int, int]]:
        """(document's place, item_id, item's shingles, shared shingles)."""
        words = [words_of(t or "") for t in texts]
        hashes = [shingle_hashes(w) for w in words]
        for block in self.blocks:
            index = block.value
            for at in range(0, len(texts), batch):
                for d, i, n, shared in match_batch(index, words[at : at + batch], hashes[at : at + batch]):
                    yield at + d, index.ids[i], n, shared
            if len(self.blocks) > 1:
                block.__dict__.pop("_value", None)  # read again from its file for the next chunk


def _passes(items: DataFrame) -> Iterator[list]:
    """Broadcast blocks of the index, ``PASS_BLOCKS`` at most at a time; a list at least, which may be empty."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = math.ceil(max(size["n"] / BLOCK_ITEMS, size["chars"] / (4 * BLOCK_WORDS)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    held = []
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(block == b).collect()]  # bounded by BLOCK_ITEMS and BLOCK_WORDS, on the mean
        held.append(spark.sparkContext.broadcast(build_index(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))))
        if len(held) == PASS_BLOCKS and b + 1 < blocks:
            yield held
            held = []
    yield held


def _chunk(blocks: list) -> int:
    """Documents of a chunk: more if a block has to be read anew for each."""
    return BATCH if len(blocks) < 2 else 16 * BATCH


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: each item that a document holds. ``docs``: doc_id, text; ``items``: item_id, text.

    Other columns of either are left out. Empty tables, of documents or items, give an empty result.
    """
    out = None
    for blocks in _passes(items):
        part = _search(docs, blocks)
        out = part if out is None else out.unionByName(part)
    return out


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns; each row is judged on its own, whatever its id."""
    for blocks in _passes(items):
        docs = _clean(docs, blocks)
    return docs


def _search(docs: DataFrame, blocks: list) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "item_id", "n_item", "n_shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, _chunk(blocks)):
                part = batch.slice(at, _chunk(blocks))
                found = list(search(part.column(1).to_pylist()))
                ids = part.column(0).take(pa.array([d for d, *_ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x[i] for x in found], pa.int64()) for i in (1, 2, 3)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, n_item long, n_shared long")


def _clean(docs: DataFrame, blocks: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(blocks)
        for batch in batches:
            texts = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, _chunk(blocks)):
                part = batch.slice(at, _chunk(blocks))
                held = {d for d, *_ in search(part.column(texts).to_pylist())}
                yield part.filter(pa.array([d not in held for d in range(part.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: each benchmark item in each document that holds it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained_items(docs, items).withColumn("containment", F.col("n_shared") / F.col("n_item"))


#: Shingles of items and documents joined as text.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p : p + 4], ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM grams GROUP BY item_id),
held AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, CAST(len(w) - width + 2 AS BIGINT)), lambda p: array_to_string(w[p : p + width - 1], ' '))) AS g FROM d, (SELECT DISTINCT width FROM grams) x)
SELECT h.doc_id, s.item_id, s.n_item, count(*) AS n_shared, count(*) / s.n_item AS containment FROM held h JOIN grams g ON g.width = h.width AND g.g = h.g JOIN sizes s ON s.item_id = g.item_id GROUP BY h.doc_id, s.item_id, s.n_item HAVING count(*) * 100 >= 80 * s.n_item
"""
