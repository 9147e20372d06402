"""Quality classifier by compression: how much better do good texts than bad ones help to compress a text?

Two zstandard dictionaries are trained on labelled good and bad texts. A text is compressed with either, block by
block, and ``(bad - good) / (bad + good)`` of the two sizes is its normalised difference. A logistic curve, fitted on
labelled rows that trained no dictionary, turns the difference into the probability of label 1. The curve also sees
the better of the two rates (compressed to plain size): where a text repeats itself, the dictionaries hardly matter
and a difference means less.

Null and empty texts have difference 0 and rate 1. Repeated rows are scored alike. ``score`` keeps extra columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, fold_of, spread

#: Bytes of a text that are compressed at a time, each block with a fresh window.
BLOCK = 512
#: Score from which a document is predicted to have label 1.
THRESHOLD = 0.3
#: Bytes that any frame holds besides its blocks.
FRAME = 2


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries as bytes (of bounded room) and the weights of the logistic curve."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    level: int = 3

    def compressors(self) -> tuple:
        params = zstd.ZstdCompressionParameters.from_level(self.level, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = []
        for data in (self.good, self.bad):
            book = zstd.ZstdCompressionDict(data)
            book.precompute_compress(compression_params=params)
            made.append(zstd.ZstdCompressor(dict_data=book, compression_params=params))
        return tuple(made)

    def measures(self, text: str | None, compressors: tuple) -> tuple[float, float]:
        """Normalised size difference of the whole text (over 0: nearer to good texts) and the log of its better rate."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0, 0.0
        good, bad = compressors
        g = b = 0
        for at in range(0, len(data), BLOCK):
            piece = data[at : at + BLOCK]
            g += len(good.compress(piece)) - FRAME
            b += len(bad.compress(piece)) - FRAME
        return (b - g) / (b + g), float(np.log(min(g, b) / len(data)))

    def probability(self, measures: np.ndarray) -> np.ndarray:
        z = design(measures) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def design(measures: np.ndarray) -> np.ndarray:
    """Columns of the curve: difference, rate, rate squared, their product, one."""
    d, r = np.asarray(measures, float).reshape(-1, 2).T
    return np.stack([d, r, r * r, d * r, np.ones(len(d))], 1)


def spread_bytes(data: bytes, size: int, count: int = 16) -> bytes:
    """At most ``size`` bytes: all of the data, or ``count`` pieces from its first to its last byte."""
    if len(data) <= size:
        return data
    n, room = size // count, len(data) - size // count
    return b"".join(data[room * i // (count - 1) :][:n] for i in range(count))


def book(texts: list[str], room: int, piece: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself as raw content."""
    parts = [spread_bytes(t.encode("utf-8", "surrogatepass"), piece) for t in texts]
    try:
        return zstd.train_dictionary(room, parts).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(parts)[:room].ljust(16, b"\n")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, on columns scaled to deviation 1; the last column is the constant.

    With one label only, the weights are 0 and the constant gives the smoothed rate of that label.
    """
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        w[-1] = np.log(rate / (1 - rate))
        return w
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    a = x / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, a.T @ (p - y) + ridge * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, per_label: int = 2400, clip: int = 16384, room: int = 256 << 10, piece: int = 4096) -> QualityModel:
    """Fit on a bounded sample: rows of ``per_label`` documents of each label, in the order of a hash of the id, among the rows
    of ``labels`` for which ``learn`` holds; of those rows, where ids repeat, ``per_label`` in the order of a hash of id and text; and ``clip`` characters of each, from all over a longer text.
    Half fill the dictionaries, half fit the curve, weighted to the labels' true shares. The sample reaches the driver, at most ``2 * per_label * clip`` characters, however often an id
    or a row is repeated; rows that agree in id and text teach once. An empty table teaches nothing: every text then gets the score 0.5.

    Labels other than 0 and 1, and labels of null ids or null texts, teach nothing. Of several labels of a document, the greatest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    count = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("quality"), "doc_id")
    sample = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).select("doc_id", "quality", order.alias("o")).orderBy("o", "doc_id").limit(per_label)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.length("text") > 0).withColumn("row", F.xxhash64("doc_id", "text"))
    # ids may repeat: rows are ranked too, before any text is read
    ranked = texts.select("doc_id", "row").join(F.broadcast(sample), "doc_id").distinct()
    picked = None
    for q in (0, 1):
        part = ranked.where(F.col("quality") == q).orderBy("row", "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    parts = F.array_join(spread(F.col("text"), clip), "").alias("text")
    rows = sorted(texts.join(F.broadcast(picked), ["doc_id", "row"]).select("o", "doc_id", "row", "quality", parts).dropDuplicates(["doc_id", "row"]).collect())
    ordered = {q: [r["text"] for r in rows if r["quality"] == q] for q in (0, 1)}
    model = QualityModel(book(ordered[1][::2], room, piece), book(ordered[0][::2], room, piece))
    tools = model.compressors()
    x, y = [], []
    for q in (0, 1):
        rest = ordered[q][1::2]
        x += [model.measures(t, tools) for t in rest]
        y += [float(q)] * len(rest)
    y = np.array(y)
    weights = logistic(design(x), y)
    if len(y) and 0 < y.sum() < len(y):  # from the sample's shares of labels to the true ones
        weights[-1] += np.log(count[1] / count[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(model.good, model.bad, tuple(map(float, weights)))


def score(spark: SparkSession, docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text in ``column``."""
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of fixed room
    names = docs.columns
    kept = [n for n in names if n != column]
    schema = T.StructType([*[docs.schema[n] for n in kept], T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tools = model.compressors()
        for batch in batches:
            seen = [model.measures(t, tools) for part in arrow_rows([batch], ["text"]) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(model.probability(np.array(seen, float).reshape(-1, 2)))], names=[*kept, column])

    return docs.mapInArrow(run, schema)


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learnt only from rows outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, fold_of(F.col("doc_id"), 5) != 0)
    scored = score(spark, docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
    return scored
