"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``ORDER`` bytes long. A byte's code length starts at the longest
context that the language's tree holds; a context that never saw the byte is left by an escape (method C: its weight is
the number of distinct bytes that followed the context), and below the empty context every byte costs 8 bits. The
statistics are frozen after learning, so the cost of a byte depends on the ``ORDER + 1`` bytes that end at it alone. The
trees are therefore compiled into tables from strings of bytes to costs, and whole batches are scored by table look-ups that
give exactly the code lengths of a byte-by-byte walk.

The language of the shortest code wins (ties: the first by name). ``score`` is the winner's share when the mean code
lengths, in nats for ``TEMPER`` bytes, are turned into weights: 1 over the sum for equal costs, near 1 if clear.
Null texts and texts without a letter are ``und`` with score 0. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_rows, fold_of, spread

#: Longest context in bytes.
ORDER = 3
#: Bytes whose mean code length makes the score.
TEMPER = 64
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Compiled trees of all languages.

    ``code`` maps bytes to symbols (0: never seen). ``grams[k]`` maps (number of a string of k bytes, symbol) to the number of
    the string of k + 1 bytes, 0 if no language saw it. ``cost[k]`` has the bits of the last byte of each such string, ``leave[k]``
    the bits of the escape from it as a context, a column for each language.
    """

    languages: list[str]
    code: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    leave: list[np.ndarray] = field(default_factory=list)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        n = len(texts)
        out = np.zeros((n, len(self.languages)))
        sizes = np.fromiter(map(len, texts), np.int64, n)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        symbols = self.code[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int64)
        starts = np.zeros(len(full), np.int64)
        np.cumsum(sizes[full][:-1], out=starts[1:])
        total = np.empty((len(symbols), len(self.languages)), np.float32)
        ids = [self.grams[0][symbols]]  # strings that end at each place, by length
        width = self.code.max() + 1
        for k in range(1, len(self.grams)):
            before = np.zeros(len(symbols), np.int64)
            before[1:] = ids[-1][:-1]
            before[starts] = 0  # no context reaches back over the start of a text
            ids.append(self.grams[k].reshape(-1)[before * width + symbols])
        known = ids[-1] > 0
        total[known] = self.cost[-1][ids[-1][known]]
        rest = np.flatnonzero(~known)
        first = np.zeros(len(symbols), bool)
        first[starts] = True
        part = np.zeros((len(rest), len(self.languages)), np.float32)
        alive = np.arange(len(rest))
        for k in range(len(self.grams) - 1, -1, -1):  # contexts of k bytes, strings of k + 1
            here = rest[alive]
            hit = ids[k][here] > 0
            part[alive[hit]] += self.cost[k][ids[k][here[hit]]]
            alive, here = alive[~hit], here[~hit]
            if k:  # leave the context of k bytes, if there is one
                context = np.where(first[here], 0, ids[k - 1][here - 1])
                part[alive] += self.leave[k - 1][context]
        part[alive] += self.leave_empty + 8
        total[rest] = part
        out[full] = np.add.reduceat(total.astype(np.float64), starts, axis=0)
        return out

    @property
    def leave_empty(self) -> np.ndarray:
        return self.leave[-1][0]


def compile_trees(samples: dict[str, list[bytes]], order: int = ORDER) -> LanguageModel:
    """Count the context trees of each language and compile them into tables.

    ``leave`` has one entry more than ``grams``: its last, single row is the escape from the empty context.
    """
    languages = sorted(samples)
    if not languages:
        return LanguageModel([], np.zeros(256, np.int32))
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
    code = np.zeros(256, np.int32)
    code[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    counts: list[list[np.ndarray]] = []  # by length, then language: counts by number
    grams: list[np.ndarray] = []
    streams = {g: [code[np.frombuffer(t, np.uint8)].astype(np.int64) for t in texts if t] for g, texts in samples.items()}
    ids = {g: [np.zeros(len(s), np.int64) for s in parts] for g, parts in streams.items()}
    for k in range(order + 1):
        keys = {}
        for g in languages:
            got = []
            for i, s in enumerate(streams[g]):
                key = (ids[g][i] if k == 0 else np.concatenate([[0], ids[g][i][:-1]])) * width + s
                if k:
                    key[:k] = 0  # strings that would begin before the text
                got.append(key)
            keys[g] = got
        every = [x for got in keys.values() for x in got]
        distinct = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
        distinct = distinct[distinct > 0]
        before = len(counts[-1][0]) if counts else 1
        table = np.zeros(before * width, np.int32)
        table[distinct] = np.arange(1, len(distinct) + 1)
        grams.append(table.reshape(before, width) if k else table)
        per = []
        for g in languages:
            for i, key in enumerate(keys[g]):
                ids[g][i] = np.where(key > 0, table[key], 0).astype(np.int64)
            numbers = np.concatenate(ids[g]) if ids[g] else np.zeros(0, np.int64)
            c = np.bincount(numbers, minlength=len(distinct) + 1).astype(np.float64)
            c[0] = 0
            per.append(c)
        counts.append(per)
    n_lang = len(languages)
    cost: list[np.ndarray] = []
    leave: list[np.ndarray] = []
    empty_total = np.array([c.sum() for c in counts[0]])
    empty_kinds = np.array([(c > 0).sum() for c in counts[0]], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        leave_empty = np.where(empty_total > 0, -np.log2(empty_kinds / (empty_total + empty_kinds)), 0.0)
        for k in range(order + 1):
            size = len(counts[k][0])
            parent = np.zeros(size, np.int64)
            suffix = np.zeros(size, np.int64)
            if k:
                where = np.flatnonzero(grams[k].reshape(-1))
                parent[grams[k].reshape(-1)[where]] = where // width
                last = where % width
                # the string without its first byte: shorten the context, then add the last byte
                shorter = suffix_of[k - 1][where // width]
                suffix[grams[k].reshape(-1)[where]] = grams[k - 1].reshape(-1)[shorter * width + last] if k > 1 else grams[0][last]
            if k == 0:
                suffix_of = [np.zeros(size, np.int64)]
            else:
                suffix_of.append(suffix)
            table = np.zeros((size, n_lang))
            for j in range(n_lang):
                c = counts[k][j]
                if k == 0:
                    total, kinds = empty_total[j], empty_kinds[j]
                    table[:, j] = np.where(c > 0, -np.log2(c / max(total + kinds, 1)), leave_empty[j] + 8)
                else:
                    follow = np.bincount(parent, weights=c, minlength=len(counts[k - 1][j]))
                    kinds = np.bincount(parent, weights=(c > 0).astype(float), minlength=len(counts[k - 1][j]))
                    total = follow + kinds
                    escape = np.where(total > 0, -np.log2(kinds / np.maximum(total, 1)), 0.0)
                    if len(leave) < k:
                        leave.append(np.zeros((len(counts[k - 1][j]), n_lang)))
                    leave[k - 1][:, j] = escape
                    leave[k - 1][0, j] = 0.0
                    table[:, j] = np.where(c > 0, -np.log2(c / np.maximum(total[parent], 1)), escape[parent] + cost[k - 1][suffix, j])
            cost.append(table.astype(np.float32))
    leave.append(leave_empty[None, :])
    return LanguageModel(languages, code, grams, cost, [x.astype(np.float32) for x in leave])


def fit(docs: DataFrame, learn: Column, *, per_language: int = 500, languages: int = 5, clip: int = 4096, order: int = ORDER) -> LanguageModel:
    """Learn every language from a bounded sample: of each that ``learn`` admits, ``per_language`` rows in the order of a hash of
    id and text; with more than ``languages`` languages so many fewer that all have ``per_language * languages`` together, one each at least.
    Rows that agree in id, language and text teach once, so the bound holds however often an id or a row is repeated.
    Of a text with more than ``clip`` characters it takes pieces of that total from all over the text. Documents with
    null or empty text or null language teach nothing. Without any, as in an empty table, the model knows no language and every text is ``und``.
    """
    place = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 40)).alias("h")
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & learn)
    known = rows.select("lang", place)
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("size"))
    many = sizes.count()
    share = max(1, min(per_language, per_language * languages // max(many, 1)))
    # the hash is even, so twice the share (and some for small numbers) of a language's distinct rows lies below this bound; only those are ranked, and no language is one task
    below = F.least(F.lit(1.0), (2.0 * share + 64) / F.col("size"))
    some = known.join(F.broadcast(sizes), "lang").where(F.col("h") < below * (1 << 40)).select("lang", "h").distinct()
    ids = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= share)
    texts = rows.select("doc_id", "lang", "text", place)
    picked = texts.join(F.broadcast(ids.select("lang", "h")), ["lang", "h"]).select("doc_id", "lang", "h", spread(F.col("text"), clip).alias("pieces")).dropDuplicates(["lang", "h"])
    samples: dict[str, list[bytes]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).extend(x.encode("utf-8", "surrogatepass") for x in r["pieces"])
    return compile_trees(samples, order)


def predict_batch(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each whole text."""
    plain = [t if t and _LETTER.search(t) else "" for t in texts]
    data = [t.encode("utf-8", "surrogatepass") for t in plain]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return langs, scores
    bits = model.lengths(data)
    for i, b in enumerate(data):
        if b:
            best = int(np.argmin(bits[i]))
            gap = (bits[i] - bits[i][best]) / len(b) * np.log(2) * TEMPER
            langs[i], scores[i] = model.languages[best], float(1 / np.exp(-np.minimum(gap, 700)).sum())
    return langs, scores


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    shared = spark.sparkContext.broadcast(model)  # tables of a sample of fixed size
    kept = [n for n in docs.columns if n not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[n] for n in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for part in arrow_rows([batch], ["text"], 256):
                a, b = predict_batch(shared.value, part["text"])
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learnt only outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = fold_of(F.col("doc_id"), 4)
    model = fit(docs, fold != 2)
    return identify(spark, docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
