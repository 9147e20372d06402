"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents one after another. The packer fills windows of ``WINDOW`` tokens. In each
window every queue earns its target share of the window, keeps the fraction that it can't yet spend as a deficit, and sends the whole
tokens it has earned. When a queue runs dry, its share goes to the others in proportion to theirs. Since documents may be cut at any token,
what queue s has sent before window w is ``floor(weight(s) * t)``, or all it has, where t is the time at which all queues together
have earned w windows; its deficit is the fraction that this leaves. The state of the round-robin before any window is
therefore known without running the earlier ones: each partition continues with exactly the deficits that the windows before it carry over.

Targets are the caller's proportions by source. Sources that these don't name share what is left of 1 in proportion to their tokens; if
nothing is left, they follow when all others are dry. Without targets, every source's target is its share of all tokens: all queues run dry together, in the last window.

The windows' tokens form one stream that is cut into sequences of ``length`` tokens. What is left at its end is cut into sequences of
powers of two. No sequence needs padding.

Texts are tokenised once; ids are kept in shared storage until pieces are cut. A source that isn't named in the targets and has less than one ``FINEST``th of all tokens,
some tokens of a window, shares one of ``POOLS`` queues with others by hash; so there are never more than FINEST + POOLS queues besides the named ones, and
each larger source keeps a queue of its own however many sources there are.

Null texts count as empty: such a document is the end id alone. A null source is a source like others. Repeated rows are packed each on its own, whatever
their ids; a null id stays null. Other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_rows, materialise

LENGTH, END_ID, WINDOW, FINEST, POOLS = 2048, 1, 64 * 2048, 4096, 1024


class Encoder:
    """Ids of a text under a tokenizer file: those of the ``tokenizers`` library without added special tokens.

    ``ranks``, if given, is the same byte-level BPE vocabulary as a tiktoken file; that library is twice as fast and gives the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        self.size = self.plain.get_vocab_size()

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and len(text) < 1 << 20:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def public_encoder() -> tuple[str, str, str]:
    """Paths of the public 50k byte-level BPE vocabulary, in both formats, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenise(docs: DataFrame, files: tuple) -> DataFrame:
    """doc_id, queue, part, at, n, ids: each document's ids, and its place in the partition's part of its queue."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("queue", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    kind = pa.int64() if isinstance(docs.schema["doc_id"].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*files)
        width = np.dtype("<u2") if encode.size <= 1 << 16 else np.dtype("<u4")
        part, used = TaskContext.get().partitionId(), {}
        for rows in arrow_rows(batches, ["doc_id", "text", "queue"], 1024):
            at, n, ids = [], [], []
            for text, queue in zip(rows["text"], rows["queue"], strict=True):
                got = np.append(encode(text or ""), np.uint32(END_ID))
                at.append(used.get(queue, 0))
                n.append(len(got))
                used[queue] = at[-1] + len(got)
                ids.append(got.astype(width).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], kind), pa.array(rows["queue"], pa.string()), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=schema.names
            )

    return docs.mapInArrow(run, schema)


def weights(totals: list[int], targets: list[Fraction | None]) -> list[tuple[Fraction, int]]:
    """Weight and stage of each queue; a queue of stage 1 begins when those of stage 0 are dry."""
    rest = 1 - sum((t for t in targets if t is not None), Fraction(0))
    if rest < 0 or any(t is not None and t < 0 for t in targets):
        raise ValueError("targets must be at least 0, and together at most 1")
    others = sum(n for n, t in zip(totals, targets, strict=True) if t is None)
    out = []
    for n, t in zip(totals, targets, strict=True):
        w = rest * n / others if t is None else t
        out.append((w, 0) if w > 0 else (Fraction(n), 1))
    return out


class Schedule:
    """Where the deficit round-robin puts the tokens of each queue."""

    def __init__(self, totals: list[int], length: int = LENGTH, window: int = WINDOW, targets: list[Fraction | None] | None = None) -> None:
        self.totals, self.length, self.window, self.all = totals, length, window, sum(totals)
        self.full = self.all // length
        left, self.tail = self.all - self.full * length, [self.full * length]
        while left:
            size = 1 << (left.bit_length() - 1)
            self.tail.append(self.tail[-1] + size)
            left -= size
        self._phases(weights(totals, targets or [None] * len(totals)))
        self.time = lru_cache(512)(self._time)
        self.opening = lru_cache(512)(self._opening)

    def _phases(self, weighed: list[tuple[Fraction, int]]) -> None:
        """Times at which queues run dry, tokens sent until then, and the weight of the queues that go on."""
        scale = math.lcm(*(w.denominator for w, _ in weighed)) if weighed else 1
        self.weight = [int(w * scale) for w, _ in weighed]
        self.times, self.sent_by, self.rates, self.begin = [Fraction(0)], [Fraction(0)], [], [Fraction(0)] * len(weighed)
        for stage in (0, 1):
            members = sorted((Fraction(self.totals[q], self.weight[q]), q) for q, (_, s) in enumerate(weighed) if s == stage and self.weight[q])
            start, rate = self.times[-1], sum(self.weight[q] for _, q in members)
            for dry, q in members:
                self.begin[q] = start
                if start + dry > self.times[-1]:
                    self.sent_by.append(self.sent_by[-1] + (start + dry - self.times[-1]) * rate)
                    self.rates.append(rate)
                    self.times.append(start + dry)
                rate -= self.weight[q]

    def _time(self, w: int) -> tuple[int, int]:
        """Time at which windows before w are earned, as a ratio."""
        place = min(w * self.window, self.all)
        i = min(bisect_right(self.sent_by, place), len(self.rates)) - 1
        t = self.times[i] + (place - self.sent_by[i]) / self.rates[i]
        return t.numerator, t.denominator

    def sent(self, queue: int, w: int) -> int:
        """Tokens of the queue in the windows before w."""
        n, d = self.time(w)
        begin = self.begin[queue]
        if begin:
            n, d = n * begin.denominator - begin.numerator * d, d * begin.denominator
        return min(max(self.weight[queue] * n // d, 0), self.totals[queue])

    def window_of(self, queue: int, token: int) -> int:
        """The window that sends the queue's token: the first after which the queue has sent more than so many."""
        t = self.begin[queue] + Fraction(token + 1, self.weight[queue])
        i = max(min(bisect_left(self.times, t), len(self.rates)) - 1, 0)
        place = self.sent_by[i] + (t - self.times[i]) * self.rates[i]
        return -(-place.numerator // (place.denominator * self.window)) - 1

    def _opening(self, w: int) -> np.ndarray:
        """Place in the stream at which each queue's tokens of window w begin."""
        before = np.array([self.sent(q, w) for q in range(len(self.totals))], np.int64)
        sends = np.array([self.sent(q, w + 1) for q in range(len(self.totals))], np.int64) - before
        return before.sum() + np.cumsum(sends) - sends

    def pieces(self, queue: int, first: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before, tokens, sequence, offset) of the queue's tokens from ``first``, cut at the ends of windows and sequences."""
        done = 0
        while done < count:
            t = first + done
            w = self.window_of(queue, t)
            stop = min(self.sent(queue, w + 1), first + count)
            place = int(self.opening(w)[queue]) + t - self.sent(queue, w)
            while t < stop:
                if place < self.tail[0]:
                    sequence, offset = divmod(place, self.length)
                    room = self.length - offset
                else:
                    i = bisect_right(self.tail, place) - 1
                    sequence, offset, room = self.full + i, place - self.tail[i], self.tail[i + 1] - place
                n = min(room, stop - t)
                yield done, n, sequence, offset
                done, t, place = done + n, t + n, place + n


def pack(docs: DataFrame, files: tuple | None = None, *, targets: dict[str | None, float] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece. ``docs``: doc_id, text, source.

    ``targets``: the share of a window's tokens that each of some sources gets.
    """
    targets = {k: Fraction(str(v)) for k, v in (targets or {}).items()}
    tokens = materialise(tokenise(docs.select("doc_id", "text", F.col("source").cast("string").alias("queue")), files or public_encoder()))
    # a short row for each partition and source
    parts = materialise(tokens.groupBy("part", F.col("queue").alias("source")).agg(F.sum("n").alias("tokens")))
    sources = parts.groupBy("source").agg(F.sum("tokens").alias("total"))
    every = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    # at most FINEST sources besides the named ones
    large = sources.where((F.col("total") * FINEST >= every) | F.col("source").isin([k for k in targets if k is not None]) | (F.col("source").isNull() & F.lit(None in targets)))
    own = F.broadcast(large.select(F.col("source").alias("own_source"), F.lit(True).alias("own")))
    name = F.when(F.col("own"), F.struct(F.lit(0).alias("pool"), F.col("source").alias("name"))).otherwise(F.struct((F.pmod(F.xxhash64("source"), F.lit(POOLS)) + 1).cast("int").alias("pool"), F.lit(None).cast("string").alias("name")))
    placed = parts.join(own, F.col("source").eqNullSafe(F.col("own_source")), "left").select("part", "source", "tokens", name.alias("queue"))
    # a queue goes on from partition to partition; first the totals of its partitions, so that no queue is one task
    steps = materialise(placed.groupBy("queue", "part").agg(F.sum("tokens").alias("tokens")))
    before = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("queue", "part").orderBy(F.col("source").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    bases = steps.select("queue", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inner = placed.select("queue", "part", "source", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inner"))
    bases = materialise(inner.join(bases, ["queue", "part"]).select(F.col("part").alias("base_part"), F.col("source").alias("base_source"), F.col("queue").alias("into"), (F.col("base") + F.col("inner")).alias("base")))
    rows = steps.groupBy("queue").agg(F.sum("tokens").alias("t")).collect()  # at most FINEST + POOLS and the named ones
    totals = sorted((r["queue"]["pool"], r["queue"]["name"] is not None, r["queue"]["name"] or "", int(r["t"])) for r in rows)
    keys = [(pool, name if there else None) for pool, there, name, _ in totals]
    schedule = ([t for *_, t in totals], length, window, [targets.get(name) if pool == 0 else None for pool, name in keys])
    numbers = {k: i for i, k in enumerate(keys)}
    # Spark broadcasts ``bases`` if its files are small, and else sorts both sides
    based = tokens.join(bases, (F.col("part") == F.col("base_part")) & F.col("queue").eqNullSafe(F.col("base_source")))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    kind = pa.int64() if isinstance(docs.schema["doc_id"].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(*schedule)
        for rows in arrow_rows(batches, ["doc_id", "pool", "name", "at", "n", "ids", "base"], 1024):
            out: list[list] = [[] for _ in schema]
            for doc_id, pool, name, at, n, raw, base in zip(*rows.values(), strict=True):
                ids = np.frombuffer(raw, np.dtype(f"<u{len(raw) // n}")).astype("<u4")
                for start, size, sequence, offset in plan.pieces(numbers[pool, name], base + at, n):
                    for column, value in zip(out, (doc_id, start, size, zlib.crc32(ids[start : start + size]), n, sequence, offset), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), *[pa.array(x, pa.int64()) for x in out[1:]]], names=schema.names)

    return based.select("doc_id", "into.pool", "into.name", "at", "n", "ids", "base").mapInArrow(run, schema)


def op7_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
