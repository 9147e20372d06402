"""Alignment of the tokens that two tokenizers make of one text, by a transducer over dangling suffixes.

The tokens of both sides spell the same bytes. The transducer's state is the side that leads and the bytes of its last token that the other
side has not reached yet. The lagging side's next token either leaves a shorter suffix, or overtakes and leaves one of its own; an empty suffix closes
a group: both sides end at one byte. Transitions are memoised by state and token; suffixes of tokens are all the states there can be, so the memo is bounded
by the vocabularies, and it is emptied beyond ``MEMO`` entries. Every step but those out of the empty state meets exactly one pair of overlapping tokens: a link.

How many documents link a pair of ids is counted over the whole table. Documents go in chunks of bounded size: a chunk names its distinct pairs once, with
the number of its documents that hold each, and the counts come back once for each chunk and pair. So what is shuffled is distinct pairs by chunk,
not links, and a frequent pair is one row for each chunk.

Side A is a byte-level BPE file for ``tokenizers`` whose pre-tokenizer starts a piece at every space that follows something other than white space; side B is
a sentencepiece model.

A text that is null or empty, or that one side doesn't spell (its joined bytes differ from a space and the text), has no tokens: zeros and an empty digest.
Every row of the table is a document of its own, repeated ids and texts included, so a text that stands twice counts its pairs twice. Null ids pass
through. Other columns don't go on. An empty table gives an empty one. A text of any length is held once in a task, with its ids.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_rows, materialise

#: Tokens of both sides and rows in a chunk; entries of a memo; bits of a token id in a key.
CHUNK_TOKENS, CHUNK_ROWS, MEMO, BITS = 1 << 22, 1 << 15, 150_000, 20
#: Stretches that are tokenized as one text, and the fewer ones tried where such a text fails; characters of a stretch that is too long for that; bits of a slot in front of the transitions.
JOINED, LONG, SLOT_BITS = (100, 10), 200, 17


#: A space that starts no stretch, since it follows white space or the space put before the text; a text cut at the others.
BEHIND_SPACE, AT_WORDS = re.compile(r"(?:\A|\s) ").search, re.compile(r"(?<=\S) ").split


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteBpe:
    """Ids of a byte-level BPE file by ``tokenizers``; special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        table, vocabulary = byte_of_character(), self.plain.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]


class SentencePiece:
    """Ids of a sentencepiece model for texts that start with the space that the model itself would put there."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.plain = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.plain.id_to_piece(i) for i in range(self.plain.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.plain.is_byte(i) else b"" if self.plain.is_control(i) or self.plain.is_unknown(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        #: Whether no entry holds a space behind another character, so that no merge crosses into a new word.
        self.by_word = not any(re.search("[^\u2581]\u2581", p) for p in names)
        self.space = self.plain.piece_to_id("\u2581")

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [ids if t != " " else [self.space] for t, ids in zip(texts, self.plain.encode([t[1:] for t in texts], num_threads=1), strict=True)]


class Transducer:
    """Steps through the tokens of both sides; ``bytes_a`` and ``bytes_b`` spell the ids. A state's number is odd where A leads; 0 is the empty suffix."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]) -> None:
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self._clear()

    def _clear(self) -> None:
        self.rests = [b""]
        self.number = {(False, b""): 0}
        self.memo: dict[int, int] = {}
        # the last transition asked for in each slot
        self.slot_keys, self.slot_states = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, np.int64)

    def _after(self, state: int, token: int) -> int:
        """The next state, or -1 if the bytes differ. A's token is fed where A doesn't lead, B's where it does."""
        a_leads, rest = bool(state & 1), self.rests[state >> 1]
        fed = self.bytes_b[token] if a_leads else self.bytes_a[token]
        if rest.startswith(fed) and fed:
            after = (a_leads, rest[len(fed) :])
        elif fed.startswith(rest) and fed:
            after = (not a_leads, fed[len(rest) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.number:
            self.number[after] = len(self.rests) << 1 | after[0]
            self.rests.append(after[1])
        return self.number[after]

    def _all_after(self, keys: np.ndarray) -> np.ndarray:
        """The next states of many transitions, by slots; those that lie in no slot by the memo."""
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        after, memo = self.slot_states[slots], self.memo
        other = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(other):
            asked = keys[other]
            for key in [key for key in set(asked.tolist()) if key not in memo]:
                memo[key] = self._after(key >> BITS, key & (1 << BITS) - 1)
            after[other] = [memo[key] for key in asked.tolist()]
            # of several keys for a slot only the last stays
            last = dict(zip(slots[other].tolist(), other.tolist(), strict=True))
            kept = np.fromiter(last.values(), np.int64, len(last))
            self.slot_keys[slots[kept]], self.slot_states[slots[kept]] = keys[kept], after[kept]
        return after

    def run_all(self, a: np.ndarray, b: np.ndarray, borders_a: np.ndarray, borders_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Many stretches in step: each is what lies between two borders of ``a`` and of ``b``, on either side at least one id.

        Whether each stretch is spelled alike by both sides; ends of the groups in ``a`` and in ``b``, in order (a stretch that isn't is one group);
        the links in order, and the stretch of each."""
        if len(self.memo) > MEMO:
            self._clear()
        both, good = np.concatenate([a, b]), np.ones(len(borders_a) - 1, bool)
        at = np.arange(len(good))
        i, j, to_i, to_j = borders_a[:-1].copy(), borders_b[:-1].copy(), borders_a[1:], borders_b[1:]
        state = np.zeros(len(good), np.int64)
        ends: list[tuple[np.ndarray, ...]] = []
        links: list[tuple[np.ndarray, ...]] = []
        while len(at):
            leads = (state & 1).astype(bool)
            over = np.where(leads, j == to_j, i == to_i)
            if over.any():
                good[at[over & ((state != 0) | (j != to_j))]] = False
                at, i, j, to_i, to_j, state, leads = (x[~over] for x in (at, i, j, to_i, to_j, state, leads))
            token = both[np.where(leads, j + len(a), i)]
            met = np.flatnonzero(state)
            links.append((at[met], np.where(leads[met], a[i[met] - 1] << BITS | token[met], token[met] << BITS | b[j[met] - 1])))
            i, j = i + ~leads, j + leads
            state = self._all_after(state << BITS | token)
            closed = np.flatnonzero(state == 0)
            ends.append((at[closed], i[closed], j[closed]))
            if (state < 0).any():
                good[at[state < 0]] = False
                at, i, j, to_i, to_j, state = (x[state >= 0] for x in (at, i, j, to_i, to_j, state))
        stretch, ends_a, ends_b = (np.concatenate(x) for x in zip(*ends, strict=True))
        bad = np.flatnonzero(~good)
        kept = good[stretch]
        stretch, ends_a, ends_b = np.append(stretch[kept], bad), np.append(ends_a[kept], borders_a[bad + 1]), np.append(ends_b[kept], borders_b[bad + 1])
        in_order = np.argsort(stretch, kind="stable")
        of, pairs = (np.concatenate(x) for x in zip(*links, strict=True))
        order = np.argsort(of, kind="stable")
        return good, ends_a[in_order], ends_b[in_order], pairs[order], of[order]

    def run(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Ends of the groups in both lists of ids, and the links (id of A << BITS | id of B) in order; None if the sides spell different bytes."""
        if len(self.memo) > MEMO:
            self._clear()
        memo, get = self.memo, self.memo.get
        state = i = j = 0
        n, m = len(a), len(b)
        ends: list[tuple[int, int]] = []
        links: list[int] = []
        while True:
            if state & 1:
                if j == m:
                    return None
                token = b[j]
                links.append(a[i - 1] << BITS | token)
                j += 1
            else:
                if i == n:
                    break
                token = a[i]
                if state:
                    links.append(token << BITS | b[j - 1])
                i += 1
            key = state << BITS | token
            state = get(key, -2)
            if state < 0:
                state = memo[key] = self._after(key >> BITS, token) if state == -2 else -1
                if state < 0:
                    return None
            if not state:
                ends.append((i, j))
        return (ends, links) if j == m and not state else None


class Aligner:
    """Both tokenizers and the transducer between them; made once in a worker. ``files``: A's file, B's model.

    Both sides have a token's start at every space that follows something other than white space, so a group closes there: the stretches between are
    aligned by themselves and remembered, in two generations of ``MEMO`` stretches. For the same reason new stretches are tokenized many at a time, as
    one text, and cut apart at their bytes; the transducer then runs through all of them in step.
    """

    def __init__(self, files: tuple[str, str]) -> None:
        self.a, self.b = ByteBpe(files[0]), SentencePiece(files[1])
        self.between = Transducer(self.a.bytes, self.b.bytes)
        self.long_a, self.long_b = (np.array([len(x) for x in side.bytes]) for side in (self.a, self.b))
        self.words = [f"{i}{end}" for side, ends in ((self.a, ",|"), (self.b, ",;\n")) for end in ends for i in range(len(side.bytes))]
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def stretches(self, text: str) -> list[str]:
        """Stretches of a text that a space is put before, each without the space that it starts with."""
        if not self.b.by_word:
            return [text]
        return text.split(" ") if not BEHIND_SPACE(text) else AT_WORDS(text)

    def align(self, texts: list[str]) -> list[tuple[list[int], list[int], list[tuple[int, int]], list[int]] | None]:
        """Ids of A and B, group ends and links of texts that start with a space; None where a side's bytes differ from the text."""
        out = []
        for t, a, b in zip(texts, self.a(texts), self.b(texts), strict=True):
            found = self.between.run(a, b) if b"".join([self.a.bytes[i] for i in a]) == t.encode("utf-8", "surrogatepass") else None
            out.append(found and (a, b, *found))
        return out

    def _learn(self, stretches: list[str]) -> None:
        alone: list[str] = []
        short: list[str] = []
        for t in stretches:
            # white space at the end would run into the next stretch; B spells U+2581 as a space, so that a text with it fails
            (short if 0 < len(t) <= LONG and not t[-1].isspace() and "\u2581" not in t and self.b.by_word else alone).append(t)
        for size in JOINED:
            short = self._learn_joined([short[at : at + size] for at in range(0, len(short), size)])
        alone += short
        for t, found in zip(alone, self.align([f" {t}" for t in alone]), strict=True):
            self.young[t] = found and (len(found[0]), len(found[1]), len(found[2]), as_text(*found[:3]), np.array(found[3], "<i8").tobytes())

    def _learn_joined(self, blocks: list[list[str]]) -> list[str]:
        """Learns the stretches of each block from one text; those of the blocks where a side's bytes differ somewhere are returned."""
        failed: list[str] = []
        learned: list[str] = []
        parts: list[tuple[list[int], list[int], np.ndarray, np.ndarray]] = []
        texts = ["".join([f" {t}" for t in block]) for block in blocks]
        for block, text, a, b in zip(blocks, texts, self.a(texts), self.b(texts), strict=True):
            borders = np.cumsum([0, *(len(t.encode("utf-8", "surrogatepass")) + 1 for t in block)])
            if b"".join([self.a.bytes[i] for i in a]) == text.encode("utf-8", "surrogatepass"):
                ends = [np.concatenate([[0], np.cumsum(long[ids])]) for long, ids in ((self.long_a, a), (self.long_b, b))]
                cuts = [np.searchsorted(e, borders) for e in ends]
                if all(e[-1] == borders[-1] and (e[c] == borders).all() for e, c in zip(ends, cuts, strict=True)):
                    learned += block
                    parts.append((a, b, *cuts))
                    continue
            failed += block
        if not parts:
            return failed
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in list(zip(*parts, strict=True))[:2])
        borders_a, borders_b = (np.cumsum([0, *chain.from_iterable(np.diff(p[side]).tolist() for p in parts)]) for side in (2, 3))
        good, ends_a, ends_b, links, of = self.between.run_all(a, b, borders_a, borders_b)
        said = self._as_texts(a, b, ends_a, ends_b, borders_b)
        groups = np.diff(np.searchsorted(ends_a, borders_a, side="right"))
        linked, whole = np.cumsum([0, *np.bincount(of, minlength=len(good)) * 8]).tolist(), links.astype("<i8").tobytes()
        for t, ok, n, m, g, text, at, to in zip(learned, good.tolist(), np.diff(borders_a).tolist(), np.diff(borders_b).tolist(), groups.tolist(), said, linked, linked[1:], strict=False):
            if ok:
                self.young[t] = (n, m, g, text, whole[at:to])
            else:
                failed.append(t)
        return failed

    def _as_texts(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, borders_b: np.ndarray) -> list[str]:
        """Groups of all stretches, as ``as_text`` writes them."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        last_b[borders_b[1:] - 1] = 2
        # before an id of A stand the ids of B of all earlier groups, before one of B those of A of its own group too
        before_a = np.repeat(np.append(0, ends_b[:-1]), np.diff(ends_a, prepend=0))
        before_b = np.repeat(ends_a, np.diff(ends_b, prepend=0))
        words = np.empty(len(a) + len(b), np.int64)
        n, m = len(self.long_a), len(self.long_b)
        words[np.arange(len(a)) + before_a] = a + n * last_a
        words[np.arange(len(b)) + before_b] = 2 * n + b + m * last_b
        return "".join(map(self.words.__getitem__, words.tolist())).split("\n")[:-1]

    def figures(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes] | None]:
        """For each text numbers of tokens of A and B and of groups, groups as text, links; None for a text without tokens."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [self.stretches(t) if t else [] for t in texts]
        new = {x for part in split for x in part if x not in young}
        known = [x for x in new if x in old]
        young.update((x, old[x]) for x in known)
        self._learn(list(new.difference(known)))
        out = []
        for part in split:
            found = [young[x] for x in part]
            if not found or None in found:
                out.append(None)
            else:
                a, b, n, groups, links = zip(*found, strict=True)
                out.append((sum(a), sum(b), sum(n), ";".join(groups), b"".join(links)))
        return out


def as_text(a: list[int], b: list[int], ends: list[tuple[int, int]]) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""
    out, i, j = [], 0, 0
    for to_i, to_j in ends:
        out.append(f"{a[i]}|{b[j]}" if to_i - i == 1 == to_j - j else f"{','.join(map(str, a[i:to_i]))}|{','.join(map(str, b[j:to_j]))}")
        i, j = to_i, to_j
    return ";".join(out)


@lru_cache(1)
def aligner(files: tuple[str, str]) -> Aligner:
    """One for each Python worker, so that later tasks know what earlier ones learned."""
    return Aligner(files)


def public_files() -> tuple[str, str]:
    """The public 50k byte-level BPE file and the public 32k sentencepiece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_groups(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends: both token sequences of each document, and where each group ends in them."""
    kind = docs.schema["doc_id"].dataType
    many = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, many) for n in ("a_ids", "b_ids", "a_ends", "b_ends"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(files).align
        for rows in arrow_rows(batches, ["doc_id", "text"], 64):
            known = iter(align([f" {t}" for t in rows["text"] if t]))
            found = [(next(known) if t else None) or ([], [], [], []) for t in rows["text"]]
            lists = [[f[0] for f in found], [f[1] for f in found], [[e[0] for e in f[2]] for f in found], [[e[1] for e in f[2]] for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64() if isinstance(kind, T.LongType) else None), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _chunks(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """A row for each chunk of documents: its distinct pairs with their document counts, and each document's figures and links by place in ``pairs``."""
    kind = docs.schema["doc_id"].dataType
    row = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(row)), *(T.StructField(n, T.BinaryType()) for n in ("pairs", "held", "sizes", "places", "times"))])
    id_type = pa.int64() if isinstance(kind, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures, made, part = aligner(files).figures, 0, TaskContext.get().partitionId()
        rows: list[dict] = []
        distinct: list[np.ndarray] = []
        times: list[np.ndarray] = []
        tokens = 0

        def chunk() -> pa.RecordBatch:
            pairs, places = np.unique(np.concatenate(distinct), return_inverse=True)
            columns = [pairs.astype("<i8"), np.bincount(places, minlength=len(pairs)).astype("<i4"), np.array([len(x) for x in distinct], "<i4"), places.astype("<i4"), np.concatenate(times).astype("<i4")]
            of_rows = pa.array(rows) if id_type is None else pa.array(rows, pa.struct([("doc_id", id_type), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), of_rows), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=schema.names)

        for got in arrow_rows(batches, ["doc_id", "text"], 64):
            for name, found in zip(got["doc_id"], figures(got["text"]), strict=True):
                a, b, groups, text, links = found or (0, 0, 0, "", b"")
                seen, n = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
                rows.append({"doc_id": name, "n_a": a, "n_b": b, "n_groups": groups, "n_links": len(links) // 8, "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if found else ""})
                distinct.append(seen)
                times.append(n)
                tokens += a + b
                if tokens >= CHUNK_TOKENS or len(rows) >= CHUNK_ROWS:
                    yield chunk()
                    rows, distinct, times, tokens, made = [], [], [], 0, made + 1
        if rows:
            yield chunk()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i4")
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part), pa.array(held[at : at + (1 << 16)])], names=["chunk", "place", "pair", "held"])


def link_counts(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the sum over links of their pair's documents."""
    chunks = materialise(_chunks(docs, files))
    pairs = chunks.select("chunk", "pairs", "held").mapInArrow(_pairs, "chunk long, place int, pair long, held int")
    counted = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    # a window of one id of A: at most as many rows as B has ids
    counted = counted.select("pair", "n", (F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", BITS)))).alias("best"))
    answers = pairs.select("chunk", "place", "pair").join(counted, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("counts"))
    kind = docs.schema["doc_id"].dataType
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, places, times, counts = (batch.column(batch.schema.get_field_index(n)) for n in ("rows", "sizes", "places", "times", "counts"))
            for k in range(batch.num_rows):
                size, place, weight = (np.frombuffer(c[k].as_py(), "<i4").astype(np.int64) for c in (sizes, places, times))
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if counts[k].is_valid:
                    told = counts[k].values
                    order = np.argsort(told.field("place").to_numpy())
                    n, best = told.field("n").to_numpy()[order], told.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                ends = np.cumsum(size)
                # prefix sums, so that documents without links give 0
                total = [np.concatenate([[0], np.cumsum(weight * x[place])]) for x in (best, n)]
                sums = [t[ends] - t[ends - size] for t in total]
                of = rows[k].values
                yield pa.RecordBatch.from_arrays([of.field("doc_id"), *(of.field(x) for x in longs[:4]), *(pa.array(s, pa.int64()) for s in sums), of.field("groups_sha256")], names=schema.names)

    return chunks.select("chunk", "rows", "sizes", "places", "times").join(answers, "chunk", "left").drop("chunk").mapInArrow(run, schema)


def op12_dangling_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the alignment of both public tokenizers on every document."""
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_files())
