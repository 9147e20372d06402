"""N-gram Jaccard self-join by universe partition and the pigeonhole principle, with exact results.

Texts are sets of word shingles. Two texts link if ``100 * |intersection| >= 80 * |union|``; then their sets differ in at most
``H = (|X| + |Y|) // 9`` elements.

Signatures. Sizes fall into bands; the band of a pair is that of its smaller set. In band k the universe of shingle hashes is cut into
segments, the same for all sets. If a pair differs in at most H elements, then among any H + 1 segments one agrees wholly; and a
segment that may differ in one element counts for two (one-deletion neighbourhood: a signature of the segment and of the segment without each of its elements).
A set is indexed under all segments of its own band, and of the next lower band if sets of that band can link with it. It probes as
the smaller set of a pair, and only H + 1 units of its own choice have to be probed.

Allocation by cost. Small bands use one-deletion segments, where exact segments would hold too few elements to tell texts apart. Larger bands use exact segments and have
more of them than H + 1, and each set probes those whose signatures are the rarest in its partition's rows: a passage that many documents share doesn't meet itself.
Empty segments, which many sets share, are probed only by sets that have too few others, and their index rows are spread over all tasks.

From candidates to groups, without ever listing the pairs of a group:

1. The rows of a signature form a star around one probing member. The stars' edges are verified, and linked texts merge into components.
2. What remains are signatures whose members lie in several components. Their members are compared block by block, and pairs of different
   components that may still link are verified too.

A pair is first held against its parity sketches: some bits for each element of a set, each the parity of the elements that fall on it. As
many bits as differ, so many elements at least differ, so a pair whose sketches are further apart than H can't link. A brief sketch, folded from the full one,
goes to every star and every signature; full ones only to the members that it leaves with a possible partner. Sets with equal 128-bit
digests are the same set. The others are verified exactly, on their texts, which only then have to travel.

Signatures travel as packed arrays: 4 bytes each beside their group, and 2 for the document. Groups grow in number with the input, so signatures that agree in
these bits by chance stay as rare as they are in one group; they cost a comparison and change no result. Equal sets of one partition travel once.

Null and empty texts and texts without words have no shingles and link with nothing. A text with fewer than five words is one shingle.
Rows with a null id are counted but link with nothing. Rows of one id are one node: it links where any of its rows does.
Only doc_id and text are read; other columns, whatever their names, don't go on. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS_SQL, arrow_rows, filter_place, forget, id_filter, materialise, mix64, shingle_set, sizes_of, words_of
from .components import components

PERCENT = 80
#: Sets of at least so many shingles use exact segments.
EXACT_FROM = 50
#: Exact segments for each that the pigeonhole needs.
SLACK = 1.35
#: Documents and signatures that a task packs at a time.
PACK_DOCS, PACK_SIGNATURES = 30_000, 1_000_000
#: Texts that are compared at a time are two blocks of this many.
BLOCK = 1024


def links(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def differences(size: int) -> int:
    """Elements in which a set of this size and a linked set of no smaller size differ at most."""
    return (size + size * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: a power of two from four for each element."""
    return 1 << min(max((4 * size - 1).bit_length(), 6), 16)


def brief_bits(size: int) -> int:
    """Bits of its brief sketch: from one for each element. Unrelated sets then differ in half of them, more than twice of what links allow."""
    return 1 << min(max((size - 1).bit_length(), 6), 14)


def sketch(mixed: np.ndarray) -> bytes:
    """Parities of the elements by their low bits; halves of it, xored, are the sketch of half the length."""
    bits = sketch_bits(len(mixed))
    return np.packbits((np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row of 64-bit words each) cut down to so many words."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def may_link(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link whose sketches differ in so many bits."""
    return ((100 + PERCENT) * distance <= (100 - PERCENT) * (a + b)) & (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


class Band:
    """Segments of a size band: limits in the hash range, and how many of them, from the first, are one-deletion segments."""

    def __init__(self, number: int, low: int, high: int) -> None:
        self.number, self.low, self.high = number, low, high
        need = differences(high - 1) + 1
        self.exact = low >= EXACT_FROM
        if self.exact:
            count, self.deletions = int(np.ceil(SLACK * need)), 0
            weights = np.ones(count)
        else:
            self.deletions, single = divmod(need, 2)
            weights = np.array([2.0] * self.deletions + [1.0] * single)  # a segment that counts twice holds twice as much
        edges = np.cumsum(weights)[:-1] / weights.sum()
        self.limits = (edges * 2.0**64).astype(np.uint64)
        self.salts = mix64(np.arange(len(weights), dtype=np.uint64) + np.uint64((number + 1) << 32))

    def signatures(self, hashes: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set (its sorted hashes and their second hashes), and whether the segment is empty."""
        ends = np.append(np.searchsorted(hashes, self.limits), len(hashes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        starts = np.concatenate([[0], ends[:-1]])
        sums = total[ends] - total[starts]
        own = mix64(sums + self.salts)
        empty = ends == starts
        if not self.deletions:
            return own, empty
        cut = ends[self.deletions - 1]
        segment = np.searchsorted(ends, np.arange(cut), "right")
        less = mix64(sums[segment] - mixed[:cut] + self.salts[segment])
        every = np.unique(np.concatenate([own, less]))
        return every, np.zeros(len(every), bool)


class Bands:
    def __init__(self) -> None:
        self.bands = [Band(0, 1, 2)]

    def of(self, size: int) -> Band:
        while self.bands[-1].high <= size:
            low = self.bands[-1].high
            self.bands.append(Band(len(self.bands), low, max(low + 1, low * 25 // 16)))
        low, high = 0, len(self.bands) - 1
        while low < high:
            middle = (low + high) // 2
            if self.bands[middle].high <= size:
                low = middle + 1
            else:
                high = middle
        return self.bands[low]

    def roles(self, size: int) -> list[tuple[Band, bool]]:
        """Bands under which a set is indexed, and whether it probes there too."""
        own = self.of(size)
        out, number = [(own, True)], own.number - 1
        least = -(-size * PERCENT // 100)
        while number >= 0 and self.bands[number].high - 1 >= least:
            out.append((self.bands[number], False))
            number -= 1
        return out


class Packer:
    """Signatures of some documents, packed by the group that their signatures fall into."""

    def __init__(self, bands: Bands, groups: int) -> None:
        self.bands, self.groups = bands, groups
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.sketches: list[bytes] = []
        self.digests: list[bytes] = []
        self.known: dict[bytes, int] = {}
        self.copies: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # signatures, empty, document, units to probe
        self.count = 0

    def add(self, doc_id: int, hashes: np.ndarray) -> None:
        key = xxhash.xxh3_128_digest(hashes.tobytes())
        if key in self.known:  # an equal set: linked, and the same in every comparison
            self.copies.append((self.ids[self.known[key]], doc_id))
            return
        self.known[key] = number = len(self.ids)
        self.ids.append(doc_id)
        mixed = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
        self.sizes.append(len(hashes))
        self.sketches.append(sketch(mixed))
        self.digests.append(key)
        for band, probes in self.bands.roles(len(hashes)):
            signatures, empty = band.signatures(hashes, mixed)
            need = differences(len(hashes)) + 1 if band.exact else len(signatures)
            if not probes:
                need = 0
            self.parts.append((signatures, empty, number, need))
            self.count += len(signatures)

    def packed(self, flush: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(group, signatures, documents with probe bits) of what was added."""
        if not self.parts:
            return
        sizes = np.array([len(p[0]) for p in self.parts])
        signature = np.concatenate([p[0] for p in self.parts])
        empty = np.concatenate([p[1] for p in self.parts])
        document = np.repeat(np.array([p[2] for p in self.parts], np.uint32), sizes)
        needed = np.array([p[3] for p in self.parts], np.int32)
        self.parts.clear()
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # the rarest signatures here are the cheapest to probe; empty segments come last
        order = np.argsort(signature)
        run = signature[order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        del run
        counts = np.diff(np.append(first, len(signature))).astype(np.int32)
        cost = np.empty(len(signature), np.int32)
        cost[order] = np.repeat(counts, counts)
        cost[empty] = np.iinfo(np.int32).max
        order = np.lexsort((cost, part))
        del cost
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        del order
        probing = rank < needed[part]
        del rank, part
        word = document << np.uint32(1) | probing
        del document
        short = (signature // np.uint64(self.groups)).astype("<u4")
        # a set probes empty segments only if it has too few others; such a signature is shared by many sets, which lie in ``fan`` of the groups,
        # and the rare rows that probe it go to all of these
        fan = math.isqrt(self.groups - 1) + 1
        at = np.where(empty, signature + mix64(np.array([flush], np.uint64))[0] % np.uint64(fan), signature)
        group = (at % np.uint64(self.groups)).astype(np.int64)
        wide = np.flatnonzero(empty & probing)
        if len(wide):
            keep = np.flatnonzero(~(empty & probing))
            every = ((np.repeat(signature[wide], fan) + np.tile(np.arange(fan, dtype=np.uint64), len(wide))) % np.uint64(self.groups)).astype(np.int64)
            group = np.concatenate([group[keep], every])
            short, word = (np.concatenate([x[keep], np.repeat(x[wide], fan)]) for x in (short, word))
        order = np.lexsort((short, group))
        group, short, word = group[order], short[order], word[order]
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        start = 0
        width = np.dtype("<u2") if len(self.ids) < 1 << 15 else np.dtype("<u4")
        for end in ends:
            yield int(group[start]), short[start:end].tobytes(), word[start:end].astype(width).tobytes()
            start = end


# Kinds of rows.
SIGNATURES, DOCUMENTS, COPIES, NAMES, STARS, BUCKETS = range(6)
_ROW = "grp int, kind int, flush long, a binary, b binary"


def _sign(groups: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        bands, turn = Bands(), 0
        packer, ids, sizes = Packer(bands, groups), [], []

        def rows() -> Iterator[pa.RecordBatch]:
            flush = task << 24 | turn
            spread = mix64(np.array([flush], np.uint64))[0] % np.uint64(groups)
            known = np.array([i is not None for i in ids], bool)
            yield from emit(
                [
                    (int(spread), DOCUMENTS, flush, np.packbits(known).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(sizes, "<i8").tobytes()),
                    (int(spread), COPIES, flush, np.array([a for a, _ in packer.copies], "<i8").tobytes(), np.array([b for _, b in packer.copies], "<i8").tobytes()),
                    (int(spread), NAMES, flush, np.array(packer.ids, "<i8").tobytes() + np.array(packer.sizes, "<i8").tobytes() + b"".join(packer.digests), b"".join(packer.sketches)),
                ]
            )
            held = []
            for g, a, b in packer.packed(flush):
                held.append((g, SIGNATURES, flush, a, b))
                if len(held) >= 64:
                    yield from emit(held)
                    held = []
            yield from emit(held)

        def emit(found: list) -> Iterator[pa.RecordBatch]:
            if found:
                g, k, f, a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(f, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["grp", "kind", "flush", "a", "b"])

        for part in arrow_rows(batches, ["doc_id", "text"], 1024):
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                hashes = shingle_set(words_of(text or ""))
                ids.append(doc_id)
                sizes.append(len(hashes))
                if doc_id is not None and len(hashes):
                    packer.add(doc_id, hashes)
                if len(ids) >= PACK_DOCS or packer.count >= PACK_SIGNATURES:
                    yield from rows()
                    turn += 1
                    packer, ids, sizes = Packer(bands, groups), [], []
        if ids:
            yield from rows()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One group: stars around a probing member of each signature, and the signatures with three members or more."""
    kinds, flushes = table.column("kind").to_pylist(), table.column("flush").to_pylist()
    a_all, b_all = table.column("a"), table.column("b")
    out: list[tuple] = []
    signature, member, probes = [], [], []
    for i, kind in enumerate(kinds):
        a, b = a_all[i].as_py(), b_all[i].as_py()
        if kind != SIGNATURES:
            out.append((0, kind, flushes[i], a, b))
            continue
        found = np.frombuffer(a, "<u4")
        word = np.frombuffer(b, np.dtype(f"<u{len(b) // len(found)}")).astype(np.int64)
        signature.append(found)
        member.append(flushes[i] << 15 | word >> 1)
        probes.append((word & 1).astype(bool))
    if signature:
        s, m, p = np.concatenate(signature), np.concatenate(member), np.concatenate(probes)
        signature.clear(), member.clear(), probes.clear()
        order = np.lexsort((m, s))
        s, m, p = s[order], m[order], p[order]
        first = np.append(True, s[1:] != s[:-1])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(s)))
        live = (sizes > 1) & np.logical_or.reduceat(p, starts)
        run = np.cumsum(first) - 1
        keep = live[run]
        s, m, p = s[keep], m[keep], p[keep]
        if len(s):
            starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sizes = np.diff(np.append(starts, len(s)))
            centre = np.repeat(np.minimum.reduceat(np.where(p, m, np.iinfo(np.int64).max), starts), sizes)
            edge = centre != m
            pairs = np.unique(np.stack([np.minimum(centre, m)[edge], np.maximum(centre, m)[edge]], 1), axis=0) if edge.any() else np.zeros((0, 2), np.int64)
            out.append((0, STARS, 0, pairs[:, 0].astype("<i8").tobytes(), pairs[:, 1].astype("<i8").tobytes()))
            seen = set()
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                raw = (m[start : start + size].astype("<i8").tobytes(), np.packbits(p[start : start + size]).tobytes())
                if (key := xxhash.xxh3_128_digest(raw[0] + raw[1])) not in seen:
                    seen.add(key)
                    out.append((0, BUCKETS, int(size), *raw))
    g, k, f, a, b = zip(*out, strict=True) if out else ([], [], [], [], [])
    return pa.Table.from_arrays([pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(f, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["grp", "kind", "flush", "a", "b"])


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in arrow_rows(batches, ["a", "b"], 64):
        for a, b in zip(rows["a"], rows["b"], strict=True):
            yield _longs(["x", "y"], np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, n, digest, brief and full sketch of the packed documents, by the number they have in their pack."""
    for rows in arrow_rows(batches, ["flush", "a", "b"], 8):
        for flush, a, b in zip(rows["flush"], rows["a"], rows["b"], strict=True):
            ids, sizes, *digests = np.frombuffer(a, "<i8").reshape(4, -1)
            digests = np.stack(digests).reshape(-1, 2)
            bits = [sketch_bits(int(n)) // 8 for n in sizes]
            sketches = [b[e - w : e] for e, w in zip(np.cumsum(bits).tolist(), bits, strict=True)]
            briefs = [folded(_words(x), brief_bits(int(n)) // 64).tobytes() for x, n in zip(sketches, sizes, strict=True)]
            longs = [(flush << 15) + np.arange(len(ids)), ids, sizes, digests[:, 0], digests[:, 1]]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array(briefs, pa.binary()), pa.array(sketches, pa.binary())], names=["rid", "doc_id", "n", "d1", "d2", "brief", "sketch"])


def _words(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u8")[None, :]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges whose sketches leave a link possible, and whether the sets are the same."""
    for rows in arrow_rows(batches, ["a", "b", "na", "nb", "da", "db", "sa", "sb"], 4096):
        kept = []
        for a, b, na, nb, da, db, sa, sb in zip(*rows.values(), strict=True):
            if a == b:
                continue
            words = min(len(sa), len(sb)) // 8
            if da == db or may_link(int(np.bitwise_count(folded(_words(sa), words) ^ folded(_words(sb), words)).sum()), na, nb):
                kept.append((min(a, b), max(a, b), int(da == db)))
        yield _longs(["a", "b", "same"], *np.array(kept, np.int64).reshape(-1, 3).T)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in arrow_rows(batches, ["a", "b"], 64):
        for a, b in zip(rows["a"], rows["b"], strict=True):
            sizes = np.frombuffer(b, "<i8")
            n = len(sizes)
            known = np.unpackbits(np.frombuffer(a, np.uint8)[: -(-n // 8)])[:n].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a[-(-n // 8) :], "<i8"), pa.int64(), mask=~known), pa.array(sizes, pa.int64())], names=["doc_id", "n_shingles"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket (two words of its hash), rid, probes."""
    for rows in arrow_rows(batches, ["a", "b"], 256):
        parts = []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            m = np.frombuffer(a, "<i8")
            key = np.frombuffer(xxhash.xxh3_128_digest(a + b), "<i8")
            parts.append((np.full(len(m), key[0]), np.full(len(m), key[1]), m, np.unpackbits(np.frombuffer(b, np.uint8))[: len(m)].astype(np.int64)))
        if parts:
            yield _longs(["k1", "k2", "rid", "probes"], *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _squeeze(shared):  # noqa: ANN001, ANN202
    """Texts of the ids that pass the filter, as compressed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
        tool = zstd.ZstdCompressor(level=3)
        for batch in batches:
            wanted = bits[batch.column(batch.schema.get_field_index("h")).to_numpy()]
            for rows in arrow_rows([batch.filter(pa.array(wanted))], ["doc_id", "text"], 1024):
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array([tool.compress(b" ".join(words_of(t or ""))) for t in rows["text"]], pa.binary())], names=["doc_id", "z"])

    return run


class Sets:
    """Shingle sets of compressed texts; the last few are kept."""

    def __init__(self, room: int = 512) -> None:
        self.tool, self.room, self.held = zstd.ZstdDecompressor(), room, OrderedDict()

    def __call__(self, z: bytes) -> np.ndarray:
        if z in self.held:
            self.held.move_to_end(z)
            return self.held[z]
        got = self.held[z] = shingle_set(self.tool.decompress(z).split())
        if len(self.held) > self.room:
            self.held.popitem(last=False)
        return got


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Sets()
    for rows in arrow_rows(batches, ["a", "b", "za", "zb"], 1024):
        good = []
        for a, b, za, zb in zip(*rows.values(), strict=True):
            x, y = sets(za), sets(zb)
            if len(x) * 100 >= PERCENT * len(y) and len(y) * 100 >= PERCENT * len(x):
                both = np.concatenate([x, y])
                both.sort()
                if links(int((both[1:] == both[:-1]).sum()), len(x), len(y)):
                    good.append((a, b))
        yield _longs(["a", "b"], np.array([a for a, _ in good], np.int64), np.array([b for _, b in good], np.int64))


class Members:
    """Members of buckets: document, component, whether it probes, size of its set, sketch."""

    def __init__(self, ids: np.ndarray, components: np.ndarray, probes: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> None:
        self.ids, self.components, self.probes, self.sizes = ids, components, probes.astype(bool), sizes
        self.lengths = np.array([len(x) // 8 for x in sketches], np.int64)
        self.place = np.zeros(len(ids), np.int64)
        self.rows = {}
        for n in np.unique(self.lengths):
            at = np.flatnonzero(self.lengths == n)
            self.place[at] = np.arange(len(at))
            self.rows[int(n)] = np.frombuffer(b"".join(sketches[i] for i in at), "<u8").reshape(len(at), n)

    def open(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs lie in different components, one of the two probes, and their sizes allow a link."""
        a, b = self.sizes[i], self.sizes[j]
        return (self.components[i] != self.components[j]) & (self.probes[i] | self.probes[j]) & (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs' sketches leave a link possible; pairs that occur several times are compared once."""
        pairs = np.stack([np.minimum(self.ids[i], self.ids[j]), np.maximum(self.ids[i], self.ids[j])], 1)
        order = np.lexsort(pairs.T)
        new = np.ones(len(order), bool)
        new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(1)
        x, y = i[order[new]], j[order[new]]
        once = np.zeros(len(x), bool)
        shape = self.lengths[x] << 32 | self.lengths[y]
        for s in np.unique(shape):
            which = np.flatnonzero(shape == s)
            m, n = int(s >> 32), int(s & 0xFFFFFFFF)
            for part in np.array_split(which, len(which) * max(m, n) // (1 << 20) + 1):
                a, b = self.rows[m][self.place[x[part]]], self.rows[n][self.place[y[part]]]
                distance = np.bitwise_count(folded(a, min(m, n)) ^ folded(b, min(m, n))).sum(1, dtype=np.int64)
                once[part] = may_link(distance, self.sizes[x[part]], self.sizes[y[part]])
        out = np.empty(len(order), bool)
        out[order] = once[np.cumsum(new) - 1]
        return out


def near_pairs(bucket: np.ndarray, members: Members, few: int = 64, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of members of one bucket, of different components and one of them probing, whose sketches leave a link possible. ``bucket`` is sorted."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(bucket)))

    def take(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keep = members.open(i, j)
        if keep.any():
            i, j = i[keep], j[keep]
            near = members.near(i, j)
            yield i[near], j[near]

    left, held, count = np.flatnonzero(np.repeat(sizes <= few, sizes)), [], 0  # small buckets all at once: first the next neighbours, then those after
    for step in range(1, few):
        left = left[left + step < len(bucket)]
        left = left[bucket[left] == bucket[left + step]]
        if not len(left):
            break
        held.append((left, left + step))
        count += len(left)
        if count >= chunk:
            yield from take(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    if held:
        yield from take(*(np.concatenate(x) for x in zip(*held, strict=True)))
    for start, size in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
        every = np.arange(start, start + size)
        for part in np.array_split(every, size * size // chunk + 1):
            i, j = np.repeat(part, size), np.tile(every, len(part))
            yield from take(i[i < j], j[i < j])


def _by_bucket(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray, Members]]:
    """Whole buckets, some ``rows`` rows at a time, of rows that arrive bucket by bucket."""

    def made(table: pa.Table, bucket: np.ndarray) -> tuple[pa.Table, np.ndarray, Members]:
        column = lambda n: table.column(n).to_numpy()
        return table, bucket, Members(column("doc_id"), column("component"), column("probes"), column("n"), table.column("sketch").to_pylist())

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            bucket = _bucket_numbers(table)
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last one may go on
            if whole:
                yield made(table.slice(0, whole), bucket[:whole])
            held = table.slice(whole).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield made(table, _bucket_numbers(table))


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a near one in their bucket."""
    for table, bucket, members in _by_bucket(batches):
        keep = np.zeros(len(bucket), bool)
        for i, j in near_pairs(bucket, members):
            keep[i] = keep[j] = True
        yield from table.select(_PLACED).filter(pa.array(keep)).to_batches()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of near pairs."""
    for _, bucket, members in _by_bucket(batches):
        for i, j in near_pairs(bucket, members):
            a, b = members.ids[i], members.ids[j]
            got = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield _longs(["a", "b"], got[:, 0], got[:, 1])


_PLACED = ["k1", "k2", "i", "j", "rid", "component", "probes"]


def _bucket_numbers(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(n).to_numpy().astype(np.int64) for n in ("k1", "k2", "i", "j")])
    return np.cumsum(np.append(False, (keys[:, 1:] != keys[:, :-1]).any(0)))


def verified(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (a, b, each once) whose texts link."""
    spark = docs.sparkSession
    wanted = materialise(edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).distinct())
    # a filter of fixed size, so that most texts don't have to be shuffled; the joins decide
    shared = spark.sparkContext.broadcast(id_filter(wanted, "doc_id"))
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", filter_place(F.col("doc_id")).alias("h"))
    texts = materialise(some.mapInArrow(_squeeze(shared), "doc_id long, z binary"), "none")
    side = lambda a, z: texts.select(F.col("doc_id").alias(a), F.col("z").alias(z))
    good = materialise(edges.join(side("a", "za"), "a").join(side("b", "zb"), "b").select("a", "b", "za", "zb").mapInArrow(_verify, "a long, b long").distinct())
    forget(texts)
    forget(wanted)
    return good


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * sizes_of(docs))
    signed = docs.mapInArrow(_sign(groups), _ROW)
    met = materialise(signed.groupBy("grp").applyInArrow(_meet, _ROW))
    kind = lambda k: met.where(F.col("kind") == k)
    names = materialise(kind(NAMES).select("flush", "a", "b").mapInArrow(_names, "rid long, doc_id long, n long, d1 long, d2 long, brief binary, sketch binary"), "none")
    counts = materialise(kind(DOCUMENTS).select("a", "b").mapInArrow(_counts, "doc_id long, n_shingles long"))
    copies = materialise(kind(COPIES).select("a", "b").mapInArrow(_pairs, "x long, y long").select(F.col("x").alias("a"), F.col("y").alias("b")))
    end = lambda x, a, n, d, z: names.select(F.col("rid").alias(x), F.col("doc_id").alias(a), F.col("n").alias(n), F.struct("d1", "d2").alias(d), F.col("brief").alias(z))

    # stars
    stars = kind(STARS).select("a", "b").mapInArrow(_pairs, "x long, y long").distinct()
    named = stars.join(end("x", "a", "na", "da", "sa"), "x").join(end("y", "b", "nb", "db", "sb"), "y").select("a", "b", "na", "nb", "da", "db", "sa", "sb")
    near = materialise(named.mapInArrow(_near, "a long, b long, same long").distinct())
    good = verified(docs, near.where("same = 0").select("a", "b"))
    first = materialise(components(good.unionByName(copies).unionByName(near.where("same = 1").select("a", "b"))))

    # signatures whose members are not all of one component
    members = kind(BUCKETS).select("a", "b").mapInArrow(_members, "k1 long, k2 long, rid long, probes long").distinct()
    placed = members.join(names.select("rid", "doc_id"), "rid").join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = materialise(placed.select("k1", "k2", "rid", "probes", F.coalesce("component", "doc_id").alias("component")))
    forget(met)
    blocks = lambda probes: F.ceil(F.sum((F.col("probes") == probes).cast("long")) / BLOCK).cast("int")
    open_ = placed.groupBy("k1", "k2").agg(F.min("component").alias("least"), F.max("component").alias("most"), blocks(1).alias("asking"), blocks(0).alias("silent")).where("least <> most")
    rows = placed.join(open_.drop("least", "most"), ["k1", "k2"])
    # of two members one must probe: blocks of probing members meet each other and the others'
    mine = F.pmod(F.xxhash64("rid"), F.when(F.col("probes") == 1, F.col("asking")).otherwise(F.col("silent"))).cast("int")
    others = F.when(F.col("probes") == 1, F.col("asking") + F.col("silent")).otherwise(F.col("asking"))
    rows = rows.withColumn("mine", mine + F.when(F.col("probes") == 1, 0).otherwise(F.col("asking"))).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    rows = rows.select("k1", "k2", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rid", "component", "probes")

    def together(rows: DataFrame, sketch: str) -> DataFrame:
        """A bucket's rows, at most two blocks, one after another in one partition."""
        faced = rows.join(names.select("rid", "doc_id", "n", F.col(sketch).alias("sketch")), "rid")
        return faced.repartition("k1", "k2", "i", "j").sortWithinPartitions("k1", "k2", "i", "j")

    some = materialise(together(rows, "brief").mapInArrow(_with_partners, "k1 long, k2 long, i int, j int, rid long, component long, probes long"))
    later = materialise(together(some, "sketch").mapInArrow(_compare, "a long, b long").distinct())
    forget(placed)
    forget(some)
    forget(names)
    final = materialise(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(docs, later))))
    for done in (near, good, copies, first, later):
        forget(done)

    out = counts.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: All pairs that share a shingle, and what can be reached over the links.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p : p + 4], ' '))) AS g FROM d WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs p JOIN sizes s ON s.doc_id = p.x JOIN sizes t ON t.doc_id = p.y WHERE 100 * c >= 80 * (s.n + t.n - c)), ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN ends b ON b.x = r.other)
SELECT r.doc_id, any_value(coalesce(s.n, 0)) AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
