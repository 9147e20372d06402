"""Jaccard join, components, packing, sharding, the pipeline."""

import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import jaccard_join as J
from millrace.llm import packing, sharding
from millrace.llm.common import mix64, shingle_set, words_of
from millrace.llm.components import components


def brute_groups(docs):
    """Component of each id by comparing all pairs of sets."""
    sets = [(i, set(shingle_set(words_of(t or "")).tolist())) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i, j = root(i), root(j)
                up[max(i, j)] = min(i, j)
    return {i: root(i) for i in up}


def families(seed, base_words, copies, edits):
    """Texts that stand at all distances from a few base texts."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    out = []
    for words in base_words:
        base = rng.choice(vocabulary, words)
        for _ in range(copies):
            new = base.copy()
            n = int(rng.integers(0, max(1, int(words * edits)) + 1))
            new[rng.choice(words, n, replace=False)] = rng.choice(vocabulary, n)
            out.append(" ".join(new))
    return out


@pytest.mark.parametrize(("seed", "words", "copies", "edits"), [(1, (3, 4, 5, 6, 8, 9, 12, 15), 25, 0.2), (2, (20, 30, 45, 54, 60, 80), 30, 0.06), (3, (150, 400), 60, 0.08)])
def test_components_match_brute_force(spark, seed, words, copies, edits):
    docs = list(enumerate(families(seed, words, copies, edits)))
    docs += [(10_000, docs[0][1]), (10_001, docs[1][1].upper()), (10_002, None), (10_003, ""), (10_004, " \t\n"), (None, docs[0][1]), (10_005, "one two"), (10_006, "One  two"), (10_007, "two one"), (7, docs[7][1]), (7, docs[-1][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string").repartition(5)
    rows = J.near_duplicates(frame).collect()
    expected = brute_groups(docs)
    assert len(rows) == len(docs) and {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == expected
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert sorted(r.n_shingles for r in rows) == sorted(len(shingle_set(words_of(t or ""))) for _, t in docs)
    assert len(set(expected.values())) < len(expected)


def test_shared_passage_and_hot_copies(spark):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"{' '.join(rng.choice(9000, 80).astype(str))} {passage} {' '.join(rng.choice(9000, 40).astype(str))}") for i in range(150)]
    docs += [(1000 + i, "the very same text in many rows " * 8) for i in range(200)]
    rows = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: min(i, 1000) for i, _ in docs}
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_leave_no_pair_out():
    """For every pair of sizes that can link, both sets have signatures of the smaller one's band, and the segments suffice."""
    bands = J.Bands()
    for a in range(1, 400):
        for b in range(a, a * 100 // J.PERCENT + 1):
            band = bands.of(a)
            assert band in [x for x, _ in bands.roles(b)]
            assert J.differences(a) >= (a + b) * (100 - J.PERCENT) // (100 + J.PERCENT)
            units = len(band.salts) if band.exact else len(band.salts) + band.deletions
            assert units >= J.differences(a) + 1


def test_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for n in (3, 40, 300, 9000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for m in (0, 1, n // 10):
            y = np.unique(np.concatenate([x[m:], rng.integers(0, 1 << 63, m + n // 7, dtype=np.uint64)]))
            a, b = (np.frombuffer(J.sketch(mix64(s)), "<u8")[None] for s in (x, y))
            words = min(a.shape[1], b.shape[1])
            apart = int(np.bitwise_count(J.folded(a, words) ^ J.folded(b, words)).sum())
            assert apart <= len(np.setxor1d(x, y)) and (m or n < 7 or apart > 0)


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 600, (400, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2200)] + [(5, 5)]
    up = defaultdict(set)
    for a, b in edges:
        if a != b:
            up[a].add(b)
            up[b].add(a)
    expected, seen = {}, set()
    for s in sorted(up):
        todo = [s] if s not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                expected[x] = s
                todo += up[x]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_packing(rows, docs, length=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t, _ in docs]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for (i, _, _), have in zip(docs, ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(have)) and r.length > 0 and r.ids_crc32 == zlib.crc32(have[at : at + r.length].tobytes())
            at += r.length
        assert at == len(have)
    padding = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0 and sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_packing_round_trip(spark):
    docs = [(i, " ".join(["words", "and", "<|endoftext|>", f"n{i}"] * (i % 50)), f"s{i % 7 % 3}") for i in range(120)] + [(500, None, "s1"), (501, "", None), (502, "x" * 30_000, None), (503, "é" * 10, "rare")]
    frame = spark.createDataFrame([(i, t, s, 1) for i, t, s in docs], "doc_id long, text string, source string, length int").repartition(4)
    check_packing(packing.pack(frame).collect(), docs)
    assert packing.pack(frame.limit(0)).count() == 0


def test_packing_keeps_the_mixture():
    totals = [900_000, 70_001, 33, 250_000]
    plan = packing.Schedule(totals, 2048, 4 * 2048)
    for w in range(1, plan.all // plan.window):
        sent = [plan.sent(q, w + 1) - plan.sent(q, w) for q in range(4)]
        assert all(abs(n - plan.window * t / plan.all) < 1 for n, t in zip(sent, totals))
        assert all(0 <= w * plan.window * t / plan.all - plan.sent(q, w) < 1 for q, t in enumerate(totals))
    places = np.zeros(plan.all, bool)
    for q, t in enumerate(totals):
        for start in range(0, t, 50_000):  # as if partitions went on with the deficits of those before
            for _, n, s, o in plan.pieces(q, start, min(50_000, t - start)):
                at = s * 2048 + o if s < plan.full else plan.tail[s - plan.full] + o
                assert not places[at : at + n].any()
                places[at : at + n] = True
    assert places.all()


def test_fast_tokenizer_gives_the_same_ids(data, spark):
    path, ranks, pattern = packing.public_encoder()
    fast, plain = packing.Encoder(path, ranks, pattern), packing.Encoder(path)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["", "<|endoftext|>", "a<|endoftext|>b", "\u0000￿", "  \n\n\t x", "日本語 🎉", "don't'll"]
    for t in texts:
        assert (fast(t) == plain(t)).all()


def test_best_fit_decreasing_matches_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        items = [(int(s), f"i{k}") for k, s in enumerate(rng.integers(0, 100, 150))]
        where, loads = sharding.pack(items, 130)
        rooms, expected = [], {}
        for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
            fits = [(room, b) for b, room in enumerate(rooms) if room >= size]
            if fits:
                _, b = min(fits)
            else:
                b = len(rooms)
                rooms.append(130)
            rooms[b] -= size
            expected[name] = b
        assert where == expected and loads == [130 - r for r in rooms]


def check_shards(rows, docs, shards=24):
    assert len(rows) == len(docs)
    where, slots, size = defaultdict(set), defaultdict(list), defaultdict(int)
    text = defaultdict(list)
    for i, t in docs:
        text[i].append(t)
    for r in rows:
        assert r.size in {8 + len((t or "").encode()) for t in text[r.doc_id]} and r.text_crc32 in {zlib.crc32((t or "").encode()) for t in text[r.doc_id]} and 0 <= r.shard < shards
        where[text[r.doc_id][0]].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_shards(spark):
    rng = np.random.default_rng(8)
    docs = [(i, "t" * int(n) + str(i)) for i, n in enumerate(rng.integers(0, 3000, 900))] + [(2000 + i, "hot " * 400) for i in range(30)] + [(3000, None), (3001, None), (3002, ""), (3003, "é")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, shard string").repartition(5)
    size = check_shards(sharding.shard(frame).collect(), docs)
    rest = sorted(size.values())
    assert len(rest) == 24 and rest[-1] <= 1.01 * max(sum(rest) / 24, 30 * 1608 + 1)
    few = [(1, "a"), (1, "a"), (None, "b")]
    rows = sharding.shard(spark.createDataFrame(few, "doc_id long, text string"), 4).collect()
    assert len(rows) == 3 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard(frame.limit(0)).count() == 0


def test_pipeline_against_its_parts(spark, data):
    import corpus_pipeline
    from millrace.llm import decontamination, pii, quality
    from millrace.llm.common import shingle_hashes, words_of
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {n: None for n, _ in corpus_pipeline.STAGES}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = corpus_pipeline.materialise(stage(spark, current, data))
        assert current.columns == docs.columns
        kept[name] = {r.doc_id: r for r in current.collect()}
    scored = quality.score(spark, docs, quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), quality.fold_of(F.col("doc_id"), 5) != 0)).collect()
    assert set(kept["quality"]) == {r.doc_id for r in scored if r.score >= 0.3}
    texts = {i: r.text for i, r in kept["quality"].items()}
    groups = brute_groups(list(texts.items()))
    assert set(kept["near duplicates"]) == {i for i in texts if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    index = decontamination.build_index(items)
    clean = {i for i in kept["near duplicates"] if not decontamination.match_batch(index, [words_of(texts[i])], [shingle_hashes(words_of(texts[i]))])}
    assert set(kept["benchmark passages"]) == clean
    hidden = {r.doc_id: r.text for r in pii.pseudonymise(docs.select("doc_id", "text"), pii.DEMO_KEY).collect()}
    assert {i: r.text for i, r in kept["personal data"].items()} == {i: hidden[i] for i in clean}
    assert all(r.n_chars == len(r.text) for r in kept["personal data"].values())
    check_packing(corpus_pipeline.run(spark, data).collect(), [(i, hidden[i], None) for i in sorted(clean)])


def test_packing_to_targets():
    """The closed form against a round-robin that is run token by token."""
    totals, targets = [6000, 9000, 500, 3000, 40], [Fraction("0.5"), Fraction("0.2"), Fraction("0.2"), None, Fraction(0)]
    plan = packing.Schedule(totals, 64, 1000, targets)
    weights, left, sent, now = [5, 2, 2, 1, 0], list(map(Fraction, totals)), [[0] * 5], [Fraction(0)] * 5
    while any(left):
        room = Fraction(1000)
        while room and any(left):
            rates = [w if n else 0 for w, n in zip(weights, left)]
            rates = rates if any(rates) else [t if n else 0 for t, n in zip(totals, left)]
            step = min([room / sum(rates)] + [n / r for n, r in zip(left, rates) if r])
            for q, r in enumerate(rates):
                left[q] -= step * r
                now[q] += step * r
            room -= step * sum(rates)
        sent.append([math.floor(x) for x in now])
    assert [[plan.sent(q, w) for q in range(5)] for w in range(len(sent))] == sent
    assert sent[2][:3] == [1000, 400, 400] and sent[-1] == totals
    places = np.zeros(plan.all, bool)
    for q, t in enumerate(totals):
        for start in range(0, t, 700):  # as if partitions went on with the deficits of those before
            for _, n, s, o in plan.pieces(q, start, min(700, t - start)):
                at = s * 64 + o if s < plan.full else plan.tail[s - plan.full] + o
                assert not places[at : at + n].any()
                places[at : at + n] = True
    assert places.all()
    with pytest.raises(ValueError):
        packing.Schedule([1, 1], targets=[Fraction(2, 3), Fraction(2, 3)])


def test_packing_with_many_sources_and_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "FINEST", 8)
    monkeypatch.setattr(packing, "POOLS", 3)
    docs = [(i, " ".join(["words", f"n{i}"] * (40 if i < 60 else 30)), "big" if i < 60 else None if i == 60 else f"s{i}") for i in range(160)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    check_packing(packing.pack(frame, window=2048).collect(), docs)
    by_sequence = check_packing(packing.pack(frame, targets={"big": 0.25, "s70": 0.05, "absent": 0.1}, window=2048).collect(), docs)
    big = {i for i, _, s in docs if s == "big"}
    assert abs(sum(r.length for r in by_sequence[0] if r.doc_id in big) / 2048 - 0.25) < 0.02
    check_packing(packing.pack(frame, targets={None: 0.5, "big": 0.5}, window=2048).collect(), docs)


def test_pipeline_stages_with_nulls_repeats_and_other_columns(spark, data):
    import corpus_pipeline

    good = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) between 400 and 900").limit(4).collect()]
    item = max((r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()), key=len)
    rows = [(None, good[0]), (None, good[0]), (None, good[1] + " " + item), (None, None), (1, good[2]), (1, good[2]), (1, good[3]), (2, good[3]), (3, ""), (3, None), (4, "a"), (4, good[1] + " " + item), (5, good[2] + " mail bob@mail.example.com")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1.0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, frame: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stages[name](spark, frame, data).select("doc_id", "text").collect()))
    key = lambda found: sorted((i is None, i or 0, t or "") for i, t in found)
    assert set(run("quality", docs)) <= set(key(rows))
    left = [(None, good[0]), (None, None), (1, good[2]), (1, good[3]), (3, ""), (3, None), (4, "a"), (4, good[1] + " " + item)]
    assert run("near duplicates", docs) == key(left)
    assert run("benchmark passages", docs) == key([(i, t) for i, t in rows if item not in (t or "")])
    hidden = stages["personal data"](spark, docs, data).collect()
    assert len(hidden) == len(rows) and not any("bob@" in (r.text or "") for r in hidden)
    packed = stages["packing"](spark, docs, data).where("start = 0").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed) == sorted((i is None, i or 0) for i, _ in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0, name


def test_a_hot_bucket_is_compared_whole(spark):
    """Many texts that share a long passage, of which only some pairs link."""
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    docs = [(i, " ".join(shared + [f"w{rng.randint(0, 5)}{j}" for j in range(14 + i % 9)])) for i in range(260)]
    got = {r.doc_id: r.component_id for r in J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_groups(docs)
