"""Consistent weighted sampling against plain Python and against the generalised Jaccard similarity."""

import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprints as P


def bag(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w)


def likeness(a, b):
    both = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both) if both else 1.0


def signature(weights):
    """The samples of a bag in plain Python."""
    best = [None] * P.SAMPLES
    for word, n in weights.items():
        term = xxhash.xxh64_intdigest(word.encode(), 42)
        for k in range(P.SAMPLES):
            first, second = (xxhash.xxh64_intdigest(struct.pack("<i", 2 * k + i), xxhash.xxh64_intdigest(struct.pack("<Q", term), 42)) for i in (0, 1))
            u = lambda bits, at, width: ((bits >> at & ((1 << width) - 1)) + 0.5) / float(1 << width)
            r, b, c = -math.log(u(first, 0, 21) * u(first, 21, 21)), u(first, 42, 22), -math.log(u(second, 0, 32) * u(second, 32, 32))
            t = math.floor(math.log(n) / r + b)
            a = math.floor((math.log(c) - r * (t - b + 1) + 128) * (1 << 23)) << 32 | (second ^ t) & 0xFFFFFFFF
            best[k] = a if best[k] is None else min(best[k], a)
    return "".join(f"{a & 0xFFFFFFFF:08x}" for a in best) if weights else ""


def edited(docs):
    """doc_id -> edited text, for distinct ids."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        out[i] = (text[: len(text) - half] + after[:half], after)
    return out


def test_whole_result_matches_plain_python(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len(d[1] or "") < 4000][:70] + [(-5, None), (-6, ""), (-7, " \t\n"), (-8, "é😀 A a Ab"), (None, "no id at all"), (2**62, "word " * 3000)]
    frame = spark.createDataFrame([(*d, "x", 3.0) for d in docs], "doc_id long, text string, fingerprint string, n_chars double").repartition(3)
    found = {r.doc_id: r for r in P.edited_fingerprints(frame).collect()}
    assert len(found) == len(docs)
    wrong = 0
    for (i, text), (new, after) in ((d, edited(docs)[d[0]]) for d in docs):
        r = found[i]
        assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        prints = [signature(bag(x)) for x in (text, new, after)]
        cut = [[p[8 * k : 8 * k + 8] for k in range(P.SAMPLES)] if p else [] for p in (r.fingerprint, r.edited_fingerprint)]
        own = [[p[8 * k : 8 * k + 8] for k in range(P.SAMPLES)] if p else [] for p in prints]
        wrong += sum(x != y for a, b in zip(cut, own, strict=False) for x, y in zip(a, b, strict=True))  # the last digit of a logarithm may differ
        share = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else sum(map(str.__eq__, a, b)) / P.SAMPLES
        assert abs(r.near_edited - share(*cut)) < 1e-12 and abs(r.near_next - share(own[0], own[2])) <= 1 / P.SAMPLES
    assert wrong <= len(docs) * 2 * P.SAMPLES // 1000


def test_collisions_estimate_generalised_jaccard(spark):
    rng = np.random.default_rng(4)
    bags = []
    for _ in range(300):
        base = {int(t): int(w) for t, w in zip(rng.integers(0, 400, 60), rng.integers(1, 40, 60), strict=True)}
        other = {t: int(rng.integers(1, 40)) if rng.random() < 0.5 else w for t, w in base.items() if rng.random() < 0.8}
        bags += [base, other]
    rows = [(i, t * 7919 + i // 2 * 1_000_003, w) for i, b in enumerate(bags) for t, w in b.items()]
    counted = spark.createDataFrame(rows, "id long, term long, n long").repartition(4)
    signed = {r.id: r.signature for r in P.signatures(counted, ["id"]).collect()}
    errors = []
    for i in range(0, len(bags), 2):
        real = likeness(Counter(bags[i]), Counter(bags[i + 1]))
        errors.append(np.mean([a == b for a, b in zip(signed[i], signed[i + 1], strict=True)]) - real)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.6 / math.sqrt(P.SAMPLES)


def test_repeated_rows_ties_and_one_document(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words"), (2, "a b c d"), (None, None), (None, None)]
    found = P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert len({r.fingerprint for r in found if r.n_chars == 7}) == 1 and len({tuple(r) for r in found if r.doc_id is None}) == 1
    assert len({tuple(r) for r in found if r.doc_id == 1 and r.n_chars == 7}) == 1
    one = P.edited_fingerprints(spark.createDataFrame([(9, "abcde")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcab").hexdigest() and one.near_next == 1.0
    none = P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and none.count() == 0


def test_no_python_in_the_plan(spark, data):
    plan = P.op13_weighted_sampling(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("number", [0, 31])
def test_sample_fits_a_long(spark, number):
    ends = spark.range(1).select(*(P.sample(F.lit(t), F.lit(w), number).alias(f"x{i}") for i, (t, w) in enumerate([(0, 0.0), (-1, 27.7), (2**63 - 1, 20.0)]))).first()
    assert all(0 <= x < 1 << 63 for x in ends)
