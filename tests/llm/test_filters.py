"""Quality classifier, URL filter, language identification, decontamination."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, language, quality, url_filter
from millrace.llm.common import fold_of, shingle_hashes, shingle_set, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op1_quality_compression(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", 0.5), (2, "", "y", 0.5), (3, "good words here", None, None), (3, "good words here", None, None), (None, "a" * 300_000, "z", 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, 1, 0), (3, 0, 0), (None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.lit(True))
    rows = quality.score(spark, docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[2].score == rows[3].score
    empty = quality.score(spark, docs.limit(0), quality.fit(docs.limit(0), labels.limit(0), F.lit(True)))
    assert empty.columns == ["doc_id", "text", "source", "score"] and not empty.collect()


def test_quality_ignores_other_columns(spark):
    rows = [(i, f"text number {i} of some words", "en", "s", 5) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    a = quality.fit(spark.createDataFrame(rows, DOCS), labels, F.lit(True))
    b = quality.fit(spark.createDataFrame([(i, t, "fr", None, None) for i, t, *_ in rows], DOCS), labels, F.lit(True))
    assert a == b


URLS = [None, "", "no scheme", "http://example.org/es/1", "https://A.Example.ORG/en/17?x", "https://example.org/en/27", "http://example.com/fr/a#b", "http://example.com/de/", "http://example.com/", "http://org", "http://org/", "x://example.org", "http://notorg/es/", "http://example.org:80/es/", "ftp://a.b.org/x?y=/es/", "http:///path", "http://com/fr/", "http://comm/fr/", "http://example.org/ES/1", "http://é.org/ü"]


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "?#":
            rest = rest.split(mark)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *best


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, pages, url_filter.RULES).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS + URLS)}
    assert url_filter.judge(spark, pages.limit(0), url_filter.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(spark, pages, []).collect()} == {"allow"}


def test_url_collisions_are_confirmed_by_text(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda keys: np.array([7 for _ in keys], np.uint64))
    path = tmp_path / "index"
    path.write_bytes(url_filter.build(url_filter.RULES))
    got = url_filter.DigestArray.map(str(path)).judge(URLS)
    assert [*zip(got["host"], got["path"], got["rule"], got["verdict"])] == [brute_url(u) for u in URLS]


def walk(samples, text, order=language.ORDER):
    """Code lengths byte by byte over plain context trees."""
    out = []
    for g in sorted(samples):
        trees = [defaultdict(Counter) for _ in range(order + 1)]
        for t in samples[g]:
            for i, b in enumerate(t):
                for k in range(min(i, order) + 1):
                    trees[k][t[i - k : i]][b] += 1
        bits = 0.0
        for i, b in enumerate(text):
            for k in range(min(i, order), -1, -1):
                seen = trees[k].get(text[i - k : i])
                if seen:
                    n = sum(seen.values()) + len(seen)
                    if b in seen:
                        bits -= np.log2(seen[b] / n)
                        break
                    bits -= np.log2(len(seen) / n)
            else:
                bits += 8
        out.append(bits)
    return out


def test_language_code_lengths_are_exact():
    samples = {"en": [b"the cat sat on the mat", b"a hat"], "fr": ["le chat est là".encode(), b""], "xx": [b"zzzzzz"]}
    model = language.compile_trees(samples)
    texts = [b"the cat", "là là".encode(), b"q", b"", b"zz the \xff\xfe", b"the mat on the chat"]
    assert np.allclose(model.lengths(texts), [walk(samples, t) for t in texts], atol=1e-3)


def test_language_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in language.op3_language_ppm(spark, sf).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [got[i].lang_pred == g for i, g in langs.items() if got[i].held_out]
    assert np.mean(held) > 0.95 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    docs = spark.createDataFrame([(1, "the words of a text", "en", "a"), (2, "les mots du texte", "fr", "b"), (3, None, None, "c"), (4, "12 34 !!", "en", "d"), (5, "", "en", "e"), (6, "the", "en", "f"), (6, "the", "en", "f")], "doc_id long, text string, lang string, score string")
    model = language.fit(docs, F.lit(True))
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark, docs, model).collect()}
    assert rows[3] == rows[4] == rows[5] == ("und", 0.0) and rows[1][0] == "en" and rows[2][0] == "fr" and all(0 <= s <= 1 for _, s in rows.values())
    none = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(spark, docs, none).collect()} == {"und"}


def brute_leaks(docs, items):
    sets = [(i, set(shingle_hashes(words_of(t or "")).tolist())) for i, t in items]
    out = []
    for d, t in docs:
        have = set(shingle_hashes(words_of(t or "")).tolist())
        out += [(d, i, len(s), len(s & have)) for i, s in sets if s and 100 * len(s & have) >= 80 * len(s)]
    return sorted(out, key=str)


def test_contained_items_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(5, 90, 60))] + [(900, None), (901, ""), (902, "two words"), (903, "  "), (3, text(20))]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 400, 80))]
    for k in range(40):
        words = items[k][1].split()
        if k % 3 == 1:
            words[len(words) // 2] = "changed"
        docs.append((1000 + k, f"{text(int(rng.integers(0, 300)))} {' '.join(words).upper()} {text(int(rng.integers(0, 3000)))}"))
    docs += [(2000, None), (2001, ""), (2002, "two words"), (2002, "two words"), (None, items[0][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    got = decontamination.contained_items(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()), key=str) == brute_leaks(docs, items)
    assert decontamination.contained_items(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.contained_items(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contained_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect()}
    assert got == {(d, i) for d, i, *_ in brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])} and got


def test_shingles():
    assert len(shingle_set([])) == 0 and len(shingle_set([b"a", b"b"])) == 1
    assert len(shingle_set(words_of("a b c d e f g a b c d e"))) == 7  # eight places, the first and last alike
    assert words_of("A\tÄ\x0bb\xa0c") == [b"a", "Ä".encode(), "b\xa0c".encode()]


@pytest.mark.parametrize("folds", [4, 5])
def test_folds(spark, folds):
    rows = spark.range(50).select("id", fold_of(F.col("id"), folds).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % folds for r in rows)


def test_long_hosts_cost_little(tmp_path):
    """A host of very many labels is probed at the lengths that rules have, and nothing else."""
    import time
    import tracemalloc

    path = tmp_path / "index"
    path.write_bytes(url_filter.build(url_filter.RULES))
    array = url_filter.DigestArray.map(str(path))
    urls = ["http://" + "a." * 50_000 + "example.org/es/x", "http://" + "." * 100_000 + "com/de/", "http://" + "x" * 100_000 + "org/", "http://" + "a." * 50_000 + "org"]
    tracemalloc.start()
    start = time.perf_counter()
    got = array.judge(urls)
    assert time.perf_counter() - start < 1 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert got["rule"] == ["example.org/es/", "com/de/", None, None]
    long_rule = ("b." * 5000 + "net", "/", "block")
    path.write_bytes(url_filter.build([*url_filter.RULES, long_rule]))
    assert url_filter.DigestArray.map(str(path)).judge([f"x://c.{long_rule[0]}/p", f"x://c{long_rule[0]}/p"])["verdict"] == ["block", "allow"]
