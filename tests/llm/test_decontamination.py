"""Filters in proportion to the items, and items below a shingle's width."""

import numpy as np

from millrace.llm import decontamination as D


def test_index_of_many_items_is_small():
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    rows = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate(rng.integers(5, 1000, 20_000))]
    index = D.build_index(rows)
    assert index.size() < 200 << 20
    filters = sum(f.nbytes for hashes in index.minima.values() for *_, f in hashes)
    assert filters <= 2 * D.FILTER_ROOM * len(rows) * D.HASHES
    words = [D.words_of(rows[i][1]) for i in (3, 77, 19_999)]
    found = D.match_batch(index, words, [D.shingle_hashes(w) for w in words])
    assert {(d, i) for d, i, *_ in found} == {(0, 3), (1, 77), (2, 19_999)}


def test_short_items_inside_long_documents(spark):
    items = [(1, "alpha Beta gamma"), (2, "one"), (3, "alpha beta gamma"), (4, "not there at all"), (5, "a b c d"), (6, "five words stand here now"), (7, None), (8, " ")]
    filler = "some other words and so on " * 400
    docs = [(1, filler + "ALPHA beta  gamma " + filler), (2, "alpha beta delta gamma"), (3, "one"), (4, "x" * 100_000 + " one"), (5, "A b c d e"), (6, "ones alphabeta"), (7, None), (8, "")]
    held = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert held == {(1, 1, 1, 1), (1, 3, 1, 1), (3, 2, 1, 1), (4, 2, 1, 1), (5, 5, 1, 1)}
    left = D.without_items(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 6, 7, 8]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert D.contained_items(some, items).count() == 0 and D.contained_items(docs, items).count() == 0 and D.without_items(some, items).count() == 1
