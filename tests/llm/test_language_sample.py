"""The samples that models learn from: every language, and all parts of long texts."""

from pyspark.sql import functions as F

from millrace.llm import language, quality


def test_rare_languages_are_learned(spark):
    words = {"aa": "kala maja puu ", "bb": "stein haus baum ", "cc": "piedra casa rbol "}
    rows = [(i, words[g] * 20, g) for i, g in enumerate(["aa"] * 5 + ["bb"] * 4 + ["cc"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), per_language=3, languages=2)
    assert sorted(model.languages) == ["aa", "bb", "cc"]
    assert {r.lang: r.lang_pred for r in language.identify(spark, docs, model).collect()} == {g: g for g in words}


def test_long_texts_teach_to_their_end(spark):
    first, later = "kala maja puu " * 10, "xyzzy plugh quux " * 400
    docs = spark.createDataFrame([(0, first + later, "aa"), (1, "stein haus baum " * 60, "bb")], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), clip=128)
    assert language.predict_batch(model, ["xyzzy plugh quux"])[0] == ["aa"]
    got = docs.select(language.spread(F.col("text"), 128).alias("p")).collect()
    assert [len(r.p) for r in got] == [16, 16] and all(len(x) == 8 for r in got for x in r.p)
    text = first + later
    assert got[0].p[0] == text[:8] and got[0].p[-1] == text[-8:]


def test_quality_sample_reaches_the_end_of_long_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "book", lambda texts, room, piece: seen.extend(texts) or b"x" * 16)
    docs = spark.createDataFrame([(i, "a" * 5000 + f" last{i}", 1) for i in range(4)], "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    quality.fit(docs, labels, F.lit(True), clip=1600)
    assert seen and all(len(t) == 1600 and t[-6:].startswith(" last") for t in seen)
    monkeypatch.undo()
    parts = quality.spread_bytes(b"a" * 5000 + b"end", 160)
    assert len(parts) == 160 and parts.endswith(b"end")


def test_one_id_with_very_many_rows(spark, monkeypatch):
    """The samples are bounded in rows, and a language or label of one id alone is learned."""
    many = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("kala maja puu number "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    same = spark.range(20_000).select(F.lit(6).cast("long").alias("doc_id"), F.lit("stein haus baum und wieder stein").alias("text"), F.lit("bb").alias("lang"))
    docs = many.unionByName(same).repartition(6)
    got, real = [], language.compile_trees
    monkeypatch.setattr(language, "compile_trees", lambda samples, order: got.append({k: len(v) for k, v in samples.items()}) or real(samples, order))
    model = language.fit(docs, F.lit(True), per_language=50, languages=2)
    assert got == [{"aa": 50, "bb": 1}]
    assert language.predict_batch(model, ["maja kala puu", "haus und stein"])[0] == ["aa", "bb"]

    texts, plain = [], quality.book
    monkeypatch.setattr(quality, "book", lambda parts, room, piece: texts.append(len(parts)) or plain(parts, room, piece))
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int")
    quality.fit(docs, labels, F.lit(True), per_label=40)
    assert texts == [20, 1]


def test_quality_scores_match_plain_compression(spark, data):
    """Scores worked out block by block with zstandard's own calls, and the curve by hand."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), quality.fold_of(F.col("doc_id"), 5) != 0)
    found = {r.doc_id: r.score for r in quality.op1_quality_compression(spark, data).collect()}
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(found)
    for r in rows[:60]:
        sizes, data_bytes = [], (r.text or "").encode()
        for book in (model.good, model.bad):
            total = 0
            for at in range(0, len(data_bytes), 512):
                total += len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book), compression_params=params).compress(data_bytes[at : at + 512])) - 2
            sizes.append(total)
        good, bad = sizes
        d, rate = ((bad - good) / (bad + good), math.log(min(good, bad) / len(data_bytes))) if data_bytes else (0.0, 0.0)
        w = model.weights
        assert abs(found[r.doc_id] - 1 / (1 + math.exp(-(w[0] * d + w[1] * rate + w[2] * rate * rate + w[3] * d * rate + w[4])))) < 1e-9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    some = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    assert [r.score for r in quality.score(spark, some, model).collect()] == [0.5, 0.5]
    assert [r.lang_pred for r in language.identify(spark, some, language.fit(docs, F.lit(True))).collect()] == ["und", "und"]
