"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is the bag of its words (A-Z lowered, split at ASCII white space); a word's weight is how often it stands there. For each of ``SAMPLES`` samples
every word draws r and c from Gamma(2, 1) and b from (0, 1), all from hashes of word and sample, hence the same in every text. With weight w

    t = floor(ln w / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r

and the sample is (word, t) of the least a. Two texts have the same sample with probability sum(min) / sum(max) of their weights, the generalised Jaccard
similarity; the share of equal samples estimates it with a standard error of at most 0.5 / sqrt(SAMPLES). A fingerprint is 32 bits of each sample, as hexadecimal digits.

ln a is held in steps of 2**-23 above the 32 bits in one long, so the least of all words is a plain ``min``, and ties are settled by those bits, alike in all texts.

``edited_fingerprints`` moves each whole text once and the part that its neighbour takes once; counting words and sampling then stay in the
partition of the text's key. Neighbours are found on (id, length) rows alone: a distributed sort numbers them, and one row for each of its partitions says
where the next one begins.

Null texts count as empty. A text without words has the fingerprint ''; two such texts are alike (1), one such text and another aren't (0). Rows that agree in id and text count
as one in the order and get one row each in the result; rows of one id and different texts follow each other by a hash of their text; null ids come last.
A single document is its own neighbour. Other columns don't go on. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, materialise

SAMPLES = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Array of the words of a text; an empty string may stand among them."""
    return F.split(F.translate(text, _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+")


def _uniform(bits: Column, at: int, width: int) -> Column:
    """A number in (0, 1) from ``width`` bits of a hash."""
    return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) / F.lit(float(1 << width))


def sample(term: Column, log_weight: Column, number: int) -> Column:
    """A long: how small the term's ``a`` is in sample ``number``, above 32 bits that name (term, t)."""
    first, second = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))
    r = -F.log(_uniform(first, 0, 21) * _uniform(first, 21, 21))
    b = _uniform(first, 42, 22)
    log_c = F.log(-F.log(_uniform(second, 0, 32) * _uniform(second, 32, 32)))
    t = F.floor(log_weight / r + b)
    # between -80 and 4 for weights below 2**40
    log_a = log_c - r * (t - b + 1)
    return F.shiftleft(F.floor((log_a + 128) * (1 << 23)), 32).bitwiseOR(second.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(counted: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, signature: array of ``samples`` numbers of 32 bits. ``counted``: keys, term long, n long (at least 1), each term of a text once."""
    logs = counted.select(*keys, "term", F.log(F.col("n").cast("double")).alias("log_n"))
    least = logs.groupBy(*keys).agg(*(F.min(sample(F.col("term"), F.col("log_n"), k)).alias(f"s{k}") for k in range(samples)))
    return least.select(*keys, F.array(*(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples))).alias("signature"))


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits for each sample; '' where there is no signature."""
    return F.coalesce(F.array_join(F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two signatures, null where a text has no words."""
    same = sum((F.element_at(a, k + 1) == F.element_at(b, k + 1)).cast("int") for k in range(samples)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of a row: ``id`` (0 for null) and ``hash`` of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), text).alias("hash"))


def neighbours(rows: DataFrame) -> DataFrame:
    """id, hash, doc_id, n_chars, copies, next_id, next_hash of each distinct row of ``keyed``: what follows it by descending doc_id; the first follows the last."""
    light = rows.groupBy("id", "hash", "doc_id").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ordered = materialise(light.orderBy(F.col("doc_id").desc_nulls_last(), "hash").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # a row for each partition of the sort
    ends = ordered.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    everything = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("part", "last", F.coalesce(F.lead("first").over(W.orderBy("part")), F.first("first").over(everything)).alias("after"))
    placed = ordered.withColumn("part", part).join(F.broadcast(ends), "part").withColumn("next_at", F.when(F.col("at") == F.col("last"), F.col("after")).otherwise(F.col("at") + 1))
    following = ordered.select(F.col("at").alias("next_at"), F.col("id").alias("next_id"), F.col("hash").alias("next_hash"))
    out = materialise(placed.select("id", "hash", "doc_id", "n_chars", "copies", "next_at").join(following, "next_at").drop("next_at"))
    forget(ordered)
    return out


def edited_texts(rows: DataFrame, order: DataFrame) -> DataFrame:
    """id, hash, text, edited of each distinct row: the last half of the text gives way to the beginning of the next document."""
    takes = order.select(F.col("next_id").alias("id"), F.col("next_hash").alias("hash"), F.col("id").alias("to_id"), F.col("hash").alias("to_hash"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    texts = rows.select("id", "hash", "text").dropDuplicates(["id", "hash"])
    lent = texts.join(takes, ["id", "hash"]).select(F.col("to_id").alias("id"), F.col("to_hash").alias("hash"), F.substr("text", F.lit(1), F.col("need")).alias("lent"))
    kept = F.substr("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 2).cast("int"))
    return texts.join(lent, ["id", "hash"]).select("id", "hash", "text", F.concat(kept, F.col("lent")).alias("edited"))


def word_counts(texts: DataFrame) -> DataFrame:
    """id, hash, side, told, term, n: words of the text (side 0) and of the edited text (side 1) by hash. Side 2 has one row: the edited text's SHA-256 in ``told``.

    The digest goes along as if it were a text, so that the edited texts are made once."""
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    sides = texts.select("id", "hash", F.posexplode(F.array(F.col("text"), F.col("edited"), digest)).alias("side", "text"))
    each = sides.select("id", "hash", "side", F.explode(words(F.col("text"))).alias("word")).where(F.col("word") != "")
    return each.groupBy("id", "hash", "side", F.when(F.col("side") == 2, F.col("word")).alias("told"), F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``."""
    rows = keyed(docs)
    order = neighbours(rows)
    key = ["id", "hash"]
    texts = edited_texts(rows, order)
    by_side = signatures(word_counts(texts), [*key, "side", "told"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("signature")))
    found = materialise(by_side.groupBy(*key).agg(of(0).alias("own"), of(1).alias("edited"), F.max("told").alias("edited_sha256")))
    following = found.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("own").alias("next"))
    judged = found.join(order, key).join(following, ["next_id", "next_hash"])
    result = ["doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next")]
    told = judged.select(*key, "copies", *result)
    # only rows that stand several times meet the table's rows again
    repeated = rows.select(*key).join(told.where("copies > 1"), key)
    names = [c for c in told.columns if c not in (*key, "copies")]
    return told.where("copies = 1").select(*names).unionByName(repeated.select(*names))


def op13_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
