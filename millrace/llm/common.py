"""What the training-data operators share: shared storage, folds, shingles, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle.
SHINGLE_WORDS = 5
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder on storage that driver and executors share.

    It lies in the folder that ``spark.checkpoint.dir`` names. Only where that is unset and the master is local, as in tests,
    a folder of this machine takes its place; on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once to shared storage and read again: the lineage is cut, and no executor's loss undoes it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised frame that no result needs any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


#: Bits of a filter of ids, whatever the input's size.
FILTER_BITS = 1 << 23


def filter_place(number: Column) -> Column:
    """Place of an id in a filter of ids."""
    return F.pmod(F.xxhash64(number), F.lit(FILTER_BITS))


def id_bitmaps(ids: DataFrame, name: str) -> DataFrame:
    """chunk, bitmap: bits at the places of all ids of a long column; ``FILTER_BITS`` in all, a row for each 32768."""
    place = filter_place(F.col(name))
    return ids.select(F.floor(place / 32768).alias("chunk"), (place % 32768).alias("at")).groupBy("chunk").agg(F.expr("bitmap_construct_agg(at)").alias("bitmap"))


def id_filter(ids: DataFrame, name: str) -> bytes:
    """The bitmaps end to end, the lowest bit of each byte first."""
    held = bytearray(FILTER_BITS // 8)
    for r in id_bitmaps(ids, name).collect():  # FILTER_BITS at most
        held[r["chunk"] * 4096 : (r["chunk"] + 1) * 4096] = r["bitmap"]
    return bytes(held)


def without_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose long ``key`` is not among ``ids`` (a frame with a column of that name). Rows with a null key stay.

    Rows that a filter of ``FILTER_BITS`` clears stay where they are; only the others meet the ids in a join, and travel for it.
    """
    place = filter_place(F.col(key))
    # FILTER_BITS // 8 bytes, whatever the input
    marked = rows.withColumn("__chunk", F.floor(place / 32768)).join(F.broadcast(id_bitmaps(ids, key).withColumnRenamed("chunk", "__chunk")), "__chunk", "left")
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor((place % 32768) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("__held", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    free, held = (marked.where(c).select(*rows.columns) for c in (~F.col("__held"), F.col("__held")))
    return free.unionByName(held.join(ids.select(key), key, "left_anti").select(*rows.columns))


def with_row_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a long that tells its rows apart and rises with doc_id (null ids last): doc_id itself where that is unique and never null."""
    n, known, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == distinct:
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return materialise(docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(key, F.monotonically_increasing_id()))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in no fold."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def spread(text: Column, size: int, count: int = 16) -> Column:
    """Array of texts: the whole text if it has at most ``size`` characters, else ``count`` pieces of together ``size``, from its first to its last character."""
    piece = size // count
    room = (F.length(text) - piece).cast("bigint")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(text, (F.floor(room * i / (count - 1)) + 1).cast("int"), F.lit(piece)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pieces)


def sizes_of(frame: DataFrame) -> int:
    """Partitions that the scan of ``frame`` makes; a plan-only question."""
    return max(1, frame.rdd.getNumPartitions())


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lowered, split at ASCII white space (0x20, 0x09-0x0D)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


#: The same words in DuckDB's SQL, of a column ``text``.
WORDS_SQL = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles in order; with fewer words, the whole sequence counts as one; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = (acc ^ (acc >> np.uint64(31))) * _ODD[i % 4] + h[i : n - k + 1 + i]
    return mix64(acc)


def shingle_set(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(words, width))


def to_table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def arrow_rows(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 2048) -> Iterator[dict[str, list]]:
    """Batches of at most ``rows`` rows as lists, so that memory stays small with long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield {n: part.column(part.schema.get_field_index(n)).to_pylist() for n in names}
