"""URL filter by a sorted digest array.

A rule is a host and a path prefix. Its text ``host + path`` is the key; the keys' 64-bit xxhash values stand in
one sorted array, with the rules' full texts beside it. The array is a file that every task maps into memory, so
processes of a machine share its pages. A url is probed for each of its host's suffixes (label by label) with each
prefix of its path whose length some rule has; the probes of a batch are one vectorised binary search, and a hit
counts only if the stored full text is equal, so that collisions never decide. The longest rule text wins.

A url that no rule fits gets the method's own verdict: it isn't listed, so it is allowed.
Null urls and urls without ``://`` have empty host and path and fit no rule. Repeated rows get equal results.
Other columns pass through, but for those named host, path, rule and verdict, which are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Most rules of one index; each takes some 60 bytes of the file.
MAX_RULES = 20_000_000
UNLISTED = "allow"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HEAD = 6


def digest(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index file: six counts, digests, offsets, splits, verdicts, path lengths, host lengths, texts. Equal keys: block goes before allow."""
    kept: dict[bytes, tuple[int, int]] = {}
    for host, path, verdict in rules:
        h, p = host.translate(_LOWER).encode(), path.encode()
        key = h + p
        if kept.get(key, (0, 0))[1] != 1:
            kept[key] = (len(h), int(verdict == "block"))
        if len(kept) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules in an index")
    keys = list(kept)
    values = digest(keys)
    order = np.array(sorted(range(len(keys)), key=lambda i: (values[i], keys[i])), int)
    keys = [keys[i] for i in order]
    offsets = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum([len(k) for k in keys], out=offsets[1:])
    splits = np.array([kept[k][0] for k in keys], np.uint64)
    verdicts = np.array([kept[k][1] for k in keys], np.uint64)
    lengths = np.unique(np.array([len(k) - kept[k][0] for k in keys], np.uint64))
    hosts = np.unique(splits)
    text = b"".join(keys)
    head = np.array([len(keys), len(lengths), len(text), len(hosts), 0, 0], np.uint64)
    return b"".join([*(a.tobytes() for a in (head, values[order], offsets, splits, verdicts, lengths, hosts)), text])


@dataclass
class DigestArray:
    """The mapped file."""

    values: np.ndarray
    offsets: np.ndarray
    splits: np.ndarray
    verdicts: np.ndarray
    lengths: np.ndarray
    hosts: np.ndarray
    text: np.ndarray

    @classmethod
    def map(cls, path: str) -> DigestArray:
        words = np.memmap(path, np.uint8, "r")
        n, k, size, m = (int(x) for x in words[: 8 * _HEAD].view(np.uint64)[:4])
        at, parts = 8 * _HEAD, []
        for count in (n, n + 1, n, n, k, m):
            parts.append(words[at : at + 8 * count].view(np.uint64))
            at += 8 * count
        return cls(*parts, words[at : at + size])

    def key(self, i: int) -> bytes:
        return self.text[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def judge(self, urls: list[str | None]) -> dict[str, list]:
        parts = [split_url(u) for u in urls]
        probes: list[bytes] = []
        owner: list[int] = []
        splits: list[int] = []
        lengths, hosts = self.lengths.tolist(), self.hosts.tolist()
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            p = path.encode("utf-8", "surrogatepass")
            whole = host.encode("utf-8", "surrogatepass")
            # suffixes of the lengths that rules have, where a label begins; the longest first
            tails = [whole[len(whole) - n :] for n in reversed(hosts) if n == len(whole) or (n < len(whole) and whole[-n - 1 : len(whole) - n] == b".")]
            for n in lengths:
                if n > len(p):
                    break
                for tail in tails:
                    probes.append(tail + p[:n])
                    owner.append(i)
                    splits.append(len(tail))
        best: list[tuple[int, int]] = [(-1, -1)] * len(urls)
        if probes and len(self.values):
            wanted = digest(probes)
            at = np.searchsorted(self.values, wanted)
            for j in np.flatnonzero(self.values[np.minimum(at, len(self.values) - 1)] == wanted):
                i = int(at[j])
                while i < len(self.values) and self.values[i] == wanted[j]:  # one digest can stand for several texts
                    if self.key(i) == probes[j] and int(self.splits[i]) == splits[j]:
                        best[owner[j]] = max(best[owner[j]], (len(probes[j]), i))
                    i += 1
        rules = [self.key(i).decode("utf-8", "surrogatepass") if i >= 0 else None for _, i in best]
        verdict = [UNLISTED if i < 0 else "block" if self.verdicts[i] else "allow" for _, i in best]
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rules, "verdict": verdict}


def ship(spark: SparkSession, data: bytes) -> str:
    """Give the file to all executors, late ones too, under a name that its content decides."""
    name = f"digests-{xxhash.xxh3_128_hexdigest(data)}.bin"
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / name  # of the driver, whose file server sends it on
    path.write_bytes(data)
    try:
        spark.sparkContext.addFile(str(path))
    except Exception as e:  # the same content was sent before, from another folder
        if "already registered" not in str(e) and "was already" not in str(e):
            raise
    return name


def judge(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with host, path, rule and verdict of ``url`` (columns of these names are replaced)."""
    name = ship(spark, build(rules))
    new = ["host", "path", "rule", "verdict"]
    kept = [n for n in pages.columns if n not in new]
    schema = T.StructType([*[pages.schema[n] for n in kept], *[T.StructField(n, T.StringType()) for n in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.map(SparkFiles.get(name))
        for batch in batches:
            got = array.judge(batch.column(batch.schema.get_field_index("url")).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], *[pa.array(got[n], pa.string()) for n in new]], names=[*kept, *new])

    return pages.mapInArrow(run, schema)


def op2_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page under RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(spark, pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u
), r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT rverdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
