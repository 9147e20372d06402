"""Scalar functions on text: digests, identifiers, frames, versions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHA256_HEX = "^[0-9a-f]{64}$"
UUID4 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SAFE_NAME = "^[A-Za-z0-9][A-Za-z0-9._-]*$"


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def is_sha256_hex(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256_HEX), F.lit(False))


def is_uuid4(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID4), F.lit(False))


def uuid4_of(key: Column) -> Column:
    """An id of the form of a random one that follows from ``key``: a task that is run again gives the same."""
    h = sha256_text(key)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 13, 3)), F.concat(F.lit("8"), F.substring(h, 16, 3)), F.substring(h, 19, 12))


def is_safe_name(text: Column) -> Column:
    """Names that can be a file of their own; ``.`` and ``..`` can't."""
    return F.coalesce(text.rlike(SAFE_NAME) & ~text.isin(".", ".."), F.lit(False))


def safe_reason(text: Column) -> Column:
    """What isn't a letter, digit, dot, underscore or hyphen becomes an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def product_id(session_id: Column, fifo: Column) -> Column:
    return F.concat(F.lit("P-"), F.substring(session_id, 1, 8), F.lit("-"), F.lpad(fifo.cast("string"), 6, "0"))


def base_version(version: Column) -> Column:
    return F.substring_index(version, "+", 1)


def library_check(required: Column, installed: Column) -> Column:
    """ok; suffix, if only the local build differs; else mismatch."""
    return F.when(required == installed, "ok").when(base_version(required) == base_version(installed), "suffix").otherwise("mismatch")


def _crc_after(byte: int) -> int:
    """What eight steps with the polynomial 0x1021 make of a byte that stands on top."""
    c = byte << 8
    for _ in range(8):
        c = (c << 1 ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
    return c


CRC_OF_BYTE = [_crc_after(b) for b in range(256)]


def crc16(text: Column) -> Column:
    """CRC-16 with polynomial 0x1021 from 0xFFFF over ASCII text, by a fold over its characters inside the JVM. ``text`` is evaluated once for each of its mentions here, not for each character."""
    table = F.array(*map(F.lit, CRC_OF_BYTE))  # a literal, once the plan is optimized

    def step(crc: Column, c: Column) -> Column:
        at = F.shiftright(crc, 8).bitwiseXOR(F.ascii(c)).bitwiseAND(F.lit(0xFF))
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFF00)).bitwiseXOR(F.get(table, at))

    return F.aggregate(F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>")), F.lit(0xFFFF), step)


def encode_frame(*fields: Column) -> Column:
    body = F.concat_ws("|", *[f.cast("string") for f in fields])
    return F.concat(body, F.lit("|"), F.lpad(F.hex(crc16(body).cast("bigint")), 4, "0"), F.lit("\n"))


def decode_frame(line: Column) -> Column:
    """Fields of a frame, null if it is too short or its check value is wrong."""

    def fields(parts: Column) -> Column:
        listed = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        given = F.conv(F.when(F.element_at(parts, -1).rlike("^[0-9A-Fa-f]+$"), F.element_at(parts, -1)), 16, 10).cast("bigint")
        return F.when((F.size(parts) >= 2) & (given == crc16(F.array_join(listed, "|"))), listed)

    parts = F.split(F.trim(F.regexp_replace(line, "[\\r\\n]+$", "")), "\\|")
    return F.get(F.transform(F.array(parts), fields), F.lit(0))  # as a variable, so that the line is taken apart once


@F.pandas_udf(StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON objects with sorted keys, no spaces and plain UTF-8; null for what isn't an object or holds NaN or infinities.

    Spark keeps the order of keys as it is, and other writers print numbers in other ways, so the bytes are made here.
    """

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text)
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) if isinstance(value, dict) else None
        except (TypeError, ValueError):
            return None

    for texts in batches:
        yield texts.map(one)
