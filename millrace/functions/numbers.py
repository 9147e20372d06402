"""Scalar functions on numbers and arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null. Spark orders NaN above all numbers, so this goes before any comparison."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clamp_limit(n: Column) -> Column:
    """A page size from 1 to 1000; 0 and null mean 100."""
    return F.greatest(F.lit(1), F.least(F.when(F.coalesce(n, F.lit(0)) == 0, 100).otherwise(n), F.lit(1000)))


def top_k_count(total: Column | int, percent: Column | float) -> Column:
    total = F.lit(total) if isinstance(total, int) else total
    percent = F.lit(percent) if isinstance(percent, (int, float)) else percent
    return F.greatest(F.lit(1), F.ceil(total * percent / F.lit(100.0)))


def euclidean(x: Column, y: Column) -> Column:
    """Direct sum of squared differences in double precision."""
    d = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))


def softmax_weight(distances: Column) -> Column:
    """1 minus the softmax share of the first distance, taken against the largest for safety."""
    top = F.array_max(distances)
    e = F.transform(distances, lambda d: F.exp(d - top))
    return F.lit(1.0) - F.element_at(e, 1) / F.aggregate(e, F.lit(0.0), lambda s, v: s + v)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def expired(now_ns: Column, enqueued_ns: Column, timeout_ms: Column) -> Column:
    """Strictly past the deadline; no timeout never expires."""
    return F.coalesce(now_ns - enqueued_ns > timeout_ms * 1_000_000, F.lit(False))


def milliseconds(ns: Column) -> Column:
    return ns / F.lit(1_000_000.0)
