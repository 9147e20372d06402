"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, html_extract, jaccard_join, language, packing, pii, quality, rolling_median, sharding, token_alignment, topk, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_compression": quality.op1_quality_compression,
        "op2_url_digests": url_filter.op2_url_digests,
        "op3_language_ppm": language.op3_language_ppm,
        "op4_topk_kdtree": topk.op4_topk_kdtree,
        "op5_html_consensus": html_extract.op5_html_consensus,
        "op6_decontaminate_minhash": decontamination.op6_decontaminate_minhash,
        "op7_pack_mixture": packing.op7_pack_mixture,
        "op8_pii_feistel": pii.op8_pii_feistel,
        "op9_jaccard_partition": jaccard_join.op9_jaccard_partition,
        "op10_shard_bestfit": sharding.op10_shard_bestfit,
        "op11_rolling_median": rolling_median.op11_rolling_median,
        "op12_dangling_suffix": token_alignment.op12_dangling_suffix,
        "op13_weighted_sampling": fingerprints.op13_weighted_sampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_digests": url_filter.ORACLE_SQL,
        "op4_topk_kdtree": topk.ORACLE_SQL,
        "op6_decontaminate_minhash": decontamination.ORACLE_SQL,
        "op9_jaccard_partition": jaccard_join.ORACLE_SQL,
        "op11_rolling_median": rolling_median.ORACLE_SQL,
    }
