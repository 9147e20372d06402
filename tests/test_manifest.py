"""Manifests: each rule by a document that breaks it alone; products' lives by hand; nested values as JSON."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import flow, manifest, supervision

V = manifest.VIEWS
FINE = {
    "format_version": 3, "algorithm": "patchcore", "artifact_name": "a", "view_names": V, "thresholds": dict.fromkeys(V, 1.5), "patch_grid_shapes": dict.fromkeys(V, [4, 4]), "memory_bank_shapes": dict.fromkeys(V, [48, 16]),
    "calibration_b_scores": dict.fromkeys(V, [0.5, 0.25, 1.0]),
    "spatial_scoring_policy": {"normalization": {"method": "epsilon", "epsilon_ratio": 0.1}, "aggregation": {"method": "percentile", "percentile": 99.5}, "decision": {"comparison": "strict_greater_than", "view_score_normalization": "divide_by_threshold", "target_product_fpr": 0.1, "threshold_percentile": 97.5}},
    "candidate_selection": {"selected_candidate_id": "c", "candidates": [{"candidate_id": "b"}, {"candidate_id": "c", "status": "valid", "eligible_for_selection": True, "thresholds": dict.fromkeys(V, 1.5), "threshold_percentile": 97.5, "calibration_product_fpr": 0.05, "validation_metrics": {"fpr": 0.1}}]},
    "dataset_provenance": {s: {"product_count": 2, "file_count": 8, "sha256": "0a" * 32} for s in manifest.SPLITS}, "library_versions": {"torch": "1", "torchvision": "1", "other": "1"},
    "calibration_b_sample_policy": {"minimum": 100, "recommended": 1000, "actual": 3}, "parallel_benchmark": {"selected_parallel_count": 1, "reserve_mib": 0, "warmup_runs": 1, "benchmark_runs": 1, "min_speedup_percent": 0, "candidates": [], "all_view_memory_safety": {"memory_safe": True}},
}


def changed(path, value):
    d = copy.deepcopy(FINE)
    at = d
    for key in path[:-1]:
        at = at[key]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return d


BROKEN = [
    (FINE, None), (changed(["library_versions", "torch"], 2), None), ([FINE], "root"), (changed(["format_version"], "3"), "format"), (changed(["format_version"], KeyError), "format"), (changed(["artifact_name"], "b"), "identity"), (changed(["view_names"], V[::-1]), "views"),
    (changed(["patch_grid_shapes", V[0]], KeyError), "view keys"), (changed(["thresholds"], []), "view keys"), (changed(["spatial_scoring_policy", "more"], 1), "policy"), (changed(["spatial_scoring_policy", "normalization", "epsilon_ratio"], 0.3), "option"),
    (changed(["spatial_scoring_policy", "aggregation", "percentile"], 12), "option"), (changed(["spatial_scoring_policy", "decision", "comparison"], "greater"), "decision"), (changed(["thresholds", V[3]], 0), "threshold"), (changed(["calibration_b_scores", V[1]], [1.0, 2.0]), "scores"),
    (changed(["memory_bank_shapes", V[2]], [48]), "shapes"), (changed(["memory_bank_shapes", V[2]], [48, 1.5]), "shapes"), (changed(["candidate_selection", "selected_candidate_id"], "z"), "selection"), (changed(["candidate_selection", "candidates", 0, "candidate_id"], "c"), "selection"),
    (changed(["candidate_selection", "candidates", 1, "eligible_for_selection"], False), "candidate"), (changed(["candidate_selection", "candidates", 1, "validation_metrics", "fpr"], 0.11), "candidate"), (changed(["dataset_provenance", manifest.SPLITS[2], "file_count"], 7), "provenance"),
    (changed(["dataset_provenance", "test_normal"], {}), "provenance"), (changed(["dataset_provenance", manifest.SPLITS[0], "sha256"], "0A" * 32), "provenance"), (changed(["library_versions", "torchvision"], KeyError), "libraries"), (changed(["calibration_b_sample_policy", "actual"], 4), "samples"),
    (changed(["parallel_benchmark", "benchmark_runs"], 0), "benchmark"), (changed(["parallel_benchmark", "candidates"], {}), "benchmark"),
]


def test_every_rule_alone(spark):
    rows = [(i, json.dumps(d), e) for i, (d, e) in enumerate(BROKEN)] + [(100, None, "root"), (101, "{", "root"), (102, "3", "root")]
    found = manifest.with_manifest_error(spark.createDataFrame(rows, "no int, text string, want string"), F.lit("a"), 3).collect()
    assert [(r.no, r.error) for r in found if r.error != r.want] == []
    assert manifest.with_manifest_error(spark.createDataFrame(rows[:1], "no int, text string, want string"), F.lit("a")).first().error == "scores"


def test_no_place_is_looked_up_again(spark):
    """However many rules name a place, the text is parsed once and each place is looked up once."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        judged = manifest.with_manifest_error(spark.createDataFrame([(1, "{}")], "id long, text string"), F.lit("a"))
        plan = judged._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(manifest.VIEWS) < plan.count("variant_get(__v") < 100
    assert plan.count("parsejson(") == 1 and "get_json_object(text" not in plan


def test_options_are_read_once(spark):
    texts = ['{"method":"epsilon","epsilon_ratio":0.1}', '{"method":"mad","epsilon_ratio":0.1}', '{"method":"epsilon","epsilon_ratio":0.3}', '{"method":"epsilon","epsilon_ratio":"x"}', "[]", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(supervision.normalization_error(F.col("t")).alias("e"))
    assert [r.e for r in rows.collect()] == [None, "keys", "candidate", "value", "keys", "keys"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") <= 5
    texts = ['{"method":"percentile","percentile":99.5}', '{"method":"percentile","percentile":12}', '{"method":"other"}', '{"method":"percentile"}', '{"method":"top_k_percent_average","top_k_percent":5,"rounding":"ceil","minimum_patch_count":1}', '{"method":"top_k_percent_average","top_k_percent":5,"rounding":"floor","minimum_patch_count":1}', '{"method":"top_k_percent_average","top_k_percent":5,"rounding":"ceil","minimum_patch_count":2}', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(supervision.aggregation_error(F.col("t")).alias("e"))
    assert [r.e for r in rows.collect()] == [None, "candidate", "method", "keys", None, "rounding", "minimum", "method"]


def test_nested_values(spark):
    row = spark.range(1).select(manifest.json_safe(F.create_map(F.lit(3), F.array(F.create_map(F.lit(1.5), F.lit(None).cast("string"))))).alias("t")).first()
    assert json.loads(row.t) == {"3": [{"1.5": None}]}


@pytest.mark.parametrize("tombstones", [1, 2, 9])
def test_lives_of_products(spark, tombstones):
    removals = spark.createDataFrame([("s", "a", 10), ("s", "b", 10), ("s", "c", 30), ("t", "a", 5)], "session_id string, product_id string, removed_ms long")
    times = [0, 9, 10, 109, 110, 129, 130, 500]
    messages = spark.createDataFrame([("s", p, at) for p in "abcd" for at in times] * 2, "session_id string, product_id string, at_ms long")
    found = {(r.product_id, r.at_ms): r.life for r in flow.retirement(messages, removals, 100, tombstones).collect()}
    ends = {"a": 10, "b": 10, "c": 30}
    for p in "abcd":
        for at in times:
            later = sorted((e + 100, q) for q, e in ends.items() if e + 100 <= at)
            want = "ACTIVE" if p not in ends or at < ends[p] else "REMOVED" if at < ends[p] + 100 else "RETIRED" if (ends[p] + 100, p) in later[-tombstones:] else "FORGOTTEN"
            assert found[p, at] == want
    assert flow.retirement(messages, removals, 100, tombstones).count() == messages.count()
