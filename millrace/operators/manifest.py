"""Manifests of model artifacts: JSON documents, read as variants and judged by an ordered list of rules; and nested values as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_sha256_hex
from .supervision import aggregation_error, normalization_error

# Fixed values of the third format.
FORMAT, ALGORITHM, TARGET = 3, "patchcore", 0.1
VIEWS = ["CAM_A_1", "CAM_A_2", "CAM_A_3", "CAM_B_1"]
BY_VIEW = ["calibration_b_scores", "memory_bank_shapes", "patch_grid_shapes", "thresholds"]
POLICY = ["aggregation", "decision", "normalization"]
SPLITS = ["calibration_a", "calibration_b", "validation_anomaly", "validation_normal"]
RECORD = ["file_count", "product_count", "sha256"]
SAMPLES = {"minimum": 100, "recommended": 1000}
MOST_PARALLEL = 3


class Document:
    """Ways to look into a variant; a path that isn't there gives null. What is looked up is a column of its own in ``found``, so that a row is asked once for each, however many rules name it."""

    def __init__(self, root: Column) -> None:
        self.root, self.found = root, {}

    def _once(self, name: str, value: Column) -> Column:
        column = f"__{name.replace('.', '/')}"
        self.found.setdefault(column, value)
        return F.col(column)

    def get(self, path: str, kind: str) -> Column:
        return self._once(f"{kind} {path}", F.try_variant_get(self.root, f"$.{path}", kind))

    def is_array(self, path: str) -> Column:
        return self.get(path, "array<variant>").isNotNull()

    def is_object(self) -> Column:
        return self._once("object", F.try_variant_get(self.root, "$", "struct<format_version: variant>").isNotNull())  # with that member or without

    def keys(self, path: str) -> Column:
        """Sorted keys of an object, null of anything else."""
        members = F.try_variant_get(self.root, f"$.{path}", "map<string,variant>")
        return self._once(f"keys {path}", F.sort_array(F.map_keys(members)))

    def has_keys(self, path: str, names: list[str]) -> Column:
        return self.keys(path) == F.array(*map(F.lit, sorted(names)))

    def number(self, path: str) -> Column:
        """A JSON number; a number in quotes is none."""
        at = F.try_variant_get(self.root, f"$.{path}", "variant")
        return self._once(f"number {path}", F.when(~F.coalesce(F.schema_of_variant(at).startswith("STRING"), F.lit(True)), at.try_cast("double")))

    def numbers(self, path: str) -> Column:
        return self.get(path, "array<double>")

    def text(self, path: str) -> Column:
        """What stands there, as JSON."""
        return self._once(f"text {path}", F.to_json(F.try_variant_get(self.root, f"$.{path}", "variant")))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def with_manifest_error(manifests: DataFrame, name: Column, least_scores: int = SAMPLES["minimum"]) -> DataFrame:
    """``manifests`` with error: the first rule that a manifest (``text``) breaks, null if it breaks none; a null text breaks the first. ``name``: the artifact's own."""
    parsed = manifests.withColumn("__v", F.try_parse_json("text"))  # once
    d = Document(F.col("__v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    shape = lambda path: (F.size(d.numbers(path)) == 2) & F.forall(d.numbers(path), lambda x: x.isNotNull() & (x >= 1) & (x == F.floor(x)))
    scores = lambda v: (F.size(d.numbers(f"calibration_b_scores.{v}")) >= least_scores) & F.forall(d.numbers(f"calibration_b_scores.{v}"), finite)
    chosen = d.get("candidate_selection.selected_candidate_id", "string")
    listed = F.coalesce(d.get("candidate_selection.candidates", "array<variant>"), F.array().cast("array<variant>"))
    matches = F.col("__matches")  # of the listed candidates, after the look-ups
    of = lambda path, kind: F.try_variant_get(F.get(matches, F.lit(0)), f"$.{path}", kind)
    record = lambda split, field, kind: d.get(f"dataset_provenance.{split}.{field}", kind)
    b = "parallel_benchmark"
    rules = {
        "root": d.is_object(),
        "format": d.number("format_version") == FORMAT,
        "identity": (d.get("algorithm", "string") == ALGORITHM) & (d.get("artifact_name", "string") == name),
        "views": d.get("view_names", "array<string>") == F.array(*map(F.lit, VIEWS)),
        "view keys": _all([d.has_keys(path, VIEWS) for path in BY_VIEW]),
        "policy": d.has_keys("spatial_scoring_policy", POLICY),
        "option": normalization_error(d.text("spatial_scoring_policy.normalization")).isNull() & aggregation_error(d.text("spatial_scoring_policy.aggregation")).isNull(),
        "decision": (d.get("spatial_scoring_policy.decision.comparison", "string") == "strict_greater_than") & (d.get("spatial_scoring_policy.decision.view_score_normalization", "string") == "divide_by_threshold") & (d.number("spatial_scoring_policy.decision.target_product_fpr") == TARGET),
        "threshold": _all([finite(d.number(f"thresholds.{v}")) & (d.number(f"thresholds.{v}") > 0) for v in VIEWS]),
        "scores": _all([scores(v) for v in VIEWS]),
        "shapes": _all([shape(f"{path}.{v}") for path in ("patch_grid_shapes", "memory_bank_shapes") for v in VIEWS]),
        "selection": (F.coalesce(chosen, F.lit("")) != "") & (F.size(matches) == 1),
        "candidate": (of("status", "string") == "valid")
        & of("eligible_for_selection", "boolean")
        & _all([of(f"thresholds.{v}", "double") == d.number(f"thresholds.{v}") for v in VIEWS])
        & (of("threshold_percentile", "double") == d.number("spatial_scoring_policy.decision.threshold_percentile"))
        & (of("calibration_product_fpr", "double") <= TARGET)
        & (of("validation_metrics.fpr", "double") <= TARGET),
        "provenance": d.has_keys("dataset_provenance", SPLITS)
        & _all([d.has_keys(f"dataset_provenance.{s}", RECORD) & (record(s, "product_count", "long") >= 1) & (record(s, "file_count", "long") == record(s, "product_count", "long") * len(VIEWS)) & is_sha256_hex(record(s, "sha256", "string")) for s in SPLITS]),
        "libraries": F.array_contains(d.keys("library_versions"), "torch") & F.array_contains(d.keys("library_versions"), "torchvision"),
        "samples": d.has_keys("calibration_b_sample_policy", [*SAMPLES, "actual"])
        & _all([d.get(f"calibration_b_sample_policy.{n}", "long") == x for n, x in SAMPLES.items()])
        & (d.get("calibration_b_sample_policy.actual", "long") == F.size(d.numbers(f"calibration_b_scores.{VIEWS[0]}"))),
        "benchmark": d.get(f"{b}.selected_parallel_count", "long").between(1, MOST_PARALLEL)
        & (d.get(f"{b}.reserve_mib", "long") >= 0)
        & (d.get(f"{b}.warmup_runs", "long") >= 1)
        & (d.get(f"{b}.benchmark_runs", "long") >= 1)
        & (d.get(f"{b}.min_speedup_percent", "double") >= 0)
        & (d.get(f"{b}.min_speedup_percent", "double") < 100)
        & d.is_array(f"{b}.candidates")
        & d.get(f"{b}.all_view_memory_safety.memory_safe", "boolean"),
    }
    error = None
    for rule, holds in rules.items():
        broken = ~F.coalesce(holds, F.lit(False))
        error = F.when(broken, rule) if error is None else error.when(broken, rule)
    looked_up = parsed.select(*manifests.columns, *[c.alias(n) for n, c in d.found.items()])
    matched = F.filter(listed, lambda c: F.coalesce(F.try_variant_get(c, "$.candidate_id", "string") == chosen, F.lit(False)))
    return looked_up.withColumn("__matches", matched).select(*manifests.columns, error.alias("error"))


def json_safe(value: Column) -> Column:
    """Any nested value as JSON text: keys of maps as text at every depth, arrays as lists, nulls kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})
