"""Nested snapshot documents: published keys, types, round trip, verdicts of strata."""

import json
import math

import pytest
from pyspark.sql import functions as F

from verdance.operators import runs, snapshots


@pytest.fixture(scope="module")
def run(spark):
    rows = [(k, k % 2 == 0, [0.0, 0.500402, math.log(5)][k % 3], k % 4 != 0, [0.0, 0.673012, 1.05492][(k + k // 7) % 3], k % 5 != 0, int(k % 9 == 0), 0) for k in range(240)]
    return spark.createDataFrame(rows, "item int, has_error boolean, perception_entropy double, perception_correct boolean, reasoning_entropy double, grading_correct boolean, n_transcription_parse_failures int, n_grading_parse_failures int").cache()


def test_document_has_the_published_keys(run):
    figures = snapshots.metrics(run, 5, 50, 10).cache()
    more = snapshots.curve_list(run).unionByName(snapshots.notes(figures, {"label": 'a "run"', "model_id": None, "latex_parser_available": True}))
    doc_rows = snapshots.document(figures, more)
    doc = json.loads(doc_rows.first()["document"])
    assert doc["label"] == 'a "run"' and doc["model_id"] is None and doc["latex_parser_available"] is True and doc["n_items"] == 240 and doc["k_grading"] == 5
    assert {"auroc", "ci_low", "ci_high", "n_items", "n_error", "excludes_chance", "accuracy", "aurc", "aurc_baseline", "sensitivity", "robust"} == set(doc["perception"])
    assert set(doc["perception"]["sensitivity"]) == {"full", "excl_parse_failures", "excl_max_entropy", "excl_both"} and isinstance(doc["perception"]["robust"], bool)
    assert {"auroc", "error_stratum", "clean_stratum", "aurc"} <= set(doc["reasoning"]) and isinstance(doc["reasoning"]["error_stratum"]["excludes_chance"], bool)
    assert set(doc["conformal"]) == {"target_0.30", "target_0.40", "target_0.50"} and set(doc["integrity"]) == {"transcription_parse_failure_rate", "grading_parse_failure_rate"}
    assert [p["threshold"] for p in doc["risk_coverage"]] == sorted(p["threshold"] for p in doc["risk_coverage"]) and doc["risk_coverage"][-1]["n_deferred"] == 0
    flat = {r["key"]: r["value"] for r in runs.flatten_json(doc_rows, "document").collect()}
    want = {r["key"]: r["value"] for r in figures.filter("value is not null").collect() if r["key"].split(".")[-1] not in snapshots.TRUTHS and not r["key"].startswith("risk_coverage.")}
    assert flat.keys() == want.keys() and all(abs(flat[k] - want[k]) < 1e-12 for k in want)
    assert set(snapshots.HEADLINE) <= set(flat)


def test_graded_runs(run, spark):
    figures = snapshots.grading_metrics(run, 5, 200)
    doc = json.loads(snapshots.document(figures, snapshots.stratum_verdicts(figures)).first()["document"])
    assert doc["composition"] == {"n_has_error": 120, "n_clean": 120, "frac_has_error": 0.5, "is_balanced": True} and doc["reasoning"]["pooled_is_misleading_unless_balanced"] is False
    assert doc["reasoning"]["pooled"]["n_items"] == 240 and doc["reasoning"]["error_stratum_verdict"] == "inconclusive_underpowered"
    assert sum(doc["entropy_distribution"]["counts"].values()) == 240 and set(doc["entropy_distribution"]["counts"]) == {"0.0", "0.673", "1.055"}
    clean_only = snapshots.grading_metrics(run.filter("not has_error"), 5, 200)
    verdicts = {r["path"][-1]: json.loads(r["json"]) for r in snapshots.stratum_verdicts(clean_only).collect()}
    assert verdicts["error_stratum_verdict"] == "not_measured" and verdicts["clean_stratum_verdict"] != "not_measured"


def test_depth(spark):
    rows = spark.createDataFrame([(["a", "b.c", "d"], 1.5), (["a", "e"], float("nan")), (["z"], 2.0)], "path array<string>, value double")
    assert json.loads(snapshots.document(rows).first()["document"]) == {"a": {"b.c": {"d": 1.5}, "e": None}, "z": 2}
    with pytest.raises(Exception, match="more than 2 names"):
        snapshots.document(rows, depth=2).collect()
