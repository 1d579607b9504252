"""Models in tasks: loads and calls counted, failures alone, resumed by key; trees of case files."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from verdance.operators import cases, judging, semantic, sheets
from verdance.sources.tables import read_tree, write_tree


def marked(folder, kind):
    return len([f for f in os.listdir(folder) if f.startswith(kind)])


def stub(folder):
    """A model that leaves a file for each load and call; it can't read 13."""

    def make():
        open(f"{folder}/load-{uuid.uuid4().hex}", "w").close()

        def model(prompts):
            open(f"{folder}/call-{uuid.uuid4().hex}", "w").close()
            if "p13" in prompts:
                raise RuntimeError("no thirteen")
            return [f"said {p}" for p in prompts]

        return model

    return make


def test_a_model_is_loaded_once_a_worker_and_called_with_batches(spark, tmp_path):
    items = spark.range(200).select("id", F.concat(F.lit("p"), "id").alias("prompt")).repartition(12)
    out = judging.judge(items, stub(str(tmp_path)), "prompt", "id", batch=10).collect()
    assert len(out) == 200 and {r["id"] for r in out if r["error"]} == {13} and all(r["raw_output"] == f"said p{r['id']}" for r in out if r["id"] != 13)
    assert "no thirteen" in next(r["error"] for r in out if r["id"] == 13)
    assert marked(tmp_path, "load") <= 8 and marked(tmp_path, "call") <= 12 + 20 + 11  # a call a batch, and the failed one's rows
    again = tmp_path / "again"
    again.mkdir()
    done = spark.createDataFrame([(r["id"], r["raw_output"]) for r in out], "id long, raw_output string")
    rest = judging.judge(items, stub(str(again)), "prompt", "id", batch=10, done=done).collect()
    assert len(rest) == 200 and marked(again, "call") == 2 and {r["id"] for r in rest if r["error"]} == {13}


def test_both_directions_in_one_call(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        def model(pairs):
            assert all(pairs[k] == pairs[k + 1][::-1] for k in range(0, len(pairs), 2))
            open(f"{folder}/pairs-{len(pairs)}-{uuid.uuid4().hex}", "w").close()
            return [[0.0, 1.0, 0.0] if b.startswith(a[0]) else [1.0, 0.0, 0.0] for a, b in pairs]

        return model

    samples = spark.createDataFrame([(i, k, t) for i in range(50) for k, t in enumerate(["ax", "ay", "bx"])], "item int, pos int, text string")
    linked = semantic.model_edges(samples, ["item"], "text", make)
    assert {tuple(r) for r in linked.collect()} == {(i, 0, 1) for i in range(50)}
    assert sum(int(f.split("-")[1]) for f in os.listdir(folder)) == 6  # three different pairs of texts, both ways


def test_tree_of_cases(spark, tmp_path):
    root = tmp_path / "tree"
    for i in range(300):
        folder = root / ("sub" if i % 2 else "") / f"case {i}+é"
        folder.mkdir(parents=True)
        doc = {"run_label": "r", "category": "c", "arm": "grading", "model_id": "m", "note": "n" * 300, "derived": {"entropy": i / 10, "correct": i % 2 == 0}} | ({"image": "x.png"} if i % 3 == 0 else {})
        (folder / "case.json").write_text("{broken" if i == 7 else json.dumps(doc, indent=1))
        (folder / "other.txt").write_text("not a case")
    got = {r["case_id"]: r for r in sheets.case_index(read_tree(spark, str(root)), "case_id").collect()}
    assert len(got) == 300 and set(got) == {f"case {i}+é" for i in range(300)}
    assert got["case 7+é"]["damaged"] == "{broken" and got["case 7+é"]["entropy"] is None and sum(r["damaged"] is not None for r in got.values()) == 1
    assert sum(r["has_image"] for r in got.values()) == 100 and got["case 4+é"]["entropy"] == 0.4 and len(got["case 4+é"]["note"]) == 200 and got["case 4+é"]["arm"] == "grading"
    back = spark.createDataFrame([(i, json.dumps({"derived": {"entropy": 1.0, "correct": True}})) for i in range(40)], "item long, case string")
    write_tree(back, "item", str(tmp_path / "written"))
    index = sheets.case_index(read_tree(spark, str(tmp_path / "written"), "*.txt"), "case_id").collect()
    assert {r["case_id"] for r in index} == {str(i) for i in range(40)} and all(r["damaged"] is None and r["correct"] for r in index)
