"""Both sides of guards, and choices that a query shows one side of."""

import math

import pytest
from pyspark.sql import functions as F

from verdance.functions import stats, text
from verdance.operators import cases, deferral, judging, profile, ranking, runs, sampling, sheets


def test_a_blank_question_is_an_error(spark):
    df = spark.createDataFrame([(" 2 + 2? ",)], "q string")
    assert df.select(text.build_question_prompt("Q: {question}!", F.col("q"))).first()[0] == "Q: 2 + 2?!"
    for blank in ("  ", None):
        with pytest.raises(Exception, match="not blank"):
            spark.createDataFrame([(blank,)], "q string").select(text.build_question_prompt("{question}", F.col("q"))).collect()


def test_an_extension_needs_a_sound_first_sheet(spark):
    pool, first = spark.range(50).withColumnRenamed("id", "item"), spark.range(7).withColumnRenamed("id", "item")
    more = {r["item"] for r in sampling.extension(pool, first, "item", 20, 1).collect()}
    assert len(more) == 20 and not more & set(range(7))
    with pytest.raises(Exception, match="not in the pool"):
        sampling.extension(pool, spark.createDataFrame([(3,), (99,)], "item long"), "item", 20, 1).collect()


def test_sheet_report(spark):
    known, fields = spark.range(5).withColumnRenamed("id", "id"), {"c": ["high", "low"]}
    row = lambda rows: runs.sheet_report(spark.createDataFrame(rows, "id long, c string"), "id", known, fields, "c").first().asDict()
    assert row([(0, "high"), (1, " low "), (2, None), (3, "nan")]) == {"n_rows": 4, "n_answered": 3, "n_duplicate_ids": 0, "n_unknown_ids": 0, "n_bad_c": 0, "ok": True}
    assert row([(0, ""), (1, None)])["ok"] is False  # nobody answered
    assert row([(0, "high"), (0, "odd"), (9, "low")]) == {"n_rows": 3, "n_answered": 3, "n_duplicate_ids": 1, "n_unknown_ids": 1, "n_bad_c": 1, "ok": False}
    assert row([])["n_rows"] == 0


def test_selected_cases(spark):
    df = spark.createDataFrame([(i, [0.0, 0.5, math.log(5)][i % 3], i % 2 == 0) for i in range(30)], "item int, e double, ok boolean")
    pick = lambda c, **k: [r["item"] for r in cases.select(df, c, "e", "ok", "item", 3, **k).collect()]
    assert pick("low_entropy_correct") == [0, 6, 12] and pick("high_entropy_wrong") == [5, 11, 17] and pick("max_entropy_degenerate") == [5, 11, 17] and pick("confidently_wrong_grading") == [3, 9, 15]
    assert pick("said_error", predicate=F.col("item") > 26) == [27, 28, 29]
    with pytest.raises(ValueError, match="predicate"):
        pick("said_error")


def test_preferred_and_excluded_examples(spark):
    df = spark.createDataFrame([(i, "TP" if i < 12 else "TN", "ab"[i % 2], "long span" if i % 3 else "x", i * 10) for i in range(24)], "item int, cell string, label string, span string, other int")
    got = sheets.confusion_examples(df, "item", "cell", "label", "span", 4, 3, {"TP": [9, 2], "TN": [3]}, 3, [5, 13]).collect()
    order = {c: [r["item"] for r in sorted((r for r in got if r["cell"] == c), key=lambda r: (r["contact_sheet_file"], r["contact_sheet_cell"]))] for c in ("TP", "TN")}
    assert order["TP"][:2] == [9, 2] and order["TP"][2:] == sorted(order["TP"][2:]) and len(order["TP"]) == len(order["TN"]) == 4 and not {5, 13} & {r["item"] for r in got}
    assert all(r["other"] == r["item"] * 10 for r in got) and all(df.filter(F.col("item") == i).first()["span"] != "x" for i in order["TP"][2:])


def test_whole_first_rows(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 5, "z"), (None, None, "w"), ("b", None, "v")], "k string, n int, v string")
    assert {tuple(r) for r in runs.keep_first(df, ["k"], "n").collect()} == {("a", 1, "y"), (None, 5, "z"), ("b", None, "v")}


def test_places_in_parts(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("item"), (F.col("id") % 3).alias("g"), (F.col("id") % 4).alias("level"))
    rows = runs.places(df, ["g"], -F.col("level"), "item").collect()
    for g in range(3):
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: (-r["level"], r["item"]))
        assert [r["place"] for r in own] == list(range(len(own)))


def test_status_follows_the_interval(spark):
    rows = [(g, e, ok, True, False, False, 5, None, None) for g in ("far", "near", "few") for k in range(200 if g != "few" else 20) for ok in [k % 2 == 0] for e in [(0.0 if ok else 1.0) + (k % 7) / 7 if g == "far" else float(k % 7)]]
    df = spark.createDataFrame(rows, "g string, entropy double, v1 boolean, v2 boolean, parse_failed boolean, max_entropy boolean, truth_span_len int, human_label string, human_truth string")
    got = {r["group"]: r for r in profile.group_metrics_interval(df, "g", "v1", 300).collect()}
    assert (got["far"]["auroc_status"], got["near"]["auroc_status"], got["few"]["auroc_status"]) == ("excludes_chance", "includes_chance", "underpowered_minority_10")
    assert got["few"]["ci_low"] is None and got["far"]["ci_low"] > 0.5


def test_gates_and_strata(spark):
    run = spark.createDataFrame([("a", i % 4 == 0) for i in range(40)] + [("b", True)] * 30, "g string, ok boolean")
    got = {r["g"]: (r["gate"], r["projected_items"]) for r in sheets.feasibility(run, "ok", ["g"]).collect()}
    assert got == {"a": ("feasible", 40), "b": ("gated", None)}
    said = spark.createDataFrame([("correct", True, "correct", True), ("incorrect", False, "wrong", True), ("unclear", True, None, False), ("correct", False, "wrong", False)], "verdict string, r boolean, human string, flag boolean")
    d = judging.diagnostics(said, ["r"], "human", "flag").first()
    assert (d["has_error_n"], d["has_error_correct_rate"], d["clean_n"], d["clean_correct_rate"]) == (2, 0.5, 2, 0.5) and abs(d["agrees_overall"] - 2 / 3) < 1e-12
    with pytest.raises(Exception, match="corrupt judge outputs"):
        sheets.decode_guard(spark.createDataFrame([("aĠb",), ("Equivalence Judgement: TRUE",)], "t string"), text.output_health(F.col("t"))).collect()


def test_a_damaged_document_has_no_leaves(spark):
    docs = spark.createDataFrame([('{"a": {"b": 1.5}}',), ("{broken",), (None,), ("[1]",)], "d string")
    assert [tuple(r) for r in runs.flatten_json(docs, "d").collect()] == [("a.b", 1.5)]


def test_row_by_row_draws_are_few(spark):
    df = spark.range(20).select("id", F.col("id").cast("double").alias("s"), (F.col("id") % 2 == 0).alias("ok"))
    with pytest.raises(ValueError, match="replicates"):
        ranking.replicates(df.withColumnRenamed("id", "idx"), 10_000)
    with pytest.raises(ValueError, match="splits"):
        deferral.conformal_splits(df, "id", "s", "ok", [0.1], 1_000, F.col("id"))


def test_places_by_hash(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.sha2(F.concat(F.lit("k"), "id"), 256).alias("h"))
    rows = sampling.hash_places(df, ["g"], "h", "id", "place").collect()
    for g in (None, 1, 2):
        assert [r["place"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["h"])] == list(range(300))


def test_coding_sheet_draws_from_five_strata(spark):
    labels = ["extraction_issue", "needs_visual", "hallucination"]
    rows = [(i, [0.0, 0.3, 1.0, math.log(5)][i % 4], labels[i % 3], i % 2 == 0, "text:m", "text:t") for i in range(240)]
    df = spark.createDataFrame(rows, "item int, entropy double, label string, has_error boolean, model_label string, truth_label string")
    order = {r["item"]: r["h"] for r in df.select("item", stats.hash_key(0, F.col("item")).alias("h")).collect()}
    members = [lambda r: r[1] < 1e-9, lambda r: r[1] > math.log(5) - 1e-9, lambda r: 1e-9 <= r[1] < 0.7, lambda r: r[2] == "extraction_issue", lambda r: r[2] == "needs_visual"]
    want = {}
    for name, member in zip(profile.SAMPLE_STRATA, members, strict=True):
        for r in sorted(filter(member, rows), key=lambda r: (order[r[0]], r[0]))[:30]:
            want.setdefault(r[0], name)
    got = profile.coding_sheet(profile.audit_sample(df, "item", "entropy", "label", 30, 0, math.log(5)), "item").collect()
    assert {r["item"]: r["stratum"] for r in got} == want and [(r["stratum"], r["item"]) for r in got] == sorted((r["stratum"], r["item"]) for r in got)
    assert all(r["proposed_label"] == labels[r["item"] % 3] and r["final_label"] == r["notes"] == "" for r in got)
