import math

import pytest
from pyspark.sql import functions as F

from verdance.functions import stats
from verdance.operators import deferral, nullmodel, ranking, runs, votes


def samples(spark, items):
    return spark.createDataFrame([(i, p, x) for i, labels in items.items() for p, x in enumerate(labels)], "item_id long, pos int, label string")


@pytest.mark.parametrize(
    ("labels", "entropy", "majority", "fraction", "margin"),
    [
        (list("aaabb"), 0.6730116670092565, ("a", 3), 0.6, 0.2), (["a", None, "a", None, "b"], 1.0549201679861442, ("a", 2), 0.4, 0.0), (list("abcde"), math.log(5), ("a", 1), 0.2, 0.0), (list("aaaaa"), 0.0, ("a", 5), 1.0, 1.0),
        (list("baba"), math.log(2), ("b", 2), 0.5, 0.0), (list("aaabc"), 0.950270539233235, ("a", 3), 0.6, 0.4),
    ],
)
def test_votes(spark, labels, entropy, majority, fraction, margin):
    r = votes.votes(samples(spark, {1: labels}), ["item_id"]).first()
    assert abs(r["entropy"] - entropy) < 1e-11 and (r["majority"], r["majority_count"]) == majority
    assert abs(r["majority_fraction"] - fraction) < 1e-12 and abs(r["majority_margin"] - margin) < 1e-12
    one = spark.createDataFrame([(labels,)], "a array<string>").select(stats.labels_entropy(F.col("a")).alias("h")).first()
    assert abs(one["h"] - entropy) < 1e-12


def test_no_labels_have_no_entropy(spark):
    assert spark.createDataFrame([([],)], "a array<string>").select(stats.labels_entropy(F.col("a"))).first()[0] == 0.0
    assert votes.votes(samples(spark, {}), ["item_id"]).count() == 0


def run_of(spark, wrong, right):
    return spark.createDataFrame([(float(x), False) for x in wrong] + [(float(x), True) for x in right], "s double, ok boolean")


@pytest.mark.parametrize("few", [True, False])
def test_auroc(spark, few):
    a = lambda w, r: ranking.auroc(run_of(spark, w, r), "s", "ok", few=few).first()["auroc"]
    assert abs(a([0.9, 0.3], [0.1, 0.2, 0.4]) - 5 / 6) < 1e-12
    assert a([1, 1], [1, 1]) == 0.5 and a([1, 2], []) is None
    levels = [0.0, 0.5004, 0.6730, 0.9503, 1.0549]
    spread = lambda n: [x for x, k in zip(levels, n, strict=True) for _ in range(k)]
    assert round(a(spread([7, 7, 10, 1, 0]), spread([31, 29, 12, 1, 2])), 4) == 0.6184


def test_average_ranks_and_running_totals_over_many_ranges(spark):
    values = [(i, float(i * 37 % 500)) for i in range(2000)]
    got = {r["i"]: r["avg_rank"] for r in ranking.average_ranks(spark.createDataFrame(values, "i long, v double"), "v").collect()}
    order = sorted(v for _, v in values)
    assert all(got[i] == (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for i, v in values[::97])


def test_stratum_verdict_tests_inversion_first(spark):
    rows = [(0, 0, 0, None, None, False), (100, 10, 90, 0.9, 0.95, True), (100, 50, 50, 0.3, 0.45, False), (100, 50, 50, 0.5, 0.6, False), (100, 50, 50, 0.8, 0.9, True), (100, 50, 50, 0.6, 0.7, True)]
    df = spark.createDataFrame(rows, "n long, e long, c long, a double, hi double, x boolean")
    got = [r[0] for r in df.select(ranking.stratum_verdict(*(F.col(c) for c in ("n", "e", "c", "a", "hi", "x")))).collect()]
    assert got == ["not_measured", "inconclusive_underpowered", "confirmed_inverted", "no_signal", "confirmed", "resolved_below_threshold"]


def test_bootstraps_agree(spark):
    df = run_of(spark, [i / 40 + 0.3 for i in range(40)], [i / 40 for i in range(60)]).withColumn("k", F.monotonically_increasing_id())
    hashed = ranking.bootstrap(df, "k", "s", "ok", 60).first()
    drawn = ranking.interval(ranking.bootstrap_levels(ranking.levels(df, "s", "ok"), 2000), "auroc").first()
    assert hashed["n_boot_valid"] == 60 and abs(hashed["ci_low"] - drawn["ci_low"]) < 0.06 and abs(hashed["ci_high"] - drawn["ci_high"]) < 0.06
    same = ranking.bootstrap_difference(df.withColumn("t", F.col("s") * 2), "k", ("s", "ok"), ("t", "ok"), 20).first()
    assert same["difference"] == 0 and same["ci_low"] == same["ci_high"] == 0 and not same["difference_excludes_zero"]


def test_interval_of_a_stratum_narrows_with_its_rows(spark):
    """AUROC 0.53 in both groups: the fixed margin of 0.05 calls both 'no_signal', an interval only the small one."""
    rows = [(g, float(x), ok) for g, n in (("small", 1), ("large", 400)) for x, ok, k in ((1, False, 53), (0, False, 47), (1, True, 47), (0, True, 53)) for _ in range(n * k)]
    df = spark.createDataFrame(rows + [(None, 1.0, True)], "g string, s double, ok boolean")
    per = ranking.bootstrap_cells(df, "s", "ok", 1500, ["g"])
    got = {r["g"]: r for r in ranking.with_interval(ranking.auroc(df, "s", "ok", ["g"]), per, ["g"]).withColumn("v", ranking.stratum_verdict(F.col("n_items"), F.col("n_error"), F.col("n_correct"), F.col("auroc"), F.col("ci_high"), F.col("excludes_chance"))).collect()}
    assert got["small"]["auroc"] == got["large"]["auroc"] == pytest.approx(0.53)
    assert got["small"]["v"] == "no_signal" and got["large"]["v"] == "resolved_below_threshold" and got["large"]["n_boot_valid"] == 1500
    width = {g: got[g]["ci_high"] - got[g]["ci_low"] for g in ("small", "large")}
    assert 15 < width["small"] / width["large"] < 26  # the root of 400
    assert got[None]["n_boot_valid"] == 0 and got[None]["ci_low"] is None and not got[None]["excludes_chance"]


def test_intervals_by_cut_rule_and_weight(spark):
    import math

    top = math.log(5)
    rows = [(x, ok, f, w) for x, ok, f, w, n in ((0.5, True, 0, 1, 40), (top, False, 0, 3, 30), (0.5, False, 1, 1, 5), (0.95, False, 0, 3, 20), (0.0, True, 0, 1, 30)) for _ in range(n)]
    df = spark.createDataFrame(rows, "entropy double, correct boolean, fails int, w int")
    cuts = {r["cut"]: r for r in ranking.cuts_interval(df, "entropy", "correct", "fails", top, 300).collect()}
    assert set(cuts) == set(ranking.CUTS) and all(r["robust"] and r["n_boot_valid"] == 300 and r["ci_low"] <= r["auroc"] <= r["ci_high"] for r in cuts.values())
    one = ranking.rule_metrics(df.withColumn("rule", F.lit("r")), "rule", 5, 300).first()
    assert (one["n_items"], one["n_error"], one["n_correct"], one["n_at_max_entropy"], one["rule"]) == (125, 55, 70, 30, "r")
    assert abs(one["auroc"] - cuts["full"]["auroc"]) < 1e-12 and (one["ci_low"], one["ci_high"]) == (cuts["full"]["ci_low"], cuts["full"]["ci_high"])
    # within strata: with one item a stratum nothing can vary
    apart = df.withColumn("id", F.monotonically_increasing_id())
    fixed = ranking.interval(ranking.bootstrap_cells(apart, "entropy", "correct", 50, weight="w", within="id"), "auroc").first()
    point = ranking.auroc(df, "entropy", "correct", weight="w").first()["auroc"]
    assert fixed["ci_low"] == fixed["ci_high"] == pytest.approx(point)
    grid = df.withColumns({"temperature": F.lit(0.5), "k": F.lit(5)})
    assert len(runs.grid_metrics(grid, "entropy", "correct", "fails", 200).columns) == 14


def test_paired_difference_at_full_size_agrees_with_the_hashed_one(spark):
    df = run_of(spark, [i / 40 + 0.3 for i in range(40)], [i / 40 for i in range(60)]).withColumn("k", F.monotonically_increasing_id()).withColumn("t", F.floor(F.col("s") * 3).cast("double"))
    small = ranking.bootstrap_difference(df, "k", ("s", "ok"), ("t", "ok"), 100).first()
    full = ranking.difference_cells(df, ("s", "ok"), ("t", "ok"), 10_000).first()
    assert full["n_boot_valid"] == 10_000 and full["n_items"] == small["n_items"] and abs(full["difference"] - small["difference"]) < 1e-12
    assert abs(full["ci_low"] - small["ci_low"]) < 0.02 and abs(full["ci_high"] - small["ci_high"]) < 0.02


def test_resampling_by_ranges_gathers_nothing(spark, monkeypatch):
    """Poisson draws by cell: equal to a walk over all cells with the same draws, however the scores are cut, and near the multinomial form."""
    import random

    import numpy as np

    rng = random.Random(8)
    rows = [("a" if k % 3 else None, round(rng.gauss(0.4 * (not ok), 1), 3), ok) for k in range(900) for ok in [rng.random() < 0.6]]
    df = spark.createDataFrame(rows + [("b", 1.0, True), ("a", None, True)], "g string, s double, ok boolean")
    gathered = {r["g"]: r for r in ranking.interval(ranking.bootstrap_cells(df, "s", "ok", 2000, ["g"]), "auroc", ["g"]).collect()}
    found = []
    for size in (10_000, 100):
        monkeypatch.setattr(ranking, "CELLS_A_RANGE", size)
        per = ranking.bootstrap_ranges(df, "s", "ok", 2000, ["g"])
        found.append({(r["g"], r["rep"]): r["auroc"] for r in per.collect()})
        got = {r["g"]: r for r in ranking.interval(per, "auroc", ["g"]).collect()}
        for g in ("a", None):
            assert got[g]["n_boot_valid"] == 2000 and abs(got[g]["ci_low"] - gathered[g]["ci_low"]) < 0.01 and abs(got[g]["ci_high"] - gathered[g]["ci_high"]) < 0.01
        assert got["b"]["n_boot_valid"] == 0
    assert found[0].keys() == found[1].keys() and all(a == b or abs(a - b) < 1e-12 for a, b in ((found[0][k], found[1][k]) for k in found[0]))
    cells = df.filter("g = 'a' and s is not null").groupBy("g", "s", "ok").count().withColumn("k", F.xxhash64("g", "s", "ok", F.lit(1.0))).collect()
    draws = {r["k"]: np.random.Generator(np.random.Philox(key=[r["k"] & (2**64 - 1), 0])).poisson(r["count"], 2000) for r in cells}
    for rep in (0, 1999):
        bad, good = ([(r["s"], draws[r["k"]][rep]) for r in cells if r["ok"] is ok] for ok in (False, True))
        won = sum(x * y * (1.0 if s > t else 0.5 if s == t else 0.0) for s, x in bad for t, y in good)
        assert abs(found[0]["a", rep] - won / (sum(x for _, x in bad) * sum(y for _, y in good))) < 1e-9


def test_too_many_cells_are_an_error_only_where_they_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_LEVELS", 50)
    df = spark.range(200).select((F.col("id") / 7).alias("s"), (F.col("id") * 3 % 11 / 2).alias("t"), (F.col("id") % 3 > 0).alias("ok"))
    for gathered in (lambda: ranking.bootstrap_cells(df, "s", "ok", 20), lambda: ranking.difference_cells(df, ("s", "ok"), ("t", "ok"), 20), lambda: ranking.bootstrap_levels(ranking.levels(df, "s", "ok"), 20)):
        with pytest.raises(Exception, match="no few levels"):
            gathered().collect()
    assert ranking.bootstrap_ranges(df, "s", "ok", 20).count() == 20
    monkeypatch.setattr(ranking, "MOST_LEVELS", 1000)
    got, want = ranking.difference_ranges(df, ("s", "ok"), ("t", "ok"), 4000).first(), ranking.difference_cells(df, ("s", "ok"), ("t", "ok"), 4000).first()
    assert got["difference"] == want["difference"] and abs(got["ci_low"] - want["ci_low"]) < 0.01 and abs(got["ci_high"] - want["ci_high"]) < 0.01


def test_every_bucket_of_the_registered_hypotheses(spark):
    """Each hypothesis with metrics that lead to each of its verdicts."""
    rows = [(i, m, *x) for i, x in enumerate([(40, 40, 0.8, 0.7, True), (40, 29, 0.8, 0.7, True), (40, 40, 0.6, 0.56, True), (40, 40, 0.6, 0.51, True), (40, 40, 0.4, 0.3, False), (0, 0, None, None, False)]) for m in ("perception", "perception_error_stratum", "reasoning_pooled", "reasoning_error_stratum", "reasoning_clean_stratum") if i < 5 or m == "reasoning_clean_stratum"]
    df = spark.createDataFrame(rows, "g int, measure string, n_error int, n_correct int, auroc double, ci_low double, excludes_chance boolean")
    got = {(r["g"], r["hypothesis"]): r["verdict"] for r in ranking.judged(df, ["g"]).collect()}
    assert len(got) == 30
    want = {
        "perception": ["replicated", "inconclusive_underpowered", "weaker_than_pilot", "weaker_than_pilot", "failed_to_replicate", "not_measured"], "reasoning_pooled": ["signal_confirmed", "inconclusive_underpowered", "signal_confirmed", "no_signal", "no_signal", "not_measured"],
        "reasoning_stratified": ["confirmed", "inconclusive_underpowered", "not_confirmed", "not_confirmed", "not_confirmed", "not_measured"], "clean_stratum_inversion": ["not_confirmed", "inconclusive_underpowered", "not_confirmed", "not_confirmed", "confirmed", "not_measured"],
    }
    for name, verdicts in want.items():
        assert [got[i, name] for i in range(6)] == verdicts, name
    assert [got[i, "perception_pooled_not_comparable"] for i in range(6)] == want["perception"]
    assert ranking.judged(df.filter("g = 0")).count() == 5


def test_resampling_is_registered_at_the_reference_size(monkeypatch):
    entry = __import__("__spark_entry__")
    from verdance.plans import core

    seen = {}
    monkeypatch.setattr(core.nullmodel, "null_grid", lambda s, truths, p, k, items, sims, seed: seen.update(null=(len(truths) * len(p) * len(k), items, sims)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        entry.queries()["null_simulation"](None, "")
    assert seen["null"] == (285, 650, 2000)
    assert core.REPS == 10_000 and {"bootstrap_auroc_full", "paired_auroc_diff_full", "conformal_splits_full"} <= set(entry.queries())


def test_verdict_queries_have_bootstrap_forms():
    assert {"stratum_verdict_bootstrap", "scaleup_verdict_bootstrap", "auroc_strata_interval", "auroc_cuts_interval", "weighted_auroc_interval", "grid_summary_interval"} <= set(__import__("__spark_entry__").queries())


def test_curves(spark):
    df = run_of(spark, [1.332179 + 4e-7, 1.6], [0.0, 0.0, 1.332179 + 4e-7, 0.5])
    exact = {round(r["threshold"], 6): (r["n_kept"], r["n_errors_kept"]) for r in deferral.curve(df, "s", "ok").collect()}
    assert exact == {0.0: (2, 0), 0.5: (3, 0), 1.332179: (5, 1), 1.6: (6, 2)}
    compat = {r["threshold"]: r["n_kept"] for r in deferral.curve(df, "s", "ok", compat=True).collect()}
    assert compat[1.332179] == 3  # rounded down, the level loses its own rows
    area = deferral.aurc(deferral.curve(df, "s", "ok")).first()
    assert abs(area["aurc"] - (2 / 6 * (1 / 5) + 1 / 6 * (2 / 6))) < 1e-12 and abs(area["e_aurc_on_grid"] - (area["aurc"] - area["oracle_aurc_on_grid"])) < 1e-12
    with pytest.raises(ValueError):
        deferral.coverage_at_risk(deferral.curve(df, "s", "ok"), [2.0])


def test_exact_null_goldens(spark):
    for p, k, want in ((0.8, 5, 0.851309152), (0.843, 5, 0.897822268), (0.9, 3, 0.857142857), (0.65, 15, 0.826633363)):
        got = {r["truth_condition"]: r["auroc_exact"] for r in nullmodel.exact_auroc(nullmodel.cells(spark, ["y=1", "y=0"], [p], [k])).collect()}
        assert abs(got["y=1"] - want) < 1e-9 and abs(got["y=1"] + got["y=0"] - 1) < 1e-12
    assert abs(nullmodel.exact_auroc(nullmodel.cells(spark, ["y=1"], [0.5], [7])).first()["auroc_exact"] - 0.5) < 1e-12
    seed = nullmodel.cells(spark, ["y=1"], [0.05], [3]).select(nullmodel.cell_seed(20260814, F.col("truth_condition"), F.col("p"), F.col("k"))).first()[0]
    assert seed == 1602315233
    with pytest.raises(ValueError):
        nullmodel.cells(spark, ["y=1"], [0.5], [4])


def test_simulated_null_is_near_the_exact_one(spark):
    grid = nullmodel.cells(spark, ["y=1"], [0.8], [5])
    sim = nullmodel.simulate(grid, 300, 20, 1).first()
    assert abs(sim["auroc_median"] - 0.8513) < 0.03 and sim["n_valid"] == 20


def test_resample_keys_must_match(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    assert runs.join_resample(a, a, ["k"]).columns == ["k", "v", "v_resample"]
    for other in (a.filter("k = 1"), a.unionByName(a)):
        with pytest.raises(Exception, match="one to one"):
            runs.join_resample(a, other, ["k"]).collect()


def test_impossible_entropy_is_an_error(spark):
    with pytest.raises(Exception, match="five labels"):
        spark.createDataFrame([(0.3,)], "h double").select(stats.k5_distinct(F.col("h"))).collect()


def test_null_simulations_agree_with_the_closed_form(spark):
    """Strata lie on their exact values, and a sample with half of each truth is back at chance."""
    grid = nullmodel.null_grid(spark, nullmodel.CONDITIONS, [0.5, 0.8], [5], 650, 400, 7).collect()
    by = {(r["truth_condition"], r["p"]): r for r in grid}
    for (condition, _), r in by.items():
        if condition == "pooled_balanced":
            assert r["auroc_exact"] is None and abs(r["auroc_median"] - 0.5) < 0.02
        else:
            assert abs(r["auroc_median"] - r["auroc_exact"]) < 0.02 and r["auroc_low"] <= r["auroc_exact"] <= r["auroc_high"]
        assert r["n_valid"] + r["n_invalid"] == 400
    assert nullmodel.bias_only(spark, 300, 1.0, 5, 50).first()["n_valid"] == 0


def test_deep_documents_and_fractions(spark):
    """No depth is too deep: JSON leaves at depth 12, fractions in fractions, commas and bare semicolons kept apart."""
    from verdance.functions import text

    row = spark.range(1).select(F.lit('{"a":' * 12 + '3, "s": "x", "t": true, "l": [1]' + "}" * 12).alias("j"))
    got = runs.flatten_json(row.select(F.replace("j", F.lit('3, "s"'), F.lit('{"n": 3, "s"')).alias("j")).select(F.concat("j", F.lit("}")).alias("j")), "j").collect()
    assert [(r["key"], r["value"]) for r in got] == [(".".join(["a"] * 12 + ["n"]), 3.0)]
    nested = "1"
    for i in range(9):
        nested = "\\frac{" + nested + "}{" + str(i + 2) + "}"
    assert spark.range(1).select(text.numeric_surface(F.lit(nested))).first()[0] == "1/2/3/4/5/6/7/8/9/10"
    assert spark.range(1).select(text.cosmetic(F.lit("text:x=1;y=2\\;z"))).first()[0] == "text:x=1;y=2z"


def test_conformal_draws_agree_with_hashed_splits(spark):
    from verdance.functions.stats import hash_key

    df = spark.createDataFrame([(i, float(i % 7) / 4, (i * 7919) % 10 >= i % 7) for i in range(700)], "item int, s double, ok boolean")
    order = hash_key("split", F.concat_ws("|", "rep", "item"))
    one = {r["target_risk"]: r for r in deferral.conformal_splits(df, "item", "s", "ok", [0.2, 0.4], 60, order).collect()}
    two = {r["target_risk"]: r for r in deferral.conformal_draws(df, "s", "ok", [0.2, 0.4], 600).collect()}
    assert set(one) == set(two) and {r["n_valid"] + r["n_unachievable"] for r in two.values()} == {600}
    for t in one:
        assert abs(one[t]["n_valid"] / 60 - two[t]["n_valid"] / 600) < 0.15 and abs(one[t]["mean_coverage"] - two[t]["mean_coverage"]) < 0.05 and abs(one[t]["mean_test_risk"] - two[t]["mean_test_risk"]) < 0.03


def test_sheets_refuse_to_lose_answers(spark):
    from verdance.operators import sheets

    new = spark.createDataFrame([(1, ""), (2, "")], "item int, answer string")
    assert {tuple(r) for r in sheets.keep_answers(new, spark.createDataFrame([(1, "yes"), (3, " ")], "item int, answer string"), "item", ["answer"], "answer").collect()} == {(1, "yes"), (2, "")}
    with pytest.raises(Exception, match="people have coded"):
        sheets.keep_answers(new, spark.createDataFrame([(3, "yes")], "item int, answer string"), "item", ["answer"], "answer").collect()
    texts = spark.createDataFrame([("aĠb",), ("x",)], "t string")
    with pytest.raises(Exception, match="corrupt judge outputs"):
        sheets.decode_guard(texts, F.when(F.col("t").contains("Ġ"), "shredded").otherwise("clean")).collect()
    low, high = spark.range(1).select(sheets.binomial_interval(F.lit(61), F.lit(57), 20_000).alias("c")).select("c.*").first()
    assert abs(low - 0.869) < 0.01 and abs(high - 0.984) < 0.01


def test_span_scores_of_written_items(spark):
    from verdance.operators import sheets

    samples = spark.createDataFrame([(1, 0, "**Answer:** $a \\times b$."), (1, 1, "**Answer:** $a*b$"), (1, 2, "nothing"), (2, 0, "**Answer:** 5"), (3, 0, "none"), (3, 1, "none")], "item_id int, pos int, response string")
    truths = spark.createDataFrame([(1, "q", "$A * b$"), (2, "which option?", "6"), (3, "q", "7")], "item_id int, question string, truth string")
    got = {r["item_id"]: r for r in sheets.span_scores(samples, truths, ["item_id"]).collect()}
    assert got[1]["correct_v2"] and not got[1]["correct_v1"] and got[1]["model_span_norm"] == "a*b"
    assert not got[2]["correct_v2"] and got[2]["is_mcq"] and got[2]["tiny_valid_mcq"]
    assert not got[3]["correct_v2"] and got[3]["model_span"] is None and got[3]["model_label"] == "<parse_failure>"
    summary = sheets.accuracy_summary(sheets.span_scores(samples, truths, ["item_id"])).first()
    assert (summary["n"], summary["v2_correct"], summary["v2_only_correct"], summary["v1_only_correct"]) == (3, 1, 1, 0)


def test_the_row_before_needs_no_single_task(spark):
    rows = [(g, float(i) + 0.5 * (i % 3 == 0), i // 4) for g in ("a", None) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    got = {(r["g"], r["x"]): r["prev_v"] for r in ranking.before(df, ["v"], "x", ["g"]).collect()}
    for g in ("a", None):
        own = sorted((x, v) for h, x, v in rows if h == g)
        assert [got[(g, x)] for x, _ in own] == [0] + [v for _, v in own[:-1]]
    assert {(r["x"], r["prev_v"]) for r in ranking.before(df.filter("g is null"), ["v"], "x").collect()} == {(r["x"], r["prev_v"]) for r in ranking.before(df.filter("g is null"), ["v"], "x", few=True).collect()}
