"""Audit labels: union and precedence, overlaps, agreement, corrections, weighted estimates, confusion cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import dbl, ratio, wilson

# The audit's vocabulary.
TRUTH = {
    "true_correct": "correct", "true_wrong": "wrong", "notation_misread": "wrong", "copied_wrong_line": "wrong", "hallucination": "wrong", "extraction_issue": "indeterminate", "needs_visual": "indeterminate",
}
REAL_ERRORS = ("notation_misread", "copied_wrong_line", "hallucination")
MODEL_WRONG = ("notation_misread", "copied_wrong_line", "true_wrong", "hallucination")


def truth_of(label: Column) -> Column:
    """correct, wrong or indeterminate; a label outside the vocabulary is an error."""
    known = F.coalesce(*(F.when(label == k, v) for k, v in TRUTH.items()))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("label outside the vocabulary: "), F.coalesce(label, F.lit("null")))).cast("string"))


def union(sets: dict[str, DataFrame], item: str = "item") -> DataFrame:
    """item, audit_set, final_label, note, truth: overlaps stay."""
    out = None
    for name, df in sets.items():
        part = df.select(F.col(item).alias("item"), F.lit(name).alias("audit_set"), "final_label", "note")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("truth", truth_of(F.col("final_label")))


def invariants(long: DataFrame) -> DataFrame:
    per = long.groupBy("item").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("truth") != "indeterminate", F.col("truth"))).alias("sides"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique_items"), (F.sum("n") - F.count("*")).alias("n_overlap_rows"), F.count_if(F.col("n") > 1).alias("n_items_coded_twice"), F.count_if(F.col("sides") > 1).alias("n_hard_contradictions"))


def pairs(long: DataFrame) -> DataFrame:
    """Items in two sets, once a pair of sets in name order: hard (opposite verdicts) or soft (other labels) difference."""
    a = long.select("item", F.col("audit_set").alias("set_a"), F.col("final_label").alias("label_a"), F.col("truth").alias("truth_a"), F.col("note").alias("note_a"))
    b = long.select("item", F.col("audit_set").alias("set_b"), F.col("final_label").alias("label_b"), F.col("truth").alias("truth_b"), F.col("note").alias("note_b"))
    both = a.join(b, "item").filter("set_a < set_b")
    decided = (F.col("truth_a") != "indeterminate") & (F.col("truth_b") != "indeterminate")
    kind = F.when(decided & (F.col("truth_a") != F.col("truth_b")), "hard").when(F.col("label_a") != F.col("label_b"), "soft").otherwise("none")
    return both.withColumn("difference", kind)


def overlaps(long: DataFrame) -> DataFrame:
    return pairs(long).groupBy("set_a", "set_b").agg(F.count("*").alias("n_shared"), F.count_if(F.col("difference") == "hard").alias("n_hard"), F.count_if(F.col("difference") == "soft").alias("n_soft"))


def precedence(long: DataFrame, order: list[str]) -> DataFrame:
    """One row an item, from the set that comes first in the order."""
    rank = F.coalesce(*(F.when(F.col("audit_set") == s, i) for i, s in enumerate(order)), F.lit(len(order)))
    first = Window.partitionBy("item").orderBy(rank, "final_label")
    return long.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def set_diagnostics(long: DataFrame, verdicts: DataFrame, rules: list[str]) -> DataFrame:
    """Per set: sizes, and per rule agreement with the truth, false passes and fails, and whether the set can show any error."""
    rows = long.join(verdicts, "item", "left")
    decided, good = F.col("truth") != "indeterminate", F.col("truth") == "correct"
    sides = F.count_distinct(F.when(decided, F.col("truth")))
    aggs = [F.count("*").alias("n"), F.count_if(decided).alias("n_determinate"), F.count_if(~decided).alias("n_indeterminate"), F.count_if(F.col("final_label") == "extraction_issue").alias("extraction_issue"), (sides < 2).alias("truth_one_directional")]
    for r in rules:
        s = F.col(r)
        aggs += [F.count_if(decided & (s == good)).alias(f"{r}_agree"), F.count_if(decided & s & ~good).alias(f"{r}_false_pass"), F.count_if(decided & ~s & good).alias(f"{r}_false_fail"), ((sides < 2) & (F.count_distinct(F.when(decided, s)) < 2)).alias(f"{r}_tautological")]
    out = rows.groupBy("audit_set").agg(*aggs)
    for r in rules:
        out = out.withColumn(f"{r}_agreement", ratio(F.col(f"{r}_agree"), F.col("n_determinate")))
    return out.withColumn("extraction_issue_rate", ratio(F.col("extraction_issue"), F.col("n")))


def human_verdict(label: Column, majority_failed: Column) -> Column:
    """Three-valued: false for a model's own error, true where it was right or only the scoring failed, null if undecided."""
    return (
        F.when(label.isin(*REAL_ERRORS), False).when(label == "true_correct", True).when((label == "needs_visual") | majority_failed, None).when(label == "extraction_issue", True)
        .otherwise(F.raise_error(F.lit("unhandled audit label")).cast("boolean"))
    )


def corrected(run: DataFrame, audit: DataFrame, unknown_as: bool) -> DataFrame:
    """run (item, correct, majority_failed, ...) with was_audited and corrected_correct."""
    joined = run.join(audit.select("item", F.col("final_label").alias("_label"), F.lit(True).alias("_a")), "item", "left")
    told = F.when(F.col("_a"), F.coalesce(human_verdict(F.col("_label"), F.col("majority_failed")), F.lit(unknown_as))).otherwise(F.col("correct"))
    return joined.withColumns({"was_audited": F.coalesce("_a", F.lit(False)), "corrected_correct": told}).drop("_label", "_a")


def accuracy_bounds(run: DataFrame, audit: DataFrame) -> DataFrame:
    """Accuracy as scored, and with the audit's corrections if unknowns are wrong or right: one pass."""
    joined = run.join(audit.select("item", F.col("final_label").alias("_label"), F.lit(True).alias("_a")), "item", "left")
    told = human_verdict(F.col("_label"), F.col("majority_failed"))
    low, high = (F.when(F.col("_a"), F.coalesce(told, F.lit(u))).otherwise(F.col("correct")) for u in (False, True))
    n = F.count("*")
    return joined.agg(
        n.alias("n"), F.count_if("correct").alias("baseline_correct"), ratio(F.count_if("correct"), n).alias("baseline_accuracy"), F.count_if(low).alias("corrected_correct_low"), F.count_if(high).alias("corrected_correct_high"),
        ratio(F.count_if(low), n).alias("corrected_accuracy_low"), ratio(F.count_if(high), n).alias("corrected_accuracy_high"),
    )


def false_passes(spot: DataFrame) -> DataFrame:
    n, fp, tc = F.count("*"), F.count_if(F.col("final_label") == "extraction_issue"), F.count_if(F.col("final_label") == "true_correct")
    out = spot.agg(n.alias("n_sampled"), fp.alias("n_false_pass"), tc.alias("n_true_correct"))
    (lo, hi), (tlo, thi) = wilson(F.col("n_false_pass"), F.col("n_sampled")), wilson(F.col("n_true_correct"), F.col("n_sampled"))
    return out.select("*", (F.col("n_sampled") - F.col("n_false_pass") - F.col("n_true_correct")).alias("n_undecided"), ratio(F.col("n_false_pass"), F.col("n_sampled")).alias("false_pass_rate"), lo.alias("ci_low"), hi.alias("ci_high"), ratio(F.col("n_true_correct"), F.col("n_sampled")).alias("true_correct_rate"), tlo.alias("tc_low"), thi.alias("tc_high"))


def two_sided_bounds(run: DataFrame, audit: DataFrame, spot: DataFrame) -> DataFrame:
    both = accuracy_bounds(run, audit).join(F.broadcast(false_passes(spot)))
    base, n = F.col("baseline_correct"), dbl(F.col("n"))
    low, high = F.col("corrected_correct_low") - base, F.col("corrected_correct_high") - base
    return both.select(
        "n", "baseline_accuracy", "false_pass_rate", low.alias("recovered_low"), high.alias("recovered_high"), ((base * F.col("true_correct_rate") + low) / n).alias("accuracy_point"),
        ((base * F.col("tc_low") + low) / n).alias("accuracy_low"), ((base * F.col("tc_high") + high) / n).alias("accuracy_high"),
    )


def deferral_precision(run: DataFrame, audit: DataFrame, score: str, quantile: float | None = None, threshold: float | None = None) -> DataFrame:
    if (quantile is None) == (threshold is None):
        raise ValueError("either a quantile or a threshold")
    rows = run.join(audit.select("item", "final_label"), "item").withColumn("told", human_verdict(F.col("final_label"), F.col("majority_failed")))
    cut = rows.agg((F.percentile(score, F.lit(quantile)) if threshold is None else F.lit(float(threshold))).alias("threshold"))
    marked = rows.join(F.broadcast(cut)).withColumn("flagged", F.col(score) >= F.col("threshold"))
    real, scoring, unknown = (F.count_if(F.col("flagged") & c) for c in (~F.col("told"), F.col("told"), F.col("told").isNull()))
    return marked.agg(F.max("threshold").alias("threshold"), F.count_if("flagged").alias("n_flagged"), real.alias("n_real_error"), scoring.alias("n_scoring_failure"), unknown.alias("n_unknown"), ratio(real, real + scoring).alias("precision_real_error"), ratio(F.count_if(~F.col("told")), F.count("*")).alias("base_rate_real_error"))


def weighted_labels(run: DataFrame, audit: DataFrame, spot: DataFrame, unknown_as: bool) -> DataFrame:
    """item, score columns of run, corrected_correct, side, weight: a census of the wrong side, a weighted sample of the right one."""
    wrong = run.join(audit.select("item", "final_label"), "item").withColumn("corrected_correct", F.coalesce(human_verdict(F.col("final_label"), F.col("majority_failed")), F.lit(unknown_as))).withColumns({"side": F.lit("wrong_side"), "weight": F.lit(1.0)})
    n = run.agg(F.count_if("correct").alias("_n"))
    size = spot.agg(F.count("*").alias("_s"))
    earned = F.when(F.col("final_label") == "true_correct", True).when(F.col("final_label") == "extraction_issue", False).otherwise(unknown_as)
    right = run.join(spot.select("item", "final_label"), "item").withColumn("corrected_correct", earned).join(F.broadcast(n)).join(F.broadcast(size)).withColumns({"side": F.lit("correct_side"), "weight": ratio(F.col("_n"), F.col("_s"))}).drop("_n", "_s")
    return wrong.unionByName(right)


CONFUSION = ("TP", "FP", "FN", "TN", "INDETERMINATE", "NEEDS_VISUAL")


def confusion(correct: Column, label: Column) -> Column:
    return (
        F.when(label == "true_correct", F.when(correct, "TP").otherwise("FN")).when(label.isin(*MODEL_WRONG), F.when(correct, "FP").otherwise("TN"))
        .when(label == "extraction_issue", F.when(correct, "FP").otherwise("INDETERMINATE")).when(label == "needs_visual", "NEEDS_VISUAL").otherwise("INDETERMINATE")
    )


def confusion_violations(cells: DataFrame, category: str, correct: str) -> DataFrame:
    """Rows whose verdict contradicts their cell (none, if all is well)."""
    says = F.when(F.col(category).isin("TP", "FP"), True).when(F.col(category).isin("FN", "TN", "INDETERMINATE"), False)
    return cells.filter(~F.col(category).isin(*CONFUSION) | (says != F.col(correct)))
