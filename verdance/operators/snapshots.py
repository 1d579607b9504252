"""Every figure of a run: as one long table (key, value), and as the nested JSON document that is stored and compared.

A run has item, has_error, two arms (entropy and correctness of what was read and of what was graded), and failed
parses of either. A figure has its path (names, which may hold dots) and its key (the path with dots); undefined figures are
null, truths are 0 or 1 in the table and true or false in the document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import dbl, ratio
from . import ranking
from .deferral import aurc, conformal_draws, curve

# Figures of an interval, figures that are truths, and those that a comparison names first.
CI = ("auroc", "ci_low", "ci_high", "n_items", "n_error", "excludes_chance")
TRUTHS = ("excludes_chance", "robust", "is_balanced", "is_degenerate", "pooled_is_misleading_unless_balanced")
HEADLINE = ("perception.auroc", "perception.aurc", "reasoning.auroc", "grading.accuracy", "abstention.precision")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.array_join("path", ".").alias("key"), "path", "value")


def long(row: DataFrame, prefix: str, columns: list[str], by: Column | None = None) -> DataFrame:
    """key, path, value of these columns of a frame's rows; by names the row inside the prefix (null: the prefix itself)."""
    stem = F.array(*(F.lit(x) for x in prefix.split(".") if x)).cast("array<string>")
    stem = stem if by is None else F.concat(stem, F.when(by.isNull(), F.array().cast("array<string>")).otherwise(F.array(by)))
    return _named(row.select(stem.alias("_p"), *(dbl(F.col(c)).alias(c) for c in columns)).unpivot(["_p"], columns, "_k", "value").select(F.array_append("_p", F.col("_k")).alias("path"), "value"))


def _ranked(run: DataFrame, score: str, correct: str, reps: int, by: list[str]) -> DataFrame:
    """Per group: AUROC, and its interval where reps are asked for."""
    points = ranking.auroc(run, score, correct, by, few=True)
    return ranking.with_interval(points, ranking.bootstrap_cells(run, score, correct, reps, by), by) if reps else points


def _strata(run: DataFrame) -> DataFrame:
    names = F.array(F.lit("pooled"), F.when(F.col("has_error"), "error_stratum").otherwise("clean_stratum"))
    return run.withColumn("stratum", F.explode(names))


def _arm(run: DataFrame, score: str, correct: str, reps: int, pool: str | None) -> DataFrame:
    shown = list(CI) if reps else ["auroc", "n_items", "n_error"]
    name = F.when(F.col("stratum") != "pooled", F.col("stratum")).otherwise(F.lit(pool))
    return long(_ranked(_strata(run).withColumnRenamed(score, "_s").withColumnRenamed(correct, "_c"), "_s", "_c", reps, ["stratum"]), "reasoning", shown, name)


def _grading(run: DataFrame) -> DataFrame:
    says = F.col("grading_correct").cast("int")
    rate = F.avg(F.col("has_error").cast("int"))
    row = run.agg(F.avg(says).alias("accuracy"), F.avg(F.when(F.col("has_error"), says)).alias("accuracy_on_error_items"), F.avg(F.when(~F.col("has_error"), says)).alias("accuracy_on_clean_items"), F.greatest(rate, 1 - rate).alias("baseline_accuracy"))
    return long(row, "grading", ["accuracy", "accuracy_on_error_items", "accuracy_on_clean_items", "baseline_accuracy"])


def metrics(run: DataFrame, k: int, reps: int = 10_000, splits: int = 1_000, targets: tuple[float, ...] = (0.30, 0.40, 0.50)) -> DataFrame:
    """Figures of a full run. reps and splits 0: without intervals and conformal splits, which are drawn."""
    at_max = F.abs(F.col("perception_entropy") - math.log(k)) <= 1e-8 + 1e-5 * math.log(k)
    wrong = ~F.col("perception_correct")
    total = run.agg(
        F.count("*").alias("n_items"), F.lit(k).alias("k_transcription"), F.lit(k).alias("k_grading"), F.avg(F.col("has_error").cast("int")).alias("frac_has_error"), F.avg(F.col("perception_correct").cast("int")).alias("perception.accuracy"),
        F.count_if(at_max).alias("abstention.n_flagged"), F.count_if(at_max & wrong).alias("abstention.n_flagged_wrong"), ratio(F.count_if(at_max & wrong), F.count_if(at_max)).alias("abstention.precision"), ratio(F.count_if(at_max & wrong), F.count_if(wrong)).alias("abstention.recall"),
        ratio(F.sum("n_transcription_parse_failures"), F.count("*") * k).alias("integrity.transcription_parse_failure_rate"), ratio(F.sum("n_grading_parse_failures"), F.count("*") * k).alias("integrity.grading_parse_failure_rate"),
    )
    parts = [_named(total.select(*(dbl(F.col(f"`{c}`")).alias(c) for c in total.columns)).unpivot([], [F.col(f"`{c}`") for c in total.columns], "key", "value").select(F.split("key", r"\.").alias("path"), "value"))]
    cuts = ranking.with_cuts(run, "perception_entropy", "n_transcription_parse_failures", math.log(k))
    sensitivity = _ranked(cuts, "perception_entropy", "perception_correct", reps, ["cut"])
    parts.append(long(sensitivity.filter(F.col("cut") == ranking.CUTS[0]), "perception", list(CI) if reps else ["auroc", "n_items", "n_error"]))
    parts.append(long(sensitivity, "perception.sensitivity", ["auroc", "ci_low", "ci_high", "n_items"] if reps else ["auroc", "n_items"], F.col("cut")))
    if reps:
        parts.append(long(sensitivity.agg(F.coalesce(F.max(F.when(F.col("cut") == ranking.CUTS[3], F.col("excludes_chance"))), F.lit(False)).alias("robust")), "perception", ["robust"]))
    for arm in ("perception", "reasoning"):
        correct = "perception_correct" if arm == "perception" else "grading_correct"
        points = curve(run, f"{arm}_entropy", correct, few=True)
        parts.append(long(aurc(points, few=True).select("aurc", F.col("baseline_aurc").alias("aurc_baseline")), arm, ["aurc", "aurc_baseline"]))
        if arm == "perception":
            level = F.concat(F.lit("level_"), F.format_string("%.6f", "threshold"))
            parts.append(long(points, "risk_coverage", ["coverage", "risk_kept", "n_kept"], level))
    parts += [_arm(run, "reasoning_entropy", "grading_correct", reps, None), _grading(run)]
    if splits:
        found = conformal_draws(run, "perception_entropy", "perception_correct", list(targets), splits)
        parts.append(long(found, "conformal", [c for c in found.columns if c != "target_risk"], F.format_string("target_%.2f", "target_risk")))
    return reduce(DataFrame.unionByName, parts)


def grading_metrics(run: DataFrame, k: int, reps: int = 10_000) -> DataFrame:
    """Figures of a run that was only graded: composition, accuracies, the pool and both strata, the entropy's levels and whether one holds too many items."""
    gt = F.col("has_error")
    n, share = F.count("*"), F.avg(gt.cast("int"))
    even = F.coalesce(F.abs(share - 0.5) < 0.01, F.lit(False))
    row = run.agg(n.alias("n_items"), F.lit(k).alias("k_grading"), F.count_if(gt).alias("n_has_error"), F.count_if(~gt).alias("n_clean"), share.alias("frac_has_error"), even.cast("int").alias("is_balanced"), (~even).cast("int").alias("pooled_is_misleading_unless_balanced"), ratio(F.sum("n_grading_parse_failures"), n * k).alias("grading_parse_failure_rate"))
    levels = ranking.distribution(run, "reasoning_entropy")
    facts = levels.agg(F.max("n_distinct_values").alias("n_distinct_values"), F.max("largest_share").alias("largest_single_value_share"), F.max(F.col("is_degenerate").cast("int")).alias("is_degenerate"))
    counted = _named(levels.select(F.array(F.lit("entropy_distribution"), F.lit("counts"), F.col("reasoning_entropy").cast("string")).alias("path"), dbl(F.col("n")).alias("value")))
    parts = [long(row, "", ["n_items", "k_grading"]), long(row, "composition", ["n_has_error", "n_clean", "frac_has_error", "is_balanced"]), long(row, "integrity", ["grading_parse_failure_rate"]), long(row, "reasoning", ["pooled_is_misleading_unless_balanced"])]
    parts += [_grading(run), _arm(run, "reasoning_entropy", "grading_correct", reps, "pooled"), long(facts, "entropy_distribution", facts.columns), counted]
    return reduce(DataFrame.unionByName, parts)


def stratum_verdicts(figures: DataFrame) -> DataFrame:
    """path, json of both strata's verdicts, from the figures of a graded run with intervals; a stratum without figures is not measured."""
    names = figures.sparkSession.createDataFrame([("error_stratum",), ("clean_stratum",)], "stratum string")
    at = lambda c: F.max(F.when(F.get("path", F.lit(2)) == c, F.col("value"))).alias(c)
    found = figures.filter((F.get("path", F.lit(0)) == "reasoning") & (F.size("path") == 3)).groupBy(F.get("path", F.lit(1)).alias("stratum")).agg(*(at(c) for c in CI))
    rows = names.join(found, "stratum", "left")
    n, bad = F.col("n_items"), F.col("n_error")
    verdict = ranking.stratum_verdict(n, bad, n - bad, F.col("auroc"), F.col("ci_high"), F.coalesce(F.col("excludes_chance") > 0, F.lit(False)))
    return rows.select(F.array(F.lit("reasoning"), F.concat("stratum", F.lit("_verdict"))).alias("path"), quoted(verdict).alias("json"))


def curve_list(run: DataFrame) -> DataFrame:
    """path, json of the risk-coverage curve as a list of points, in order of threshold (as many as the entropy has levels)."""
    points = curve(run, "perception_entropy", "perception_correct", few=True)
    kept = F.struct("threshold", "coverage", "n_kept", (F.col("n_items") - F.col("n_kept")).alias("n_deferred"), (1 - F.col("risk_kept")).alias("accuracy_kept"), "risk_kept", F.col("n_errors_kept"))
    return points.agg(F.to_json(F.sort_array(F.collect_list(kept))).alias("json")).select(F.array(F.lit("risk_coverage")).alias("path"), "json")


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(text), {"ignoreNullFields": "false"}), r"^\[|\]$", "")


def notes(figures: DataFrame, facts: dict[str, str | bool | None]) -> DataFrame:
    """path, json of what is told about a run: its label, its model, whether formulas were parsed."""
    import json

    return figures.sparkSession.createDataFrame([([k], json.dumps(v)) for k, v in facts.items()], "path array<string>, json string")


def document(figures: DataFrame, more: DataFrame | None = None, depth: int = 5) -> DataFrame:
    """One row, `document`: the figures (path, value) and what else is given (path, json) as nested JSON, names in order.

    Leaves go into the objects above them level by level, from the deepest up: each step groups the rows of its depth by their
    parents, and leaves the others alone. Paths of over `depth` names are an error.
    """
    last = F.element_at("path", -1)
    value = F.col("value")
    number = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "null").when(last.isin(*TRUTHS), (value != 0).cast("string")).when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    rows = figures.select("path", number.alias("json"))
    rows = rows if more is None else rows.filter(F.get("path", F.lit(0)) != "risk_coverage").unionByName(more.select("path", "json"))
    rows = rows.filter(F.when(F.size("path") <= depth, True).otherwise(F.raise_error(F.lit(f"a path has more than {depth} names")).cast("boolean")))
    for level in range(depth, 0, -1):
        here = F.size("path") == level
        above = F.when(here, F.slice("path", 1, level - 1)).otherwise(F.col("path")).alias("path")
        member = F.when(here, F.concat(quoted(last), F.lit(":"), F.col("json")))
        found = rows.groupBy(above).agg(F.sort_array(F.collect_list(member)).alias("members"), F.max(F.when(~here, F.col("json"))).alias("own"))
        rows = found.select("path", F.coalesce("own", F.concat(F.lit("{"), F.array_join("members", ","), F.lit("}"))).alias("json"))
    return rows.select(F.col("json").alias("document"))
