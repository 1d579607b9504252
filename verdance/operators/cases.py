"""Single items in full: traces of every step of scoring, the views that made the majority, nested case bundles."""

from __future__ import annotations


import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scans, text
from ..functions.text import payload
from .votes import ballot, entropy, fields, looked_up, tally, votes

CATEGORIES = ("high_entropy_correct", "low_entropy_wrong", "max_entropy_degenerate", "non_engagement_says_error", "confidently_wrong_grading")


def sides(df: DataFrame, field: str, rule: str = "strict_v1") -> DataFrame:
    """df with tier, final (the extracted answer) and label of a field."""
    fixed = rule != "strict_v1"
    final = scans.answer_span(F.col(field)) if fixed else text.extract_final(F.col(field))
    return scans.with_label(df.withColumn("tier", text.extraction_tier(F.col(field))).withColumn("final", final), field, "label", rule)


def steps(field: Column, rule: str = "strict_v1") -> Column:
    """`sides` as a struct (field, tier, final, label) of SQL functions."""
    final = text.extract_final(field) if rule == "strict_v1" else scans.answer_span(field)
    return text.let(final, lambda x: F.struct(field.alias("field"), text.extraction_tier(field).alias("tier"), x.alias("final"), scans.ruled(x, rule).alias("label")))


def traced(samples: DataFrame, keys: list[str], rule: str = "strict_v1", response: str = "response", pos: str = "pos") -> DataFrame:
    """(keys, pos, field, tier, final, label) of every sample; a common response is parsed and labelled once."""
    of = lambda c: text.let(text.parse_answer(c), lambda field: steps(field, rule))
    return looked_up(samples.select(*keys, pos, F.col(response).alias("_field")), "_field", of, keys).select(*keys, pos, "_told.*")


def polled_sides(samples: DataFrame, keys: list[str], rule: str = "strict_v1", response: str = "response") -> DataFrame:
    """(keys, _n, pos, field, tier, final, label): `traced`, an item's equal fields counted together."""
    return looked_up(fields(samples, keys, response), "_field", lambda c: steps(c, rule), keys).select(*keys, "_n", "pos", "_told.*")


def trace(samples: DataFrame, truths: DataFrame, keys: list[str], rule: str = "strict_v1", truth: str = "truth") -> DataFrame:
    """One row an item: all steps of its samples (in order) and of its truth, entropy, majority and verdict."""
    all_ = F.sort_array(F.collect_list(F.struct("pos", "field", "tier", "final", "label")))
    per = traced(samples, keys, rule).groupBy(*keys).agg(tally(F.transform(all_, lambda x: ballot(x["label"], x["pos"]))).alias("_t"), all_.alias("samples"))
    told = looked_up(truths.select(*keys, F.col(truth).alias("_field")), "_field", lambda c: steps(c, rule), keys).select(*keys, F.col("_told").alias("ground_truth"))
    out = per.select(*keys, entropy(F.col("_t")).alias("entropy"), F.col("_t.best.label").alias("majority"), "samples").join(told, keys)
    return out.withColumn("correct", F.col("majority") == F.col("ground_truth.label"))


def label_views(samples: DataFrame, truths: DataFrame, keys: list[str], rule: str = "strict_v1", truth: str = "truth") -> DataFrame:
    """Span, label and tier of the first sample that produced the majority, and of the truth; collapsed if a long span became a tiny label."""
    rows = polled_sides(samples, keys, rule).select(*keys, "pos", "_n", "label", F.struct("final", "label", "tier").alias("m"))
    made = votes(rows, keys, count="_n", made="m").select(*keys, "entropy", "m")
    told = looked_up(truths.select(*keys, F.col(truth).alias("_field")), "_field", lambda c: steps(c, rule), keys).select(*keys, F.col("_told").alias("t"))
    span = F.coalesce("m.final", F.lit(""))
    return made.join(told, keys).select(
        *keys, "entropy", (F.col("m.label") == F.col("t.label")).alias("correct"), F.col("m.final").alias("model_span"), F.col("m.label").alias("model_label"), F.col("m.tier").alias("model_tier"),
        F.col("t.final").alias("truth_span"), F.col("t.label").alias("truth_label"), F.col("t.tier").alias("truth_tier"), ((F.length(payload(F.col("m.label"))) <= 3) & (F.length(span) > 12)).alias("collapsed"),
    )


#: Which rows show a category: verdict wanted (null: any), and whether high or low entropies come first.
SELECTED = {"low_entropy_correct": (True, False), "high_entropy_wrong": (False, True), "high_entropy_correct": (True, True), "low_entropy_wrong": (False, False), "confidently_wrong_grading": (False, False)}


def select(df: DataFrame, category: str, entropy: str, correct: str, key: str, n: int, k: int = 5, predicate: Column | None = None) -> DataFrame:
    """n rows of a category by rank of entropy, of equals the smaller key; wrong ones at the highest entropy of k answers for the degenerate one; a predicate defines any other."""
    if predicate is not None:
        return df.filter(predicate).orderBy(key).limit(n)
    if category == "max_entropy_degenerate":
        return df.filter((F.abs(F.col(entropy) - math.log(k)) <= 1e-9 * math.log(k)) & ~F.col(correct)).orderBy(key).limit(n)
    if category not in SELECTED:
        raise ValueError(f"category {category!r} needs a predicate")
    want, high = SELECTED[category]
    return df.filter(F.col(correct) == want).orderBy(F.col(entropy).desc_nulls_last() if high else F.col(entropy).asc_nulls_last(), key).limit(n)


def bundles(traces: DataFrame, category: str, run_label: str = "", note: str = "") -> DataFrame:
    """A JSON document an item: what was asked and told, every sample's steps, and what follows from them. Unknown categories are an error."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    k = F.size("samples")
    labels = F.transform("samples", lambda s: s["label"])
    at_max = (k > 0) & (F.abs(F.col("entropy") - F.log(k.cast("double"))) < 1e-9)
    count = F.size(F.filter(labels, lambda x: x == F.col("majority")))
    doc = F.struct(
        F.lit(run_label).alias("run_label"), F.lit(category).alias("category"), F.lit(note).alias("note"), F.col("ground_truth"),
        F.struct(k.alias("k"), F.col("samples"), F.size(F.filter("samples", lambda s: s["field"].isNull())).alias("n_parse_failures")).alias("model_output"),
        F.struct(F.col("entropy"), F.log(k.cast("double")).alias("max_possible_entropy"), at_max.alias("at_max_entropy"), F.col("majority").alias("majority_label"), count.alias("majority_count"), F.size(F.array_distinct(labels)).alias("n_distinct_labels"), F.col("correct")).alias("derived"),
    )
    rest = [c for c in traces.columns if c not in ("entropy", "majority", "samples", "ground_truth", "correct")]
    return traces.select(*rest, F.to_json(doc).alias("case"))
