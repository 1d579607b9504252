"""Whole-run checks and reports: parameter grids, resamples, snapshots and their diffs, cases, manifests, logs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import text
from ..functions.stats import dbl, ratio
from .deferral import aurc, curve
from .ranking import auroc, bootstrap_cells, with_interval

# ---- grids ----


def grid_problems(scored: DataFrame, temperatures: list[float], ks: list[int], n_items: int) -> DataFrame:
    """temperature, k, problem: duplicate rows, missing or unexpected conditions, incomplete ones. Empty for a complete grid."""
    want = scored.sparkSession.createDataFrame([(float(t), int(k)) for t in temperatures for k in ks], "temperature double, k int")
    per = scored.groupBy("temperature", "k", "item_id").agg(F.count("*").alias("c")).groupBy("temperature", "k").agg(F.count("*").alias("n"), F.max("c").alias("c"))
    both = per.withColumn("_have", F.lit(True)).join(want.withColumn("_want", F.lit(True)), ["temperature", "k"], "full_outer")
    problem = F.when(F.col("_have").isNull(), "missing_condition").when(F.col("_want").isNull(), "unexpected_condition").when(F.col("c") > 1, "duplicate_rows").when(F.col("n") != n_items, "incomplete_condition")
    return both.withColumn("problem", problem).filter("problem is not null").select("temperature", "k", "problem")


def grid_summary(scored: DataFrame, score: str, correct: str, failures: str) -> DataFrame:
    """Per (temperature, k): counts, accuracy, AUROC, area under the exact curve and its baseline, levels, failure rate."""
    by = ["temperature", "k"]
    base = scored.groupBy(*by).agg(F.count("*").alias("n_items"), F.count_if(~F.col(correct)).alias("n_error"), F.count_if(F.col(correct)).alias("n_correct"), F.avg(F.col(correct).cast("int")).alias("accuracy"), F.count_distinct(F.round(score, 12)).alias("n_entropy_values"), ratio(F.sum(failures), F.count("*") * F.first("k")).alias("parse_failure_rate"))
    ranks = auroc(scored, score, correct, by, few=True).select(*by, "auroc")
    area = aurc(curve(scored, score, correct, by, few=True), by, few=True).select(*by, "aurc", F.col("baseline_aurc").alias("random_aurc"))
    return base.join(ranks, by).join(area, by)


def grid_metrics(scored: DataFrame, score: str, correct: str, failures: str, reps: int) -> DataFrame:
    """The 14 public columns: grid_summary with each condition's interval."""
    by = ["temperature", "k"]
    out = with_interval(grid_summary(scored, score, correct, failures), bootstrap_cells(scored, score, correct, reps, by), by)
    return out.select(*by, "n_items", "n_error", "n_correct", "accuracy", "auroc", "ci_low", "ci_high", "excludes_chance", "aurc", "random_aurc", "n_entropy_values", "parse_failure_rate")


def reviewer_gate(summary: DataFrame, conditions: int, n_items: int, minority: int = 30) -> DataFrame:
    whole = (F.count("*") == conditions) & F.every(F.col("n_items") == n_items)
    powered = F.every(F.least("n_error", "n_correct") >= minority)
    return summary.agg(F.coalesce(whole, F.lit(False)).alias("complete"), F.coalesce(powered, F.lit(False)).alias("minority_at_least"), F.coalesce(whole & powered, F.lit(False)).alias("eligible"))


# ---- resamples ----


def join_resample(base: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join, the second's columns with _resample. Repeated keys, or keys on one side only, are an error."""
    rest = [c for c in again.columns if c not in keys]
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    bad = count(base, "_a").join(count(again, "_b"), keys, "full_outer").filter("_a is null or _b is null or _a > 1 or _b > 1").agg(F.count("*").alias("_bad"))
    joined = base.join(again.select(*keys, *(F.col(c).alias(f"{c}_resample") for c in rest)), keys)
    ok = F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(F.lit("keys don't match one to one")).cast("boolean"))
    return joined.join(F.broadcast(bad)).filter(ok).drop("_bad")


def k_comparison(joined: DataFrame, base: tuple[str, str], new: tuple[str, str], k_base: int, k_new: int) -> DataFrame:
    import math

    at_max = lambda c, k: F.avg((F.round(c, 6) == round(math.log(k), 6)).cast("int"))
    half = lambda s, c, side: F.median(F.when(F.col(c) == side, F.col(s)))
    facts = joined.agg(
        F.count_distinct(F.round(base[0], 6)).alias("n_distinct_base"), F.count_distinct(F.round(new[0], 6)).alias("n_distinct_new"), at_max(base[0], k_base).alias("frac_max_base"), at_max(new[0], k_new).alias("frac_max_new"),
        half(*new, True).alias("median_correct_new"), half(*new, False).alias("median_incorrect_new"), F.avg((F.col(base[1]) != F.col(new[1])).cast("int")).alias("flip_rate"), F.count_if(~F.col(new[1])).alias("n_incorrect_new"),
    )
    one = auroc(joined, *base, few=True).select(F.col("auroc").alias("auroc_base"))
    two = auroc(joined, *new, few=True).select(F.col("auroc").alias("auroc_new"))
    return facts.join(F.broadcast(one)).join(F.broadcast(two))


# ---- snapshots ----


def long_form(row: DataFrame) -> DataFrame:
    """key, value of the numeric columns of a one-row frame (booleans and texts are no metrics)."""
    numeric = [f.name for f in row.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") or f.dataType.typeName() == "decimal"]
    return row.select(*(dbl(F.col(c)).alias(c) for c in numeric)).unpivot([], numeric, "key", "value")


@pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", DoubleType())])))
def _leaves(docs: pd.Series) -> pd.Series:
    def numbers(doc) -> list[tuple[str, float]]:
        try:
            out, open_ = [], [("", json.loads(doc) if doc else None)]
        except ValueError:  # a damaged document has no leaves
            return []
        while open_:
            at, x = open_.pop()
            if isinstance(x, dict):
                open_ += [(f"{at}.{k}" if at else k, v) for k, v in x.items()]
            elif at and isinstance(x, int | float) and not isinstance(x, bool):
                out.append((at, float(x)))
        return out

    return pd.Series([numbers(doc) for doc in docs], dtype=object)


def flatten_json(docs: DataFrame, column: str) -> DataFrame:
    """key (dotted), value of every numeric leaf of JSON objects, however deep: one scan a document. Booleans, texts and lists are left out."""
    return docs.select(F.explode(_leaves(F.col(column))).alias("leaf")).select("leaf.key", "leaf.value")


def diff(old: DataFrame, new: DataFrame, tol: float = 1e-6, headline: list[str] = []) -> DataFrame:  # noqa: B006
    """key, old, new, delta, change (changed, added, removed), is_headline; what moved by at most tol is left out."""
    both = old.withColumnRenamed("value", "old").withColumn("_o", F.lit(1)).join(new.withColumnRenamed("value", "new").withColumn("_n", F.lit(1)), "key", "full_outer")
    moved = F.abs(F.col("new") - F.col("old")) > tol
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(moved | (F.col("new").isNull() != F.col("old").isNull()), "changed")
    return both.withColumn("change", change).filter("change is not null").select("key", "old", "new", (F.col("new") - F.col("old")).alias("delta"), "change", (F.col("key").isin(headline) if headline else F.lit(False)).alias("is_headline"))


# ---- cases, manifests, logs ----


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole row that comes first in each group of equal keys (null is a key); one aggregation, so a task sends on one row a group."""
    first = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), F.struct(F.col(order).isNull(), order)).alias("_row"))
    return first.select("_row.*")


def top_cases(df: DataFrame, correct: str, want: bool, score: str, key: str, n: int, highest: bool = True) -> DataFrame:
    """The n rows of that verdict with the highest (lowest) score, of equals the first key."""
    order = F.col(score).desc_nulls_last() if highest else F.col(score).asc_nulls_last()
    return df.filter(F.col(correct) == want).orderBy(order, key).limit(n)


def public_view(run: DataFrame, keep: list[str], hashed: dict[str, Column], sources: DataFrame, item: str) -> DataFrame:
    """Allow-listed columns, content hashes, and each item's audit sets as a sorted list."""
    by = sources.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("audit_set")), "|").alias("audit_sources"))
    out = run.join(by, F.col(item) == F.col("item"), "left")
    return out.select(*keep, *(c.alias(n) for n, c in hashed.items()), F.col("audit_sources").isNotNull().alias("in_audit_union"), F.coalesce("audit_sources", F.lit("")).alias("audit_sources"))


def manifests(run: DataFrame, item: str, keep: list[str], hashed: dict[str, Column], private: list[str], sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The public view of a run, which holds hashes of its texts and no text, and the private one, which holds the texts; both have the item."""
    both = set(private) & {*keep, *hashed}
    if both:
        raise ValueError(f"private columns in the public view: {sorted(both)}")
    return public_view(run, list(dict.fromkeys([item, *keep])), hashed, sources, item), run.select(item, *private)


def manifests_agree(public: DataFrame, private: DataFrame, item: str, hashed: dict[str, Column]) -> DataFrame:
    """n_public, n_private, n_agree, verified: items of both views whose texts give the published hashes. hashed: each hash from the private columns."""
    told = public.select(F.col(item).alias("_i"), F.struct(*hashed).alias("_told"))
    have = private.select(F.col(item).alias("_j"), F.struct(*(c.alias(n) for n, c in hashed.items())).alias("_have"))
    both = told.join(have, F.col("_i") == F.col("_j"), "full_outer")
    agree = F.coalesce(F.col("_told") == F.col("_have"), F.lit(False))
    return both.agg(F.count("_i").alias("n_public"), F.count("_j").alias("n_private"), F.count_if(agree).alias("n_agree"), F.coalesce(F.every(agree), F.lit(False)).alias("verified"))


def source_alignment(run: DataFrame, source: DataFrame, index: str, parts: list[str]) -> DataFrame:
    """alignment_status, n_aligned, n_expected: rows of a run whose parts are those of the source's row at their index. VERIFIED only if all are, and there are some."""
    said = run.select(F.col(index).alias("_i"), text.content_hash(*(F.col(p) for p in parts)).alias("_said"))
    there = source.select(F.col(index).alias("_j"), text.content_hash(*(F.col(p) for p in parts)).alias("_there"))
    ok = F.count_if(F.col("_said") == F.col("_there"))
    out = said.join(there, F.col("_i") == F.col("_j"), "left").agg(ok.alias("n_aligned"), F.count("*").alias("n_expected"))
    return out.select(F.when((F.col("n_aligned") == F.col("n_expected")) & (F.col("n_expected") > 0), "VERIFIED").otherwise("FAILED").alias("alignment_status"), "n_aligned", "n_expected")


def leaks(public: DataFrame, patterns: list[str], allowed: list[str]) -> DataFrame:
    """pattern, n_rows: rows in which a text column contains it. Columns outside the allow-list are an error."""
    extra = [c for c in public.columns if c not in allowed]
    if extra:
        raise ValueError(f"columns outside the allow-list: {extra}")
    texts = [c for c, kind in public.dtypes if kind == "string"]
    blob = F.concat_ws("\x1f", *texts)
    counts = public.agg(*(F.count_if(blob.contains(p)).alias(p) for p in patterns))
    return counts.unpivot([], patterns, "pattern", "n_rows").filter("n_rows > 0")


def valid_prefix(log: DataFrame, line: str, ok: Column, stream: str | None = None) -> DataFrame:
    """Rows of an append-only log before its first invalid line (per stream).

    Found by one aggregation, not by a running window: the first bad line bounds each stream.
    """
    by = [stream] if stream else []
    broken = log.withColumn("_ok", F.coalesce(ok, F.lit(False))).filter("not _ok").groupBy(*by).agg(F.min(line).alias("_bad"))
    joined = log.join(broken, by, "left") if by else log.join(F.broadcast(broken))
    return joined.filter(F.col("_bad").isNull() | (F.col(line) < F.col("_bad"))).drop("_bad")


def log_damage(entries: DataFrame, checks: dict[str, Column], log: str = "log") -> DataFrame:
    """log, n_entries, n_kept, line, damage of every log: where its first entry lies that fails a check, and the first check that it fails (both null for a sound log).

    entries: log, line and entry as places.read_lines gives them; a check that is null fails. One aggregation.
    """
    failed = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    found = entries.withColumn("_failed", failed).groupBy(log).agg(F.count("*").alias("n_entries"), F.min(F.when(F.col("_failed").isNotNull(), F.struct("entry", "line", F.col("_failed").alias("damage")))).alias("_b"))
    return found.select(log, "n_entries", F.coalesce("_b.entry", "n_entries").alias("n_kept"), "_b.line", "_b.damage")


def log_prefix(entries: DataFrame, checks: dict[str, Column], log: str = "log") -> DataFrame:
    """The entries before each log's first that fails a check: what a resumed run goes on from."""
    kept = log_damage(entries, checks, log).select(F.col(log).alias("_log"), F.col("n_kept").alias("_kept"))
    return entries.join(kept, F.col(log) == F.col("_log")).filter(F.col("entry") < F.col("_kept")).drop("_log", "_kept")


def aligned(got: DataFrame, expected: DataFrame, pos: str, parts: list[str]) -> DataFrame:
    """Whether two ordered frames hold the same rows: n_aligned, n_expected, n_got, verified. Rows are compared by content hash."""
    a = got.select(pos, text.content_hash(*(F.col(p) for p in parts)).alias("_a"))
    b = expected.select(pos, text.content_hash(*(F.col(p) for p in parts)).alias("_b"))
    both = a.join(b, pos, "full_outer")
    return both.agg(F.count_if(F.col("_a") == F.col("_b")).alias("n_aligned"), F.count("_b").alias("n_expected"), F.count("_a").alias("n_got"), F.coalesce(F.every(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))), F.lit(False)).alias("verified"))


def vocabulary_problems(rows: DataFrame, key: str, known: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """problem, value of a completed sheet: repeated or unknown ids, and answers outside the vocabulary (blank is allowed)."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(F.lit("duplicate_id").alias("problem"), F.col(key).cast("string").alias("value"))
    unknown = rows.join(known, key, "left_anti").select(F.lit("unknown_id").alias("problem"), F.col(key).cast("string").alias("value")).distinct()
    said = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("f"), text.strip(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("v"), F.array(*(F.lit(v) for v in allowed)).alias("allowed")) for f, allowed in fields.items()))).alias("s")).select("s.*")
    bad = said.filter((F.col("v") != "") & (F.lower("v") != "nan") & ~F.array_contains("allowed", F.col("v"))).select(F.col("f").alias("problem"), F.col("v").alias("value")).distinct()
    return repeated.unionByName(unknown).unionByName(bad)


def sheet_report(rows: DataFrame, key: str, known: DataFrame, fields: dict[str, list[str]], answer: str) -> DataFrame:
    """One row on a completed sheet: rows, rows that carry an answer, repeated and unknown ids, answers outside each field's vocabulary, and whether all is well (some answer, no problem). The sheet is read once."""
    said = lambda f: F.lower(text.strip(F.coalesce(F.col(f).cast("string"), F.lit(""))))
    bad = {f: F.count_if((said(f) != "") & (said(f) != "nan") & ~text.strip(F.col(f).cast("string")).isin(*allowed)) for f, allowed in fields.items()}
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(said(answer) != "").alias("_answered"), *(c.alias(f"_bad_{f}") for f, c in bad.items()))
    seen = per.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = seen.agg(
        total("_n").alias("n_rows"), total("_answered").alias("n_answered"), F.count_if(F.col("_n") > 1).alias("n_duplicate_ids"), F.count_if(F.col("_known").isNull()).alias("n_unknown_ids"), *(total(f"_bad_{f}").alias(f"n_bad_{f}") for f in fields)
    )
    wrong = F.col("n_duplicate_ids") + F.col("n_unknown_ids") + sum((F.col(f"n_bad_{f}") for f in fields), F.lit(0))
    return out.withColumn("ok", (wrong == 0) & (F.col("n_answered") > 0))


def places(df: DataFrame, group: list[str], level: Column, item: str, name: str = "place", ranges: int = 64) -> DataFrame:
    """df with each row's place in its group, from 0: by level (of which a group has few), then by item (a number).

    Items are cut into ranges at approximate quantiles; a row's place is its rank inside its level and range, after the sizes of those before. No task sorts a whole group.
    """
    cuts = df.agg(F.array_distinct(F.percentile_approx(item, [i / ranges for i in range(1, ranges)], 1000)).alias("_cuts"))  # one row
    cut = df.withColumn("_level", level).join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(item)))).drop("_cuts")
    sizes = cut.groupBy(*group, "_level", "_range").agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(*group).orderBy("_level", "_range").rowsBetween(Window.unboundedPreceding, -1)  # levels times ranges
    keys = [*group, "_level", "_range"]
    before = sizes.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    inside = Window.partitionBy(*keys).orderBy(item)
    return cut.join(before, same).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).select(*df.columns, name)


def paged(df: DataFrame, group: str, level: Column, item: str, per_page: int) -> DataFrame:
    """page and cell of each row in its group, from 1: rows by level, then item."""
    n = F.col("_place")
    return places(df, [group], level, item, "_place").withColumn("page", (F.floor(n / per_page) + 1).cast("int")).withColumn("cell", (n % per_page + 1).cast("int")).drop("_place")
