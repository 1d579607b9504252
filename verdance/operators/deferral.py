"""Deferring by score: risk-coverage curves, their area, coverage at a risk, conformal thresholds.

Two curves: `exact` keeps a row if its score is at most the level's; `compat` reproduces a published curve whose
thresholds are rounded to 6 places before rows are kept up to 1e-9 above them, so that a level rounded down loses its own rows
(and a curve may end before full coverage). Everything runs on counted levels; running totals are ranking.running's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import dbl, oracle_aurc, ratio
from .ranking import before, levels, running


def curve(df: DataFrame, score: str, correct: str, by: list[str] = [], compat: bool = False, few: bool = False) -> DataFrame:  # noqa: B006
    """by, threshold, n_kept, n_errors_kept, n_items, n_errors, coverage, risk_kept of every level that keeps something."""
    hist = levels(df.withColumn("_s", F.round(F.col(score), 12)), "_s", correct, by)
    run = running(hist, ["bad", "good"], by, few=few)
    if compat:
        # rows up to the threshold: those of the last level at or below it, which is this level or the one before it
        run = before(run, ["cum_bad", "cum_good"], "score", by, few).withColumn("threshold", F.bround("score", 6))
        kept = lambda c: F.when(F.col("score") <= F.col("threshold") + 1e-9, F.col(c)).otherwise(F.col(f"prev_{c}"))
        run = run.withColumns({"kb": kept("cum_bad"), "kg": kept("cum_good")})
        run = run.groupBy(*by, "threshold").agg(F.max("kb").alias("kb"), F.max("kg").alias("kg"))
    else:
        run = run.select(*by, F.col("score").alias("threshold"), F.col("cum_bad").alias("kb"), F.col("cum_good").alias("kg"))
    total = hist.groupBy(*by).agg(F.sum("bad").alias("n_errors"), (F.sum("bad") + F.sum("good")).alias("n_items"))
    run = run.join(F.broadcast(total), by) if by else run.join(F.broadcast(total))
    n = F.col("kb") + F.col("kg")
    return run.filter(n > 0).select(*by, "threshold", n.alias("n_kept"), F.col("kb").alias("n_errors_kept"), "n_items", "n_errors", ratio(n, F.col("n_items")).alias("coverage"), ratio(F.col("kb"), n).alias("risk_kept"))


def aurc(points: DataFrame, by: list[str] = [], few: bool = False) -> DataFrame:  # noqa: B006
    """Area by right steps over the curve's points, its baseline, and both perfect rankers. few: as for the curve."""
    points = before(points, ["coverage"], "threshold", by, few)
    step = F.col("coverage") - F.col("prev_coverage")
    perfect = ratio(F.greatest(F.lit(0), F.col("n_kept") - (F.col("n_items") - F.col("n_errors"))), F.col("n_kept"))
    stepped = points.withColumns({"_w": step * F.col("risk_kept"), "_p": step * perfect})
    out = stepped.groupBy(*by).agg(F.max("n_items").alias("n_items"), F.max("n_errors").alias("n_errors"), F.count("*").alias("n_operating_points"), F.sum("_w").alias("aurc"), F.sum("_p").alias("oracle_aurc_on_grid"))
    base = ratio(F.col("n_errors"), F.col("n_items"))
    out = out.withColumn("baseline_aurc", base).withColumn("oracle_aurc", oracle_aurc(F.col("baseline_aurc")))
    return out.select(
        *by, "n_items", "n_operating_points", "aurc", "baseline_aurc", (F.col("baseline_aurc") - F.col("aurc")).alias("improvement"), "oracle_aurc", (F.col("aurc") - F.col("oracle_aurc")).alias("e_aurc"),
        "oracle_aurc_on_grid", (F.col("aurc") - F.col("oracle_aurc_on_grid")).alias("e_aurc_on_grid"),
    )


def coverage_at_risk(points: DataFrame, targets: list[float]) -> DataFrame:
    """Per target the point of most coverage within it, over all points (risk isn't monotone); achievable is false where none is."""
    if any(not 0 <= t <= 1 for t in targets):
        raise ValueError("risks lie in [0, 1]")
    want = points.sparkSession.createDataFrame([(float(t),) for t in targets], "target_risk double")
    ok = points.join(F.broadcast(want), F.col("risk_kept") <= F.col("target_risk") + 1e-12)
    best = ok.groupBy("target_risk").agg(F.max_by(F.struct("coverage", "n_kept", "threshold", "risk_kept"), "coverage").alias("b"))
    return F.broadcast(want).join(best, "target_risk", "left").select("target_risk", F.col("b").isNotNull().alias("achievable"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("b.n_kept", F.lit(0)).alias("n_kept"), "b.threshold", "b.risk_kept")


MOST_LEVELS = 10_000
MOST_SPLITS = 100  # halvings that are ranked row by row


def bound(risk: Column, n: Column, delta: float = 0.1, conservative: bool = True) -> Column:
    return risk + F.sqrt(F.log(F.lit(1.0 / delta)) / (2.0 * dbl(n))) if conservative else risk


def conformal(points: DataFrame, targets: list[float], by: list[str] = [], delta: float = 0.1, conservative: bool = True) -> DataFrame:  # noqa: B006
    """Per target the last threshold whose bounded risk is within it."""
    want = points.sparkSession.createDataFrame([(float(t),) for t in targets], "target_risk double")
    ok = points.join(F.broadcast(want), bound(F.col("risk_kept"), F.col("n_kept"), delta, conservative) <= F.col("target_risk"))
    best = ok.groupBy(*by, "target_risk").agg(F.max_by(F.struct("threshold", "coverage", "risk_kept"), "threshold").alias("b"))
    groups = points.select(*by).distinct().join(F.broadcast(want)) if by else want
    return groups.join(best, [*by, "target_risk"], "left").select(*by, "target_risk", F.col("b").isNotNull().alias("achievable"), "b.threshold", F.coalesce("b.coverage", F.lit(0.0)).alias("cal_coverage"), F.col("b.risk_kept").alias("cal_risk"))


def conformal_splits(df: DataFrame, key: str, score: str, correct: str, targets: list[float], splits: int, order: Column, calibration: float = 0.5, conservative: bool = True) -> DataFrame:
    """Over `splits` halvings by the hash order (a column of rep and key): how often a threshold calibrated on one half holds on the other. For scores with few values."""
    if splits > MOST_SPLITS:
        raise ValueError(f"{splits} splits of every item: use conformal_draws beyond {MOST_SPLITS}")
    reps = df.sparkSession.range(splits).withColumnRenamed("id", "rep")
    rows = df.filter(F.col(score).isNotNull() & F.col(correct).isNotNull()).select(key, F.round(score, 12).alias("s"), F.col(correct).alias("c"))
    ranked = rows.join(F.broadcast(reps)).withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy(order, key)))
    halves = ranked.withColumn("cal", F.col("rn") <= F.bround(F.count("*").over(Window.partitionBy("rep")) * F.lit(calibration)))
    fitted = conformal(curve(halves.filter("cal"), "s", "c", ["rep"], few=True), targets, ["rep"], conservative=conservative)
    test = halves.filter("not cal").groupBy("rep", "s").agg(F.count("*").alias("n"), F.count_if(~F.col("c")).alias("bad"))
    # groups and targets that can't be met stay as rows, and count
    met = fitted.alias("f").join(test.alias("t"), "rep").groupBy("rep", "target_risk", "achievable").agg(
        F.sum(F.when(F.col("s") <= F.col("threshold") + 1e-9, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("s") <= F.col("threshold") + 1e-9, F.col("bad")).otherwise(0)).alias("bad"), F.sum("n").alias("n")
    )
    valid = F.col("achievable") & (F.col("kept") > 0)
    risk = F.when(valid, ratio(F.col("bad"), F.col("kept")))
    return met.groupBy("target_risk").agg(
        F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_unachievable"), F.avg(F.when(valid, ratio(F.col("kept"), F.col("n")))).alias("mean_coverage"), F.avg(risk).alias("mean_test_risk"),
        F.avg(F.when(valid, (risk > F.col("target_risk")).cast("int"))).alias("violation_rate"),
    )


def conformal_draws(df: DataFrame, score: str, correct: str, targets: list[float], splits: int, seed: int = 0, calibration: float = 0.5, delta: float = 0.1, conservative: bool = True, chunk: int = 250) -> DataFrame:
    """`conformal_splits` by draws over counted levels: the half of a split is a multivariate hypergeometric draw from the counts of (level, verdict), which is what a random half of the items is. The cost doesn't grow with the items.

    For scores with few values (entropies of K votes): more than MOST_LEVELS is an error.
    """
    import numpy as np
    import pandas as pd

    rows = df.filter(F.col(score).isNotNull() & F.col(correct).isNotNull())
    counts = rows.groupBy(F.round(score, 12).alias("s")).agg(F.count_if(~F.col(correct)).alias("bad"), F.count_if(F.col(correct)).alias("good"))
    few = F.when(F.count("*") <= MOST_LEVELS, True).otherwise(F.raise_error(F.lit("a score with this many values has no few levels")).cast("boolean"))
    packed = counts.agg(few.alias("_few"), F.sort_array(F.collect_list(F.struct("s", "bad", "good"))).alias("rows")).filter("_few").select("rows")

    def run(batches):
        for b in batches:
            for first, found in zip(b["first"], b["rows"], strict=True):
                bad, good = (np.array([r[c] for r in found], np.int64) for c in ("bad", "good"))
                cells, m = np.concatenate([bad, good]), min(chunk, splits - first)
                total, levels = int(cells.sum()), len(bad)
                # half to even, as the other form rounds
                drawn = np.random.default_rng([seed, first]).multivariate_hypergeometric(cells, round(total * calibration), size=m, method="marginals")
                upto = lambda x: np.cumsum(x, axis=1)
                kept, errors = upto(drawn[:, :levels] + drawn[:, levels:]), upto(drawn[:, :levels])
                rest = cells - drawn
                left, wrong = upto(rest[:, :levels] + rest[:, levels:]), upto(rest[:, :levels])
                present = drawn[:, :levels] + drawn[:, levels:] > 0  # only a level that occurs in the half can be a threshold
                risk = np.where(kept > 0, errors / np.maximum(kept, 1), np.inf)
                bounded = risk + np.sqrt(np.log(1 / delta) / (2 * np.maximum(kept, 1))) if conservative else risk
                for t in targets:
                    ok = present & (bounded <= t)
                    last = np.where(ok.any(axis=1), levels - 1 - np.argmax(ok[:, ::-1], axis=1), -1)
                    n, w = (np.where(last >= 0, x[np.arange(m), np.maximum(last, 0)], 0) for x in (left, wrong))
                    yield pd.DataFrame({"target_risk": t, "kept": n, "bad": w, "n": rest.sum(axis=1)})

    spark = df.sparkSession
    starts = spark.range(0, splits, chunk).withColumnRenamed("id", "first")
    met = starts.join(F.broadcast(packed)).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "target_risk double, kept long, bad long, n long")  # one row of at most MOST_LEVELS levels
    valid = F.col("kept") > 0
    risk = F.when(valid, ratio(F.col("bad"), F.col("kept")))
    return met.groupBy("target_risk").agg(
        F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_unachievable"), F.avg(F.when(valid, ratio(F.col("kept"), F.col("n")))).alias("mean_coverage"), F.avg(risk).alias("mean_test_risk"),
        F.avg(F.when(valid, (risk > F.col("target_risk")).cast("int"))).alias("violation_rate"),
    )
