"""Null models of voting: exact AUROC of vote entropy inside a stratum, its grid, simulations, seeds."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import binomial_pmf, dbl, hash_number, vote_entropy

# Fixed value: a cell's truth condition says which majority is right; pooled_balanced has half of each truth.
CONDITIONS = ("y=1", "y=0", "pooled_balanced")


def cells(spark: SparkSession, conditions: list[str], p_values: list[float], k_values: list[int]) -> DataFrame:
    if any(k % 2 == 0 for k in k_values):
        raise ValueError("a majority needs an odd number of votes")
    return spark.createDataFrame(list(itertools.product(conditions, p_values, k_values)), "truth_condition string, p double, k int").coalesce(1)  # parameters, not data


def vote_table(grid: DataFrame) -> DataFrame:
    """Each cell's rows for 0 to k votes: probability, entropy, whether the majority is right."""
    rows = grid.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("k"))))
    majority = 2 * F.col("s") > F.col("k")
    right = F.when(F.col("truth_condition") == "y=1", majority).when(F.col("truth_condition") == "y=0", ~majority)
    return rows.withColumns({"pmf": binomial_pmf(F.col("s"), F.col("k"), F.col("p")), "entropy": F.round(vote_entropy(F.col("s"), F.col("k")), 12), "right": right})


def exact_auroc(grid: DataFrame) -> DataFrame:
    """auroc_exact of every cell (conditions y=1 and y=0): entropy ranks wrong majorities over right ones, ties half; null if a class has no mass."""
    t = vote_table(grid)
    keys = ["truth_condition", "p", "k"]
    wrong = t.filter(~F.col("right")).select(*keys, F.col("pmf").alias("pw"), F.col("entropy").alias("ew"))
    right = t.filter("right").select(*keys, F.col("pmf").alias("pr"), F.col("entropy").alias("er"))
    beats = F.when(F.col("ew") > F.col("er"), 1.0).when(F.col("ew") == F.col("er"), 0.5).otherwise(0.0)
    both = wrong.join(right, keys).groupBy(*keys).agg(F.sum(F.col("pw") * F.col("pr") * beats).alias("num"))
    mass = t.groupBy(*keys).agg(F.sum(F.when(~F.col("right"), F.col("pmf")).otherwise(0.0)).alias("mw"), F.sum(F.when(F.col("right"), F.col("pmf")).otherwise(0.0)).alias("mr"))
    return mass.join(both, keys, "left").select(*keys, F.try_divide("num", F.col("mw") * F.col("mr")).alias("auroc_exact"))


def cell_seed(base: int, condition, p, k):
    return hash_number(F.concat_ws("|", F.lit(str(base)), condition, F.format_string("%.4f", p), k.cast("string")))


def drawn_aurocs(p: float, k: int, condition: str, n_items: int, n_sims: int, seed: int):
    """(auroc or NaN, size of the smaller class) of every simulation: only the counts of items by votes matter, so those are drawn (multinomial), not the items."""
    import numpy as np

    votes = np.arange(k + 1)
    pmf = np.array([math.comb(k, int(s)) for s in votes], float) * p**votes * (1 - p) ** (k - votes)
    rng = np.random.default_rng(seed)
    ones = {"y=1": n_items, "y=0": 0, "pooled_balanced": n_items // 2}[condition]
    said = {truth: rng.multinomial(n, pmf / pmf.sum(), size=n_sims) for truth, n in ((1, ones), (0, n_items - ones))}
    up = votes > k / 2
    right, wrong = said[1] * up + said[0] * ~up, said[1] * ~up + said[0] * up
    # entropy rises with the smaller side's votes, and mirrored counts tie
    level = np.minimum(votes, k - votes)
    fold = lambda x: np.stack([x[:, level == m].sum(axis=1) for m in range(k // 2 + 1)], axis=1).astype(float)
    good, bad = fold(right), fold(wrong)
    n_good, n_bad = good.sum(axis=1), bad.sum(axis=1)
    won = (bad * (np.cumsum(good, axis=1) - good / 2)).sum(axis=1)
    return np.where(n_good * n_bad > 0, won / np.maximum(n_good * n_bad, 1), np.nan), np.minimum(n_good, n_bad)


def simulate(grid: DataFrame, n_items: int, n_sims: int, base_seed: int) -> DataFrame:
    """Per cell: valid and invalid simulations (a class is empty), median and 95 % range of the AUROC over the valid ones, median size of the smaller class, and its share. Cells are independent: one task each."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            for c, p, k, seed in zip(b["truth_condition"], b["p"], b["k"], b["seed"], strict=True):
                found, minority = drawn_aurocs(p, int(k), c, n_items, n_sims, int(seed))
                ok = found[~np.isnan(found)]
                q = np.percentile(ok, [50, 2.5, 97.5]).tolist() if len(ok) else [None] * 3
                yield pd.DataFrame([(c, p, k, len(ok), n_sims - len(ok), *q, float(np.median(minority)), float(np.median(minority)) / n_items)], columns=names)

    schema = "truth_condition string, p double, k int, n_valid long, n_invalid long, auroc_median double, auroc_low double, auroc_high double, minority_median double, minority_rate_median double"
    names = [x.split()[0] for x in schema.split(", ")]
    seeded = grid.withColumn("seed", cell_seed(base_seed, F.col("truth_condition"), F.col("p"), F.col("k")))
    return seeded.repartition(2 * grid.sparkSession.sparkContext.defaultParallelism, "truth_condition", "p", "k").mapInPandas(run, schema)


def null_grid(spark: SparkSession, conditions, p_values, k_values, n_items: int = 650, n_sims: int = 2000, base_seed: int = 20260814) -> DataFrame:
    """Every cell's simulation with the closed form beside it, where there is one (a single truth, and both classes have mass)."""
    grid = cells(spark, list(conditions), list(p_values), list(k_values))
    exact = exact_auroc(grid.filter("truth_condition <> 'pooled_balanced'"))
    out = simulate(grid, n_items, n_sims, base_seed).join(F.broadcast(exact), ["truth_condition", "p", "k"], "left")  # a row a cell
    return out.withColumn("exact_available", F.col("auroc_exact").isNotNull())


def bias_only(spark: SparkSession, n_items: int, says_error_rate: float, k: int = 5, n_sims: int = 2000, seed: int = 0) -> DataFrame:
    """The AUROC that a responder without any signal reaches on items that all have an error: median and 95 % range over valid simulations."""
    grid = spark.createDataFrame([("y=1", float(says_error_rate), k, seed)], "truth_condition string, p double, k int, seed long")
    return simulate(grid.drop("seed"), n_items, n_sims, seed).select(F.col("auroc_median").alias("median"), F.col("auroc_low").alias("ci_low"), F.col("auroc_high").alias("ci_high"), "n_valid")


def collapse(run: DataFrame, votes: str, truth: str, correct: str, k: int) -> DataFrame:
    """Per truth: items, and those whose stored correctness is not what it must be there: the verdict itself (truth 1) or its opposite (truth 0); and the number of entropy levels."""
    said = 2 * F.col(votes) > k
    due = F.when(F.col(truth) == 1, said).otherwise(~said)
    entropy = F.round(vote_entropy(F.col(votes), F.lit(k)), 12)
    return run.groupBy(F.col(truth).alias("truth")).agg(F.count("*").alias("n_items"), F.count_if(F.col(correct) != due).alias("n_broken"), F.count_distinct(entropy).alias("n_entropy_levels"))


def nested_seed(base: int, temperature, item):
    return hash_number(F.concat_ws("|", F.lit(str(base)), F.format_string("%.6f", dbl(temperature)), item.cast("string")))
