"""Ranking metrics: AUROC by histograms, average ranks, cuts, strata, weighted AUROC, bootstrap, Spearman.

Scores are first counted (score, right or wrong), which shrinks repeated-sample entropies to a few levels and keeps
any other score to one row a value. Running totals are then taken in two steps, inside ranges of scores cut at
approximate quantiles and over the ranges' totals, so that no task ever sorts all values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import dbl, hash_number, ratio

RANGES = 64
PLACE_RANGES = 1024  # a power of two
MOST_LEVELS = 100_000
MOST_HASHED = 200  # replicates that are drawn row by row


def levels(df: DataFrame, score: str, correct: str, by: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """by, score, bad and good (counts, or sums of weights); rows without a score or verdict are left out."""
    w = dbl(F.col(weight)) if weight else F.lit(1)
    rows = df.filter(F.col(score).isNotNull() & F.col(correct).isNotNull())
    return rows.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(~F.col(correct), w).otherwise(0)).alias("bad"), F.sum(F.when(F.col(correct), w).otherwise(0)).alias("good"))


def running(hist: DataFrame, columns: list[str], by: list[str] = [], order: str = "score", few: bool = False) -> DataFrame:  # noqa: B006
    """hist with cum_<c>: totals over all rows of the group up to and including this one's order value (unique in the group).

    few: a group has a bounded number of values (entropies of K votes have as many as K has partitions), which one window takes.
    """
    if few:
        upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return hist.select(*hist.columns, *(F.sum(c).over(upto).alias(f"cum_{c}") for c in columns))
    cuts = hist.agg(F.array_distinct(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 1000)).alias("_cuts"))  # one row
    ranged = hist.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(order)))).drop("_cuts")
    totals = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows a group
    offsets = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, same)
    return out.select(*hist.columns, *((F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in columns))


def before(df: DataFrame, columns: list[str], order: str, by: list[str] = [], few: bool = False) -> DataFrame:  # noqa: B006
    """df with prev_<c>: the value of columns that never fall along the order, in the group's row before (0 in its first); in ranges of the order, and few, as in `running`."""
    if few:
        along = Window.partitionBy(*by).orderBy(order)
        return df.select(*df.columns, *(F.coalesce(F.lag(c).over(along), F.lit(0)).alias(f"prev_{c}") for c in columns))
    cuts = df.agg(F.array_distinct(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 1000)).alias("_cuts"))  # one row
    ranged = df.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(order)))).drop("_cuts")
    highest = ranged.groupBy(*by, "_range").agg(*(F.max(c).alias(f"_m_{c}") for c in columns))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    offsets = highest.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), *(F.max(f"_m_{c}").over(earlier).alias(f"_o_{c}") for c in columns))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    return ranged.join(offsets, same).select(*df.columns, *(F.coalesce(F.lag(c).over(inside), F.col(f"_o_{c}"), F.lit(0)).alias(f"prev_{c}") for c in columns))


def auroc(df: DataFrame, score: str, correct: str, by: list[str] = [], weight: str | None = None, few: bool = False) -> DataFrame:  # noqa: B006
    """Per group: n_items, n_error, n_correct, auroc (that a wrong item scores higher, ties half); null if a class is empty."""
    run = running(levels(df, score, correct, by, weight), ["good"], by, few=few)
    won = F.sum(dbl(F.col("bad")) * (dbl(F.col("cum_good")) - dbl(F.col("good")) / 2.0))
    out = run.groupBy(*by).agg(F.sum("bad").alias("n_error"), F.sum("good").alias("n_correct"), won.alias("_won"))
    return out.select(*by, (F.col("n_error") + F.col("n_correct")).alias("n_items"), "n_error", "n_correct", F.try_divide("_won", dbl(F.col("n_error")) * dbl(F.col("n_correct"))).alias("auroc"))


def quantiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, and each point's quantile of the group's values (nulls left out), between two neighbours by distance as `F.percentile` does; null for a group without values.

    Rows are counted in ranges cut at approximate quantiles of all groups together. A place that is asked for lies in one
    range of its group; only values of such ranges are told apart, counted and put in order, each range by itself. So no
    task holds a group's values, and what is dealt is a small part of the rows while groups are few or alike.
    """
    rows = df.select(*by, dbl(F.col(value)).alias("_v"))
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", [i / PLACE_RANGES for i in range(1, PLACE_RANGES)], 10 * PLACE_RANGES)))).collect()  # one row; both walks need the same cuts, and sketches differ between runs
    ranged = rows.join(F.broadcast(df.sparkSession.createDataFrame(cuts, "_cuts array<double>"))).withColumn("_range", F.lit(0))
    step = PLACE_RANGES // 2
    while step:  # the number of cuts up to the value, by halves; beyond the last cut F.get is null
        ranged = ranged.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (step - 1)) <= F.col("_v"), step).otherwise(0))
        step //= 2
    ranged = ranged.select(*by, "_v", F.when(F.col("_v").isNull(), -1).otherwise(F.col("_range")).alias("_range"))
    group = Window.partitionBy(*by)  # at most PLACE_RANGES + 1 rows
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "_range").agg(F.count("_v").alias("_n"))
    placed = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "_last": F.sum("_n").over(group) - 1})
    place = {n: F.col("_last") * F.lit(float(q)) for n, q in points.items()}
    ends = {(n, side): f(p).cast("long") for n, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    held = reduce(lambda a, b: a | b, ((e >= F.col("_before")) & (e < F.col("_before") + F.col("_n")) for e in ends.values()))
    placed = placed.filter(held | (F.col("_range") < 0))  # a group of nulls has its row
    asked = placed.agg(F.collect_set("_range").alias("_asked"))  # one row, a number a range
    counts = ranged.join(F.broadcast(asked)).filter(F.array_contains("_asked", F.col("_range"))).groupBy(*by, "_range", "_v").agg(F.count("_v").alias("_c"))
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    offsets = placed.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), "_before", "_last")
    told = counts.withColumn("_upto", F.sum("_c").over(inside)).join(offsets, same)
    at = {k: F.min(F.when(F.col("_before") + F.col("_upto") > e, F.col("_v"))) for k, e in ends.items()}
    out = told.groupBy(*by).agg(F.max("_last").alias("_last"), *(v.alias(f"_{side}_{n}") for (n, side), v in at.items()))
    low, high = ({n: F.col(f"_{side}_{n}") for n in points} for side in ("low", "high"))
    return out.select(*by, *(F.when(low[n] == high[n], low[n]).otherwise((F.ceil(p) - p) * low[n] + (p - F.floor(p)) * high[n]).alias(n) for n, p in place.items()))


def average_ranks(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with avg_rank: ties share the mean of their places."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("score")).agg(F.count("*").alias("n"))
    ranks = running(hist, ["n"], by).select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("score").alias("_s"), (dbl(F.col("cum_n")) - dbl(F.col("n")) / 2.0 + 0.5).alias("avg_rank"))
    same = F.col(value) == F.col("_s")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return df.join(ranks, same).drop("_s", *(f"_b_{c}" for c in by))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(both, a).withColumnRenamed("avg_rank", "_ra"), b).withColumnRenamed("avg_rank", "_rb")
    return ranked.agg(F.count("*").alias("n_items"), F.corr("_ra", "_rb").alias("spearman"))


CUTS = ("full", "excl_parse_failures", "excl_max_entropy", "excl_both")


def with_cuts(df: DataFrame, score: str, failures: str, max_score: float) -> DataFrame:
    """Each row once for every cut that it belongs to."""
    clean = F.coalesce(F.col(failures), F.lit(0)) == 0
    below = ~(F.abs(F.col(score) - max_score) <= 1e-8 + 1e-5 * abs(max_score))
    member = F.array_compact(F.array(F.lit(CUTS[0]), F.when(clean, CUTS[1]), F.when(below, CUTS[2]), F.when(clean & below, CUTS[3])))
    return df.withColumn("cut", F.explode(member))


def with_strata(df: DataFrame, score: str, correct: str, stratum: str) -> DataFrame:
    """score, correct, pooled, stratum: each row once in the pool (null stratum, pooled true), and once in its stratum, if it has one."""
    member = F.array_compact(F.array(F.struct(F.lit(True).alias("pooled"), F.lit(None).cast("string").alias("stratum")), F.when(F.col(stratum).isNotNull(), F.struct(F.lit(False).alias("pooled"), F.col(stratum).cast("string").alias("stratum")))))
    return df.withColumn("_m", F.explode(member)).select(score, correct, F.col("_m.pooled").alias("pooled"), F.col("_m.stratum").alias("stratum"))


def strata(df: DataFrame, score: str, correct: str, stratum: str) -> DataFrame:
    """The pooled row (null stratum, pooled true) and one per stratum; rows without a stratum count in the pool only."""
    return auroc(with_strata(df, score, correct, stratum), score, correct, ["pooled", "stratum"])


def strata_flags(rows: DataFrame, margin: float = 0.05) -> DataFrame:
    """Whether strata lie on both sides of chance, and whether pooling hides a better stratum."""
    inner = lambda f: f(F.when(~F.col("pooled"), F.col("auroc")))
    pooled = F.max(F.when(F.col("pooled"), F.col("auroc")))
    n = F.count_if(~F.col("pooled") & F.col("auroc").isNotNull())
    hi, lo = inner(F.max), inner(F.min)
    return rows.agg(n.alias("n_strata"), F.coalesce((n > 1) & (hi > 0.5) & (lo < 0.5), F.lit(False)).alias("sign_reversal"), F.coalesce(pooled < hi - margin, F.lit(False)).alias("pooled_understates"))


# ---- resampling ----


def replicates(items: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """(rep, idx) and the row drawn: n draws with replacement a replicate, from sha256 of seed, replicate and draw.

    items has a dense idx from 0. Draws are generated, not collected, and joined to the items by idx.
    """
    if reps > MOST_HASHED:
        raise ValueError(f"{reps} replicates of every item: use bootstrap_levels, bootstrap_cells or bootstrap_ranges beyond {MOST_HASHED}")
    n = items.agg(F.count("*").alias("_n"))
    spark = items.sparkSession
    draws = items.select(F.col("idx").alias("draw")).join(F.broadcast(n)).join(F.broadcast(spark.range(reps).withColumnRenamed("id", "rep")))
    chosen = draws.select("rep", (hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("rep"), F.col("draw"))) % F.col("_n")).alias("idx"))
    return chosen.join(items, "idx")


def indexed(df: DataFrame, key: str) -> DataFrame:
    """df with idx, its rows' places in order of the key, from 0."""
    hist = df.groupBy(F.col(key).alias("score")).agg(F.count("*").alias("n"))
    place = running(hist, ["n"]).select(F.col("score").alias("_k"), (F.col("cum_n") - F.col("n")).alias("_before"))
    ties = Window.partitionBy(key).orderBy(*(c for c in df.columns if c != key))
    return df.join(place, F.col(key) == F.col("_k")).withColumn("idx", F.col("_before") + F.row_number().over(ties) - 1).drop("_k", "_before")


def interval(per_rep: DataFrame, value: str, by: list[str] = [], alpha: float = 0.05) -> DataFrame:  # noqa: B006
    """Percentile interval over replicates; undefined ones are skipped. excludes_chance is one-sided."""
    low, high = (F.percentile(value, F.lit(q)) for q in (alpha / 2, 1 - alpha / 2))
    out = per_rep.groupBy(*by).agg(F.count(value).alias("n_boot_valid"), low.alias("ci_low"), high.alias("ci_high"))
    return out.withColumn("excludes_chance", F.coalesce(F.col("ci_low") > 0.5, F.lit(False)))


def bootstrap(df: DataFrame, key: str, score: str, correct: str, reps: int, seed: int = 0) -> DataFrame:
    """One row: point estimate and percentile interval of the AUROC, by hashed draws."""
    rows = df.filter(F.col(score).isNotNull() & F.col(correct).isNotNull()).select(key, score, correct)
    per = auroc(replicates(indexed(rows, key), reps, seed), score, correct, ["rep"])
    return auroc(rows, score, correct).join(F.broadcast(interval(per, "auroc")))


def bootstrap_difference(df: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], reps: int, seed: int = 0) -> DataFrame:
    """Paired: the same resample for both (score, correct) pairs. Rows that lack one score are an error."""
    uneven = df.filter(F.col(a[0]).isNull() != F.col(b[0]).isNull())
    checked = df.filter(F.col(a[0]).isNotNull() & F.col(b[0]).isNotNull()).select(key, *{*a, *b})
    drawn = replicates(indexed(checked, key), reps, seed)
    one, two = (auroc(drawn, *x, ["rep"]).select("rep", F.col("auroc").alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    diff = one.join(two, "rep").select((F.col("_a") - F.col("_b")).alias("difference"))
    ci = interval(diff, "difference").drop("excludes_chance")
    point = auroc(checked, *a).select("n_items", F.col("auroc").alias("_a")).join(F.broadcast(auroc(checked, *b).select(F.col("auroc").alias("_b"))))
    guard = uneven.agg(F.when(F.count("*") > 0, F.raise_error(F.lit("a paired comparison needs both scores"))).alias("_g"))
    out = point.join(F.broadcast(ci)).join(F.broadcast(guard))
    return out.select("n_items", (F.col("_a") - F.col("_b")).alias("difference"), "ci_low", "ci_high", "n_boot_valid", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)).alias("difference_excludes_zero"), F.col("_g").alias("guard")).drop("guard")


def _few() -> Column:
    """True, or an error: what is gathered in one row and sent to every task has at most MOST_LEVELS entries."""
    return F.when(F.count("*") <= MOST_LEVELS, True).otherwise(F.raise_error(F.lit("a score with this many values has no few levels")).cast("boolean")).alias("_few")


def bootstrap_levels(hist: DataFrame, reps: int, seed: int = 0, chunk: int = 500) -> DataFrame:
    """(rep, auroc) from multinomial draws over the counted levels: the same estimator, at a cost that doesn't grow with the items.

    The levels (score, bad, good) are gathered once per task, so this is for scores with few values: more than MOST_LEVELS is an error.
    """
    import numpy as np
    import pandas as pd

    packed = hist.agg(_few(), F.sort_array(F.collect_list(F.struct("score", "bad", "good"))).alias("rows")).filter("_few").select("rows")
    spark = hist.sparkSession

    def run(batches):
        for b in batches:
            for rep0, rows in zip(b["first"], b["rows"], strict=True):
                bad = np.array([r["bad"] for r in rows], float)
                good = np.array([r["good"] for r in rows], float)
                n = int(bad.sum() + good.sum())
                m = min(chunk, reps - rep0)
                rng = np.random.default_rng([seed, rep0])
                draw = rng.multinomial(n, np.concatenate([bad, good]) / n, size=m)
                e, c = draw[:, : len(bad)], draw[:, len(bad) :]
                won = (e * (np.cumsum(c, axis=1) - c / 2)).sum(axis=1)
                pairs = e.sum(axis=1) * c.sum(axis=1)
                yield pd.DataFrame({"rep": np.arange(rep0, rep0 + m), "auroc": [w / p if p else None for w, p in zip(won, pairs, strict=True)]})

    starts = spark.range(0, reps, chunk).withColumnRenamed("id", "first")
    return starts.join(F.broadcast(packed)).mapInPandas(run, "rep long, auroc double")


def bootstrap_cells(df: DataFrame, score: str, correct: str, reps: int, by: list[str] = [], weight: str | None = None, within: str | None = None, count: str | None = None, seed: int = 0, chunk: int = 500) -> DataFrame:  # noqa: B006
    """(by, rep, auroc), null if a replicate lacks a class: multinomial draws over a group's counted cells, by itself.

    Items that share score, verdict, weight and `within` are one cell, so the estimator is that of drawing items, and the cost
    grows with the cells, not the items. within: its levels are drawn apart, each as often as it has items. count: how many
    items a row of df stands for (else one). A task holds one group's cells, so more than MOST_LEVELS of them are an error
    (`bootstrap_ranges` has no such bound); draws are made a few million numbers at a time.
    """
    import numpy as np
    import pandas as pd

    rows = df.filter(F.col(score).isNotNull() & F.col(correct).isNotNull())
    cell = (dbl(F.col(score)).alias("score"), (F.col(within).cast("string") if within else F.lit("")).alias("side"), (dbl(F.col(weight)) if weight else F.lit(1.0)).alias("weight"), F.col(correct).alias("ok"))
    cells = rows.groupBy(*by, *cell).agg((F.sum(count) if count else F.count("*")).alias("n"))
    packed = cells.groupBy(*by).agg(_few(), F.sort_array(F.collect_list(F.struct("score", "side", "weight", "ok", "n"))).alias("rows")).filter("_few").drop("_few")
    spark = df.sparkSession

    def drawn(rng, sides, n, m):
        draw = np.empty((m, len(n)))
        for x in sides:
            draw[:, x] = rng.multinomial(int(n[x].sum()), n[x] / n[x].sum(), size=m)
        return draw

    def run(batches):
        for b in batches:
            for at in range(len(b)):
                first, found = int(b["first"].iloc[at]), b["rows"].iloc[at]
                rng = np.random.default_rng([seed, first])
                reps_here = min(chunk, reps - first)
                n, w = np.array([r["n"] for r in found], float), np.array([r["weight"] for r in found], float)
                ok, side = np.array([r["ok"] for r in found], bool), np.array([r["side"] or "" for r in found], object)
                value = np.array([r["score"] for r in found], float)
                sides = [np.flatnonzero(side == x) for x in sorted(set(side))]
                level = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(n) else []
                out = []
                step = max(1, 2_000_000 // max(1, len(n)))
                for k in range(0, reps_here if len(n) else 0, step):
                    draw = drawn(rng, sides, n, min(step, reps_here - k)) * w
                    e, c = np.add.reduceat(draw * ~ok, level, axis=1), np.add.reduceat(draw * ok, level, axis=1)
                    won, pairs = (e * (np.cumsum(c, axis=1) - c / 2)).sum(axis=1), e.sum(axis=1) * c.sum(axis=1)
                    out += [x / y if y else None for x, y in zip(won, pairs, strict=True)]
                same = pd.concat([b[by].iloc[[at]]] * len(out), ignore_index=True) if out else b[by].iloc[:0]
                yield same.assign(rep=np.arange(first, first + len(out)), auroc=pd.Series(out, dtype=float))

    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + ["rep long", "auroc double"])
    starts = spark.range(0, reps, chunk).withColumnRenamed("id", "first")
    per = starts.join(F.broadcast(packed)).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, kinds)
    return per.withColumn("auroc", F.when(~F.isnan("auroc"), F.col("auroc")))


def difference_cells(df: DataFrame, a: tuple[str, str], b: tuple[str, str], reps: int, seed: int = 0, chunk: int = 500) -> DataFrame:
    """bootstrap_difference by multinomial draws over the counted cells of both pairs: both AUROCs of a replicate come from the same draw.

    A task holds the cells: more than MOST_LEVELS are an error (`difference_ranges` has no such bound).
    """
    import numpy as np
    import pandas as pd

    uneven = df.filter(F.col(a[0]).isNull() != F.col(b[0]).isNull())
    names = ("sa", "ca", "sb", "cb")
    rows = df.filter(F.col(a[0]).isNotNull() & F.col(b[0]).isNotNull() & F.col(a[1]).isNotNull() & F.col(b[1]).isNotNull())
    rows = rows.select(*((dbl(F.col(c)) if n[0] == "s" else F.col(c)).alias(n) for c, n in zip((*a, *b), names, strict=True)))
    packed = rows.groupBy(*names).agg(F.count("*").alias("n")).agg(_few(), F.sort_array(F.collect_list(F.struct(*names, "n"))).alias("rows")).filter("_few").select("rows")
    spark = df.sparkSession

    def value(draw, score, ok):
        order = np.argsort(score, kind="stable")
        score, ok, draw = score[order], ok[order], draw[:, order]
        level = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        e, c = np.add.reduceat(draw * ~ok, level, axis=1), np.add.reduceat(draw * ok, level, axis=1)
        won, pairs = (e * (np.cumsum(c, axis=1) - c / 2)).sum(axis=1), e.sum(axis=1) * c.sum(axis=1)
        return np.where(pairs > 0, won / np.maximum(pairs, 1), np.nan)

    def run(batches):
        for batch in batches:
            for first, found in zip(batch["first"], batch["rows"], strict=True):
                n = np.array([r["n"] for r in found], float)
                if not len(n):
                    continue
                rng = np.random.default_rng([seed, first])
                x = {k: np.array([r[k] for r in found], float if k[0] == "s" else bool) for k in names}
                m, step = min(chunk, reps - first), max(1, 2_000_000 // len(n))
                for k in range(0, m, step):
                    draw = rng.multinomial(int(n.sum()), n / n.sum(), size=min(step, m - k)).astype(float)
                    d = value(draw, x["sa"], x["ca"]) - value(draw, x["sb"], x["cb"])
                    yield pd.DataFrame({"difference": d})

    starts = spark.range(0, reps, chunk).withColumnRenamed("id", "first")
    per = starts.join(F.broadcast(packed)).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "difference double")
    ci = interval(per.select(F.when(~F.isnan("difference"), F.col("difference")).alias("difference")), "difference").drop("excludes_chance")
    return _difference(rows, uneven, ci)


CELLS_A_RANGE = 20_000


def _resampled(cells: DataFrame, score: str, ok: str, reps: int, by: list[str], seed: int) -> DataFrame:
    """(by, rep, auroc) of cells (by, score, ok, weight, n, key): each counts as often as a Poisson draw of mean n says.

    A replicate's draw for a cell comes from the cell's key alone, so it is the same in every order of the cells, range and
    task. Cells are dealt by ranges of the score; a range's task walks its cells in order, and holds three numbers a
    replicate: wrong items, right items, and pairs won inside. Running totals over ranges make the rest.
    """
    import numpy as np
    import pandas as pd

    n_ranges = max(1, -(-cells.count() // CELLS_A_RANGE))
    cuts = cells.agg(F.array_distinct(F.percentile_approx(score, [i / n_ranges for i in range(1, n_ranges)], 10 * n_ranges)).alias("_cuts")) if n_ranges > 1 else cells.sparkSession.range(1).select(F.array().cast("array<double>").alias("_cuts"))
    placed = cells.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("_cuts", lambda c: c <= F.col(score)))).drop("_cuts")  # one row, a number a range

    def walk(keys, rows):
        wrong, right, won = (np.zeros(reps) for _ in range(3))
        for _, level in rows.sort_values([score, "key"]).groupby(score, sort=False):
            e, c = np.zeros(reps), np.zeros(reps)
            for good, weight, n, key in zip(level[ok], level["weight"], level["n"], level["key"], strict=True):
                drawn = np.random.Generator(np.random.Philox(key=[int(key) & (2**64 - 1), seed])).poisson(n, reps) * weight
                (c if good else e).__iadd__(drawn)
            won += e * (right + c / 2)
            wrong += e
            right += c
        return pd.DataFrame([[*keys, wrong, right, won]], columns=[*by, "range", "e", "c", "w"])

    kinds = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by), "range int, e array<double>, c array<double>, w array<double>"])
    sums = placed.groupBy(*by, "range").applyInPandas(walk, kinds)
    per = sums.select(*by, "range", F.posexplode(F.arrays_zip("e", "c", "w")).alias("rep", "x")).select(*by, "range", "rep", "x.*")
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by, "rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a range
    won = per.withColumn("won", F.col("w") + F.col("e") * before).groupBy(*by, "rep").agg(F.sum("won").alias("won"), (F.sum("e") * F.sum("c")).alias("pairs"))
    return won.select(*by, F.col("rep").cast("long").alias("rep"), F.try_divide("won", "pairs").alias("auroc"))


def bootstrap_ranges(df: DataFrame, score: str, correct: str, reps: int, by: list[str] = [], weight: str | None = None, count: str | None = None, seed: int = 0) -> DataFrame:  # noqa: B006
    """(by, rep, auroc), null if a replicate lacks a class: Poisson resampling, which gathers nothing, for scores with any number of values."""
    rows = df.filter(F.col(score).isNotNull() & F.col(correct).isNotNull())
    cell = (dbl(F.col(score)).alias("score"), F.col(correct).alias("ok"), (dbl(F.col(weight)) if weight else F.lit(1.0)).alias("weight"))
    cells = rows.groupBy(*by, *cell).agg((F.sum(count) if count else F.count("*")).alias("n"))
    return _resampled(cells.withColumn("key", F.xxhash64(*by, "score", "ok", "weight")), "score", "ok", reps, by, seed)


def difference_ranges(df: DataFrame, a: tuple[str, str], b: tuple[str, str], reps: int, seed: int = 0) -> DataFrame:
    """`bootstrap_difference` by Poisson resampling, which gathers nothing: a cell counts alike in both pairs' orders."""
    uneven = df.filter(F.col(a[0]).isNull() != F.col(b[0]).isNull())
    names = ("sa", "ca", "sb", "cb")
    rows = df.filter(F.col(a[0]).isNotNull() & F.col(b[0]).isNotNull() & F.col(a[1]).isNotNull() & F.col(b[1]).isNotNull())
    rows = rows.select(*((dbl(F.col(c)) if n[0] == "s" else F.col(c)).alias(n) for c, n in zip((*a, *b), names, strict=True)))
    cells = rows.groupBy(*names).agg(F.count("*").alias("n")).withColumns({"weight": F.lit(1.0), "key": F.xxhash64(*names)})
    one, two = (_resampled(cells, s, c, reps, [], seed).select("rep", F.col("auroc").alias(n)) for s, c, n in (("sa", "ca", "_a"), ("sb", "cb", "_b")))
    ci = interval(one.join(two, "rep").select((F.col("_a") - F.col("_b")).alias("difference")), "difference").drop("excludes_chance")
    return _difference(rows, uneven, ci)


def _difference(rows: DataFrame, uneven: DataFrame, ci: DataFrame) -> DataFrame:
    """Both pairs' point estimates (sa, ca; sb, cb), their difference's interval, and an error for rows that lack one score."""
    point = auroc(rows, "sa", "ca").select("n_items", F.col("auroc").alias("_a")).join(F.broadcast(auroc(rows, "sb", "cb").select(F.col("auroc").alias("_b"))))
    guard = uneven.agg(F.when(F.count("*") > 0, F.raise_error(F.lit("a paired comparison needs both scores"))).alias("_g"))
    out = point.join(F.broadcast(ci)).join(F.broadcast(guard))
    return out.select("n_items", (F.col("_a") - F.col("_b")).alias("difference"), "ci_low", "ci_high", "n_boot_valid", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)).alias("difference_excludes_zero"), F.col("_g").alias("guard")).drop("guard")


def with_interval(points: DataFrame, per_rep: DataFrame, by: list[str] = [], value: str = "auroc") -> DataFrame:  # noqa: B006
    """points (a row a group) with the interval of its group's replicates."""
    ci = interval(per_rep, value, by)
    if not by:
        return points.join(F.broadcast(ci))
    ci = ci.select(*(F.col(c).alias(f"_i_{c}") for c in by), "n_boot_valid", "ci_low", "ci_high", "excludes_chance")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_i_{c}"))
    filled = {"n_boot_valid": F.coalesce("n_boot_valid", F.lit(0)), "excludes_chance": F.coalesce("excludes_chance", F.lit(False))}
    return points.join(F.broadcast(ci), same, "left").drop(*(f"_i_{c}" for c in by)).withColumns(filled)


def cuts_interval(df: DataFrame, score: str, correct: str, failures: str, max_score: float, reps: int) -> DataFrame:
    """Per cut: AUROC and interval, and on each row robust: whether the harshest cut still excludes chance (false where it is empty)."""
    run = with_cuts(df, score, failures, max_score)
    out = with_interval(auroc(run, score, correct, ["cut"], few=True), bootstrap_cells(run, score, correct, reps, ["cut"]), ["cut"])
    return out.withColumn("robust", F.coalesce(F.max(F.when(F.col("cut") == CUTS[3], F.col("excludes_chance"))).over(Window.partitionBy()), F.lit(False)))  # four rows


def _rule_counts(df: DataFrame, rule: str) -> DataFrame:
    return df.filter(F.col("entropy").isNotNull() & F.col("correct").isNotNull()).groupBy(rule, "entropy", "correct").agg(F.count("*").alias("n"))


def rule_points(df: DataFrame, rule: str, k: int, counts: DataFrame | None = None) -> DataFrame:
    """Per rule of a run (entropy, correct): counts, AUROC, items at the entropy of k different votes."""
    counts = _rule_counts(df, rule) if counts is None else counts
    top = math.log(k)
    at_max = counts.groupBy(F.col(rule).alias("_rule")).agg(F.coalesce(F.sum(F.when(F.abs(F.col("entropy") - top) <= 1e-9 * top, F.col("n"))), F.lit(0)).alias("n_at_max_entropy"))
    points = auroc(counts, "entropy", "correct", [rule], weight="n", few=True).withColumns({c: F.col(c).cast("long") for c in ("n_items", "n_error", "n_correct")})
    return points.join(at_max, F.col(rule) == F.col("_rule")).drop("_rule")


def rule_metrics(df: DataFrame, rule: str, k: int, reps: int) -> DataFrame:
    """`rule_points` with intervals. The run is counted once: the counts (rules times levels of an entropy times two, at most MOST_LEVELS) come to the driver, and estimates and draws both start from there."""
    found = _rule_counts(df, rule)
    rows = found.limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError("a score with this many values has no few levels")
    counts = df.sparkSession.createDataFrame(rows, found.schema)
    return with_interval(rule_points(df, rule, k, counts), bootstrap_cells(counts, "entropy", "correct", reps, [rule], count="n"), [rule])


def hashed_weights(df: DataFrame, key: str, reps: int, seed: int = 0) -> DataFrame:
    """df's rows for each replicate (rep) that draws them, with weight: how often. A Poisson draw of mean one from sha256 of seed, replicate and key, so that any engine makes the same replicates, and no draw has to be joined to its row."""
    return _drawn(df, key, reps, seed).filter("weight > 0")


def _drawn(df: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """`hashed_weights` with the rows that aren't drawn. The hash is an argument, so that it is made once a row, whatever it is compared with; its hex digits sort like its number."""
    hexes = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("rep"), F.col(key)), 256), 1, 8)
    times = lambda h: reduce(lambda more, i: F.when(h < f"{POISSON[i]:08x}", i).otherwise(more), reversed(range(len(POISSON))), F.lit(len(POISSON)))
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("weight", F.get(F.transform(F.array(hexes), times), F.lit(0)))


def hashed_cells(df: DataFrame, key: str, cell: list[str], reps: int, seed: int = 0) -> DataFrame:
    """(cell, rep, weight): the sums of `hashed_weights` in each cell. A cell's rows are brought together before they are drawn, so that no draw is shuffled, and all cores draw, however few files the rows come from."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _drawn(df.select(key, *cell).repartition(parts, *cell), key, reps, seed).groupBy(*cell, "rep").agg(F.sum("weight").alias("weight")).filter("weight > 0")


#: Of the 2^32 numbers, how many draw at most 0, 1, 2, ... from a Poisson law of mean one.
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


# ---- verdicts ----

#: Hypotheses registered before a larger run, each with what it measures and its verdicts in order; the first whose conditions hold is given.
#: Conditions: missing, few (of either class), ci_low and auroc at least, auroc below, an interval above chance.
SCALEUP = (
    ("perception_pooled_not_comparable", "perception", (("not_measured", "missing"), ("inconclusive_underpowered", "few"), ("replicated", "ci_low", 0.65), ("weaker_than_pilot", "excludes"), ("failed_to_replicate",))),
    ("perception", "perception_error_stratum", (("not_measured", "missing"), ("inconclusive_underpowered", "few"), ("replicated", "ci_low", 0.65), ("weaker_than_pilot", "excludes"), ("failed_to_replicate",))),
    ("reasoning_pooled", "reasoning_pooled", (("not_measured", "missing"), ("inconclusive_underpowered", "few"), ("signal_confirmed", "ci_low", 0.55), ("no_signal",))),
    ("reasoning_stratified", "reasoning_error_stratum", (("not_measured", "missing"), ("inconclusive_underpowered", "few"), ("confirmed", "auroc", 0.70, "excludes"), ("not_confirmed",))),
    ("clean_stratum_inversion", "reasoning_clean_stratum", (("not_measured", "undefined"), ("inconclusive_underpowered", "few"), ("confirmed", "below", 0.50), ("not_confirmed",))),
)
_RULE = "hypothesis string, measure string, place int, verdict string, missing boolean, undefined boolean, few boolean, ci_low_min double, auroc_min double, auroc_below double, above boolean"


def _rules(table=SCALEUP):
    for hypothesis, measure, verdicts in table:
        for place, (verdict, *when) in enumerate(verdicts):
            at = lambda name: float(when[when.index(name) + 1]) if name in when else None  # noqa: B023, E731
            yield (hypothesis, measure, place, verdict, "missing" in when, "undefined" in when, "few" in when, at("ci_low"), at("auroc"), at("below"), "excludes" in when)


def judged(metrics: DataFrame, by: list[str] = [], table=SCALEUP, minority: int = 30) -> DataFrame:  # noqa: B006
    """by, hypothesis, measure, verdict: every hypothesis of a table for every group of metrics (by, measure, n_error, n_correct, auroc, ci_low, excludes_chance), by one join with the table's rules.

    A measure that a group doesn't have is not measured.
    """
    rules = metrics.sparkSession.createDataFrame(list(_rules(table)), _RULE)
    groups = metrics.select(*by).distinct() if by else metrics.sparkSession.range(1).select()
    found = metrics.select(*(F.col(c).alias(f"_g_{c}") for c in by), F.col("measure").alias("_measure"), "n_error", "n_correct", "auroc", "ci_low", "excludes_chance")
    same = F.col("measure") == F.col("_measure")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    rows = groups.crossJoin(F.broadcast(rules)).join(found, same, "left")  # rules: a few dozen, fixed
    absent = F.col("n_error").isNull()
    least = lambda limit, value: F.col(limit).isNull() | F.coalesce(F.col(value) >= F.col(limit), F.lit(False))
    holds = (
        (~F.col("missing") | absent) & (~F.col("undefined") | F.col("auroc").isNull()) & (~F.col("few") | F.coalesce(F.least("n_error", "n_correct") < minority, F.lit(False))) & least("ci_low_min", "ci_low") & least("auroc_min", "auroc")
        & (F.col("auroc_below").isNull() | F.coalesce(F.col("auroc") < F.col("auroc_below"), F.lit(False))) & (~F.col("above") | F.coalesce("excludes_chance", F.lit(False)))
    )
    return rows.filter(holds).groupBy(*by, "hypothesis", "measure").agg(F.min_by("verdict", "place").alias("verdict"))



def stratum_verdict(n_items: Column, n_error: Column, n_correct: Column, auroc_: Column, ci_high: Column, excludes: Column, threshold: float = 0.70, minority: int = 30) -> Column:
    """Inversion is tested before chance."""
    return (
        F.when(n_items.isNull() | (n_items == 0), "not_measured").when(F.least(n_error, n_correct) < minority, "inconclusive_underpowered").when(ci_high < 0.5, "confirmed_inverted")
        .when(~excludes, "no_signal").when(auroc_ >= threshold, "confirmed").otherwise("resolved_below_threshold")
    )


def scaleup_verdict(n_error: Column, n_correct: Column, ci_low: Column, excludes: Column, threshold: float, minority: int = 30) -> Column:
    return (
        F.when(n_error.isNull(), "not_measured").when(F.least(n_error, n_correct) < minority, "inconclusive_underpowered").when(ci_low >= threshold, "replicated")
        .when(excludes, "weaker_than_pilot").otherwise("failed_to_replicate")
    )


def resample_verdict(n_wrong: Column, auroc_: Column, median_wrong: Column, median_right: Column) -> Column:
    return F.when(n_wrong < 15, "inconclusive_underpowered").when((auroc_ >= 0.72) & (median_wrong > median_right), "confirmed_sharper").when(auroc_ >= 0.55, "confirmed_modest").otherwise("null_at_k5_was_noise")


def capability_verdict(accuracy: Column, capable: float = 0.65, chance: float = 0.55) -> Column:
    return F.when(accuracy >= capable, "capable").when(accuracy < chance, "at_chance").otherwise("marginal")


def capability(df: DataFrame, correct: str, label: str, by: list[str] = [], capable: float = 0.65, chance: float = 0.55) -> DataFrame:  # noqa: B006
    """Per group, whether a grader is good enough for its uncertainty to mean anything: accuracy, that of always naming the larger class, the margin between them, and the verdict."""
    p = F.avg(F.col(label).cast("int"))
    out = df.groupBy(*by).agg(F.count("*").alias("n_items"), F.avg(F.col(correct).cast("int")).alias("accuracy"), F.greatest(p, 1 - p).alias("baseline_accuracy"))
    out = out.withColumns({"margin_over_baseline": F.col("accuracy") - F.col("baseline_accuracy"), "verdict": capability_verdict(F.col("accuracy"), capable, chance), "threshold_capable": F.lit(capable), "threshold_chance": F.lit(chance)})
    return out.withColumn("entropy_result_meaningful", F.col("verdict") == "capable")


def class_baseline(df: DataFrame, label: str) -> DataFrame:
    p = F.avg(F.col(label).cast("int"))
    return df.agg(F.count(label).alias("n"), p.alias("frac_positive"), (p >= 0.5).alias("majority_label"), F.greatest(p, 1 - p).alias("baseline_accuracy"))


def collapse_check(df: DataFrame, correct: str, prediction: str) -> DataFrame:
    same = F.avg((F.col(correct) == F.col(prediction)).cast("int"))
    return df.agg(F.count("*").alias("n_items"), same.alias("agreement"), F.coalesce((same >= 0.95) | (same <= 0.05), F.lit(False)).alias("degenerate"))


def zero_anchor(df: DataFrame, score: str, tol: float = 1e-6) -> DataFrame:
    off = F.abs(F.col(score)) > tol
    n = F.count_if(off)
    return df.agg(F.count("*").alias("n_items"), n.alias("n_nonzero"), F.coalesce(ratio(n, F.count("*")), F.lit(0.0)).alias("frac_nonzero"), F.coalesce(F.max(score), F.lit(0.0)).alias("max_value"), (n == 0).alias("passed"))


def failure_rate(df: DataFrame, failures: str, k: int = 5) -> DataFrame:
    x = F.coalesce(F.col(failures), F.lit(0))
    failed, total = F.sum(x), F.count("*") * k
    return df.agg(F.coalesce(failed, F.lit(0)).alias("n_failed_samples"), total.alias("n_total_samples"), F.coalesce(ratio(failed, total), F.lit(0.0)).alias("frac_failed"), F.count_if(x >= k).alias("n_items_all_failed"))


def by_correctness(df: DataFrame, score: str, correct: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(correct).alias("correct")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.median(score).alias("median"))


def accuracy_by_distinct(df: DataFrame, distinct: str, correct: str) -> DataFrame:
    return df.groupBy(F.col(distinct).alias("n_distinct")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def distribution(df: DataFrame, score: str, digits: int = 3, degenerate: float = 0.60) -> DataFrame:
    """Counts of a score's rounded levels, with their number, the largest one's share, and whether that is too large for a ranking to mean anything."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.round(score, digits).alias(score)).agg(F.count("*").alias("n"))
    facts = counts.agg(F.count("*").alias("n_distinct_values"), ratio(F.max("n"), F.sum("n")).alias("largest_share"))
    return counts.join(F.broadcast(facts)).withColumn("is_degenerate", F.col("largest_share") >= degenerate)
