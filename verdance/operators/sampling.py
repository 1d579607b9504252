"""Deterministic sampling and census: hash orders, quotas, disjoint slices, round robins, largest remainders.

Draws follow sha256 of seed and key, so they are the same on any cluster and in any engine. Exact sizes come from
ranks; a global top-n is a limit over the hash order, which Spark takes per task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import dbl, hash_key, ratio


def census(df: DataFrame, flag: str) -> DataFrame:
    bad, n = F.count_if(F.col(flag)), F.count("*")
    return df.agg(n.alias("n_total"), bad.alias("n_error"), (n - bad).alias("n_clean"), F.coalesce(ratio(bad, n), F.lit(0.0)).alias("frac_error"), (2 * F.least(bad, n - bad)).alias("max_balanced_n"))


def sample(df: DataFrame, n: int, seed, key: str, skip: int = 0) -> DataFrame:
    """n rows in hash order, after the first `skip`: slices of one order never overlap."""
    return df.orderBy(hash_key(seed, F.col(key)), key).offset(skip).limit(n) if skip else df.orderBy(hash_key(seed, F.col(key)), key).limit(n)


def extension(pool: DataFrame, existing: DataFrame, key: str, n: int, seed) -> DataFrame:
    """n more rows of a pool in hash order, none of an existing sheet's; a sheet with items that are not in the pool is an error."""
    stray = existing.select(key).join(pool.select(key), key, "left_anti").agg(F.count("*").alias("_stray"))
    sound = F.when(F.col("_stray") == 0, True).otherwise(F.raise_error(F.lit("the existing sheet holds items that are not in the pool")).cast("boolean"))
    return sample(pool.join(existing.select(key), key, "left_anti"), n, seed, key).join(F.broadcast(stray)).filter(sound).drop("_stray")


def quotas(n: int, fraction: float, n_true: Column, n_false: Column) -> tuple[Column, Column]:
    """Rows to take of either kind: where a pool is short both shrink, so that the ratio stays."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies in (0, 1)")
    want_true = F.bround(F.lit(float(n) * fraction)).cast("double")
    want_false = n - want_true
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(dbl(n_true), want_true), F.lit(1.0)), F.coalesce(F.try_divide(dbl(n_false), want_false), F.lit(1.0)))
    return F.floor(want_true * scale), F.floor(want_false * scale)


def balanced(df: DataFrame, flag: str, n: int, seed, key: str, fraction: float = 0.5, whole: bool = False) -> DataFrame:
    """Two-stratum quota sample, with review_order: its place in a second shuffle of the sample. whole: a pool too short for n rows is an error."""
    counts = df.agg(F.count_if(F.col(flag)).alias("_t"), F.count_if(~F.col(flag)).alias("_f"))
    take_true, take_false = quotas(n, fraction, F.col("_t"), F.col("_f"))
    if whole:
        short = F.raise_error(F.format_string(f"the source can't supply n={n} at fraction={fraction}: it would give %d", (take_true + take_false).cast("long")))
        counts = counts.filter(F.when(take_true + take_false == n, True).otherwise(short.cast("boolean")))
    pools = [df.filter(F.col(flag) == f).orderBy(hash_key(seed, F.col(key)), key).limit(n).withColumn("_rn", F.row_number().over(Window.orderBy(hash_key(seed, F.col(key)), key))) for f in (True, False)]
    chosen = pools[0].unionByName(pools[1]).join(F.broadcast(counts)).filter(F.col("_rn") <= F.when(F.col(flag), take_true).otherwise(take_false)).drop("_rn", "_t", "_f")
    return chosen.withColumn("review_order", F.row_number().over(Window.orderBy(hash_key(f"{seed}-shuffle", F.col(key)), key)) - 1)  # at most n rows


def pooled(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union of configurations, each tagged; columns that one lacks are null."""
    out = None
    for name, part in parts.items():
        part = part if tag in part.columns else part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compare(sample_: DataFrame, corpus: DataFrame, flags: list[str], texts: list[str]) -> DataFrame:
    """field, corpus, sample, delta: shares of flags, median lengths, and n (whose delta is null)."""

    def facts(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(dbl(F.count("*")).alias("n"), *(F.avg(F.col(f).cast("int")).alias(f"frac_{f}") for f in flags), *(F.median(F.length(t)).cast("double").alias(f"median_len_{t}") for t in texts))
        return row.unpivot([], row.columns, "field", name)

    both = facts(corpus, "corpus").join(facts(sample_, "sample"), "field")
    return both.withColumn("delta", F.when(F.col("field") != "n", F.col("sample") - F.col("corpus")))


def round_robin(df: DataFrame, cell: list[str], kind: str, n: int, order: list[Column], kind_order: Column) -> DataFrame:
    """n rows of each cell, taking turns over its kinds: the first of each kind, then the second of each, ..."""
    turn = F.row_number().over(Window.partitionBy(*cell, kind).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_turn", kind_order, *order))
    # only the first n of a kind can be taken, so the second ranking sees few rows
    return df.withColumn("_turn", turn).filter(F.col("_turn") <= n).withColumn("_place", place).filter(F.col("_place") <= n).drop("_turn", "_place")


def priority(df: DataFrame, cell: list[str], n: Column, tier: Column, order: list[Column]) -> DataFrame:
    """The first n of each cell by tier, then order."""
    return df.withColumn("_n", n).withColumn("_p", F.row_number().over(Window.partitionBy(*cell).orderBy(tier, *order))).filter(F.col("_p") <= F.col("_n")).drop("_n", "_p")


def allocation(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, size, take: proportional shares by largest remainder (of equals the first name), which add up to n."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("_all"))
    want = dbl(F.col("size")) / dbl(F.col("_all")) * F.lit(float(n))
    based = sizes.join(F.broadcast(total)).withColumns({"base": F.floor(want), "rest": F.round(want - F.floor(want), 12)})
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a stratum
    by_rest = Window.orderBy(F.col("rest").desc(), stratum)
    out = based.withColumn("_missing", n - F.sum("base").over(everything)).withColumn("_rank", F.row_number().over(by_rest))
    return out.select(stratum, "size", (F.col("base") + (F.col("_rank") <= F.col("_missing")).cast("int")).alias("take"))


def entropy_bin(h: Column) -> Column:
    return F.when(h <= 0, "H=0").when(h < 0.7, "H_low").when(h < 1.4, "H_mid").otherwise("H_high")


def hash_places(df: DataFrame, by: list[str], h: str, item: str, name: str) -> DataFrame:
    """df with each row's place in its group by a hash, then item, from 0. Hashes are even, so their first three digits cut a group into 4,096 parts of like size, which are ranked apart; counts of parts tell what comes before."""
    cut = df.withColumn("_part", F.substring(h, 1, 3))
    keys = [*by, "_part"]
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("_c"))
    before = sizes.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    inside = Window.partitionBy(*keys).orderBy(h, item)
    return cut.join(before, same).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).select(*df.columns, name)


def queue(items: DataFrame, item: str, stratum: str, n: int, seed, challenge: list[int] = []) -> DataFrame:  # noqa: B006
    """Every item with its queue (core, challenge, extension), selection_prob (core only), review_order and review_id."""
    tagged = items.withColumn("_challenge", F.col(item).isin(challenge) if challenge else F.lit(False))
    pool = tagged.filter(~F.col("_challenge"))
    share = allocation(pool, stratum, n)
    ranked = hash_places(tagged.withColumn("_h", hash_key(seed, F.col(item))), [stratum, "_challenge"], "_h", item, "_rank")
    joined = ranked.join(F.broadcast(share), stratum, "left")
    kind = F.when(F.col("_challenge"), "challenge").when(F.col("_rank") < F.col("take"), "core").otherwise("extension")
    out = hash_places(joined.withColumn("queue", kind).withColumn("_h", hash_key(f"{seed}-review", F.col(item))), [], "_h", item, "review_order")
    return out.select(*items.columns, "queue", F.when(F.col("queue") == "core", F.round(ratio(F.col("take"), F.col("size")), 6)).alias("selection_prob"), "review_order", F.format_string("R%04d", "review_order").alias("review_id"))


def queue_counts(queue_: DataFrame, item: str) -> DataFrame:
    """queue, n, disjoint: items in each part of a review queue, and whether no item is in two."""
    twice = queue_.groupBy(item).agg(F.count_distinct("queue").alias("_q")).agg(F.coalesce(F.max("_q") < 2, F.lit(True)).alias("disjoint"))
    return queue_.groupBy("queue").agg(F.count("*").alias("n")).join(F.broadcast(twice))


def template(queue_: DataFrame, version: str, fields: list[str]) -> DataFrame:
    """A blank sheet for a blinded rater: ids and empty answers, nothing that tells the first labels."""
    return queue_.select("review_id", F.lit(version).alias("protocol_version"), *(F.lit("").alias(f) for f in fields))


def is_blank(fields: list[str]) -> Column:
    from functools import reduce

    return reduce(lambda a, b: a & b, (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "" for f in fields))
