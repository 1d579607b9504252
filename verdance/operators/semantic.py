"""Clustering of an item's few samples by pairwise similarity: edges, components, entropy of the clusters.

Items hold K samples (15 at most in practice), so pairs are joined within an item only, and components are found by
spreading the smallest position along edges K - 1 times at most (closures of K nodes), inside arrays of one row per item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import cosine, dbl
from .backends import called


def comparable(samples: DataFrame, text: str = "text") -> DataFrame:
    """Marks samples that can be compared; null and blank ones share the sentinel's cluster."""
    return samples.withColumn("comparable", F.coalesce(F.length(F.regexp_replace(F.col(text), r"\s+", "")) > 0, F.lit(False)))


def edges(samples: DataFrame, keys: list[str], value: str, similar: Callable[[Column, Column], Column], pos: str = "pos") -> DataFrame:
    """(keys, i, j), i < j, of an item's samples whose values are similar."""
    a = samples.select(*keys, F.col(pos).alias("i"), F.col(value).alias("_a"))
    b = samples.select(*keys, F.col(pos).alias("j"), F.col(value).alias("_b"))
    return a.join(b, keys).filter((F.col("i") < F.col("j")) & similar(F.col("_a"), F.col("_b"))).select(*keys, "i", "j")


def model_edges(samples: DataFrame, keys: list[str], value: str, make, entails: int = 1, pos: str = "pos", batch: int = 64) -> DataFrame:
    """(keys, i, j), i < j, of an item's samples that entail each other by an inference model's scores: both directions of a pair are in one call, equal pairs of texts are asked once."""
    a = samples.select(*keys, F.col(pos).alias("i"), F.col(value).alias("a"))
    b = samples.select(*keys, F.col(pos).alias("j"), F.col(value).alias("b"))
    pairs = a.join(b, keys).filter(F.col("i") < F.col("j")).withColumns({"one": F.least("a", "b"), "two": F.greatest("a", "b")})

    def both():
        model = make()

        def ask(texts):
            scores = list(model([p for x, y in texts for p in ((x, y), (y, x))]))
            return [[list(map(float, scores[2 * n])), list(map(float, scores[2 * n + 1]))] for n in range(len(texts))]

        return ask

    told = called(pairs.select("one", "two").distinct(), ["one", "two"], ["one", "two"], both, "scores", "array<array<double>>", batch)
    sound = F.when(F.col("error").isNull(), F.col("scores")).otherwise(F.raise_error(F.col("error")).cast("array<array<double>>"))
    told = told.select("one", "two", sound.alias("scores"))
    return pairs.join(told, ["one", "two"]).filter(agreed(F.get("scores", F.lit(0)), F.get("scores", F.lit(1)), entails)).select(*keys, "i", "j")


def components(samples: DataFrame, linked: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, pos, cluster): the smallest position that a sample reaches."""
    nodes = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(pos).cast("int"))).alias("nodes"))
    links = linked.groupBy(*keys).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))).alias("links"))
    start = F.transform("nodes", lambda n: F.struct(n.alias("node"), n.alias("root")))

    def spread(state, _):
        root_of = F.map_from_entries(state)
        # each node takes the smallest root among its own and its neighbours'
        near = lambda n: F.array_min(F.transform(F.filter("links", lambda e: (e["i"] == n) | (e["j"] == n)), lambda e: F.least(F.element_at(root_of, e["i"]), F.element_at(root_of, e["j"]))))
        return F.transform(state, lambda s: F.struct(s["node"].alias("node"), F.least(s["root"], F.coalesce(near(s["node"]), s["root"])).alias("root")))

    rounds = F.when(F.size("nodes") > 1, F.sequence(F.lit(1), F.size("nodes") - 1)).otherwise(F.array().cast("array<int>"))
    both = nodes.join(links, keys, "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<i:int,j:int>>")))
    return both.select(*keys, F.explode(F.aggregate(rounds, start, spread)).alias("s")).select(*keys, F.col("s.node").alias(pos), F.col("s.root").alias("cluster"))


def embedding_clusters(samples: DataFrame, keys: list[str], vector: str, threshold: float = 0.85, pos: str = "pos") -> DataFrame:
    return components(samples, edges(samples, keys, vector, lambda a, b: cosine(a, b) >= threshold, pos), keys, pos)


def agreed(forward: Column, backward: Column, entails: int = 1) -> Column:
    """Edge of an inference model: the class of entailment scores highest in both directions (arrays of class scores)."""
    top = lambda s: F.array_position(s, F.array_max(s)) - 1
    return (top(forward) == entails) & (top(backward) == entails)


def greedy(samples: DataFrame, keys: list[str], value: str, equivalent, pos: str = "pos") -> DataFrame:
    """(keys, pos, cluster) by first representatives, in order of position, with a Python predicate (null is equal to nothing)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        heads: list[tuple[int, object]] = []
        cluster = []
        for p, v in zip(pdf[pos], pdf[value], strict=True):
            hit = None if v is None else next((h for h, x in heads if x is not None and equivalent(x, v)), None)
            if hit is None:
                hit = p
                heads.append((p, v))
            cluster.append(hit)
        return pdf.assign(cluster=cluster)[[*keys, pos, "cluster"]]

    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in [*keys, pos])
    return samples.groupBy(*keys).applyInPandas(run, f"{kinds}, cluster {samples.schema[pos].dataType.simpleString()}")


def chance_of_agreement(counts: Column, n: Column) -> Column:
    return F.try_divide(dbl(counts), dbl(n))
