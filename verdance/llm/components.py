"""Connected components of a large graph, by alternating stars.

Each round points every node's larger neighbours at its smallest one, and then all its smaller neighbours too (large
and small stars), until nothing changes; rounds grow with the logarithm of the size. Edges of a hub are counted
down before the shuffle (minimum per task), and its join is an ordinary one that adaptive execution can split. Every
round's edges are written to the shared folder, so that lost executors cost one round at most. The driver sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _smallest(edges: DataFrame) -> DataFrame:
    """(hi, lo) edges with each hi's smallest neighbour below it (written first: a join with a table can be split where a hub's edges crowd, one with an aggregate can't)."""
    least = written(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least", compact=True)
    return edges.join(least, "hi")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    met = _smallest(both).filter("lo > hi").select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo"))
    return met.filter("hi <> lo").distinct()


def _small(edges: DataFrame) -> DataFrame:
    met = _smallest(edges)
    return met.select("hi", F.col("m").alias("lo")).unionByName(met.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long): root is the smallest node that can be reached."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = written(_small(_large(now)), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("x")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one task as stars (node, smallest node): joins the same nodes with fewer edges."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def as_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
