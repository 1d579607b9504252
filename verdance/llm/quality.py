"""Quality classifier: a regularised quadratic discriminant.

Each text gives 17 statistics (lengths, shares of byte classes, repetition), transformed by logarithm or root so that
they lie nearer to a normal law. Per class, mean and covariance come from sums over the labelled rows of the
training folds (up to FIT_ROWS of them), added up inside the cluster (2 x 324 numbers reach the driver, whatever the input). Covariances are
shrunk towards the pooled diagonal; their Cholesky factors are computed once and sent with the model. A score is the
logistic of the difference of the two log densities (Mahalanobis distance and log determinant) plus that of the
priors, divided by the number of statistics, which changes no decision and keeps scores apart.

Labels of rows in other folds, and lang, source and doc_id, are never read into a score. Null texts count as empty;
an empty text has a score like any other. Several labels of one id: the lowest counts; qualities other than 0 and 1 are
no labels. Without rows of both classes
every score is 0.5. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small, text_bytes, trimmed, written
from .rules import class_counts, repeated_words

SIZE = 17
#: Labelled rows that the fit takes at most.
FIT_ROWS = 200_000
SHRINK = 0.1
FLOOR = 1e-4


def statistics(raw: bytes) -> list[float]:
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [0.0] * SIZE
    c = class_counts(raw)
    letters = max(1, c[2] + c[3] + c[8])
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda k, of: math.sqrt(k / of)
    return [
        math.log1p(n), math.log1p(m), math.log(n / m), share(c[3], letters), share(c[4], n), share(c[5], n), share(c[6], n), share(c[7], n), share(c[8], n), share(c[1], n),
        math.log1p(len(counts)) / math.log1p(m), share(max(counts.values()), m), share(sum(a == b for a, b in zip(words, words[1:])), m),
        share(repeated_words(words), m), share(len(lines) - len(set(lines)), max(1, len(lines))), share(raw.count(b"!"), m), share(raw.count(b"|"), m),
    ]


def _statistics(batches):
    for b in small(batches):
        rows = [statistics(raw) for raw in b.column("raw").to_pylist()]
        flat = pa.array(np.array(rows, np.float64).ravel())
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SIZE, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*(c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "raw"), x], [*(name for name in b.schema.names if name != "raw"), "x"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (its fold) and the statistics x of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(3) == 1).alias("held_out"), text_bytes().alias("raw"))
    return rows.mapInArrow(trimmed(_statistics), f"doc_id {kind}, held_out boolean, x array<double>")


def _sums(batches):
    """Per task and class: number, sums and sums of products, as (label, place, value)."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, SIZE)
        x = np.hstack([np.ones((len(x), 1)), x])
        y = np.array(b.column("y").to_pylist())
        for label in np.unique(y):
            part = x[y == label]
            total[int(label)] = total.get(int(label), 0) + part.T @ part
    rows = [(label, i, float(v)) for label, t in total.items() for i, v in enumerate(t.ravel())]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["y", "i", "v"])


def training_labels(labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(id, y): labelled rows outside the held-out fold, `most` of them at most (those of the smallest hashes), hence small enough to broadcast."""
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).filter(fold(3) != 1)
    return F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "y"))


def fit(rows: DataFrame, marked: DataFrame) -> dict | None:
    """Model from rows with statistics (doc_id, x) that have a training label."""
    known = rows.join(marked, F.col("doc_id") == F.col("id")).select("x", "y")
    sums = known.mapInArrow(_sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    by: dict[int, np.ndarray] = {}
    for r in sums:
        by.setdefault(r["y"], np.zeros((SIZE + 1) ** 2))[r["i"]] = r["v"]
    if set(by) != {0, 1}:
        return None
    model: dict = {"n": {}, "mean": {}, "factor": {}, "log_det": {}}
    cov, n = {}, {}
    for y, flat in by.items():
        t = flat.reshape(SIZE + 1, SIZE + 1)
        n[y] = t[0, 0]
        mean = t[0, 1:] / n[y]
        cov[y] = t[1:, 1:] / n[y] - np.outer(mean, mean)
        model["mean"][y] = mean
    pooled = np.diag(sum(cov[y] * n[y] for y in (0, 1)) / (n[0] + n[1])) + FLOOR
    for y in (0, 1):
        shrunk = (1 - SHRINK) * cov[y] + SHRINK * np.diag(pooled)
        model["factor"][y] = np.linalg.inv(np.linalg.cholesky(shrunk))
        model["log_det"][y] = -2 * np.log(np.diag(model["factor"][y])).sum()
    model["prior"] = math.log(n[1] / n[0])
    return model


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    density = {y: -0.5 * ((((x - model["mean"][y]) @ model["factor"][y].T) ** 2).sum(axis=1) + model["log_det"][y]) for y in (0, 1)}
    return 1 / (1 + np.exp(np.clip((density[0] - density[1] - model["prior"]) / SIZE, -700, 700)))


def _scored(model):
    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, SIZE)
            s = scores(model.value, x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = written(with_statistics(docs), "statistics", compact=True)  # 17 numbers a document: texts are read once
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, training_labels(labels)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _kept(model):
    def run(batches):
        for b in small(batches):
            x = np.array([statistics((t or "").encode()) for t in b.column("text").to_pylist()], np.float64).reshape(-1, SIZE)
            yield b.filter(pa.array(scores(model.value, x) >= 0.5))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier predicts to be good, with their columns."""
    marked = training_labels(labels)
    known = docs.join(marked.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")  # statistics are taken of labelled texts only
    model = docs.sparkSession.sparkContext.broadcast(fit(with_statistics(known), marked))
    return docs.mapInArrow(trimmed(_kept(model)), docs.schema)
