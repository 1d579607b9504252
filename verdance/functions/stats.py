"""Closed-form statistics as column expressions. Undefined values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def dbl(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(dbl(a), dbl(b))


def binary_entropy(p: Column) -> Column:
    """Bernoulli entropy in nats; 0 at both ends."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(F.lit(0.0) - (p * F.log(p) + (1 - p) * F.log(1 - p)))


def vote_entropy(votes: Column, k: Column) -> Column:
    """Entropy of s against K - s votes; mirrored counts tie exactly."""
    return binary_entropy(ratio(F.least(votes, k - votes), k))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    k, n = dbl(k), dbl(n)
    p, d = F.try_divide(k, n), 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / d
    # least and greatest skip nulls; an empty sample has no interval
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def oracle_aurc(r: Column) -> Column:
    """Area under the risk-coverage curve of a perfect ranker; 0 and 1 at the ends. Rates outside [0, 1] are an error."""
    return (
        F.when((r < 0) | (r > 1), F.raise_error(F.lit("an error rate lies in [0, 1]")).cast("double"))
        .when(r == 0, F.lit(0.0)).when(r == 1, F.lit(1.0)).otherwise(r + (1 - r) * F.log(1 - r))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either is all zero."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: dbl(x) * dbl(y)), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: dbl(x) * dbl(x)), F.lit(0.0), add))
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot / scale)


def kappa(observed: Column, chance: Column) -> Column:
    return F.when(chance < 1, (observed - chance) / (1 - chance))


def hash_key(seed, *parts: Column) -> Column:
    """Deterministic draw order: sha256 of seed and key, the same in any engine that has it."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def hash_number(text: Column) -> Column:
    """First four bytes of the text's sha256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_uniform(seed, *parts: Column) -> Column:
    return hash_number(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))) / F.lit(4294967296.0)


def binomial_pmf(s: Column, k: Column, p: Column) -> Column:
    """k up to 20."""
    choose = F.factorial(k.cast("int")) / (F.factorial(s.cast("int")) * F.factorial((k - s).cast("int")))
    return choose * F.pow(p, s) * F.pow(1 - p, k - s)


def labels_entropy(labels: Column) -> Column:
    """Entropy of an array of labels; empty arrays have 0."""
    sizes = F.transform(F.array_distinct(labels), lambda x: dbl(F.size(F.filter(labels, lambda y: y.eqNullSafe(x)))))
    n = dbl(F.size(labels))
    return F.when(F.size(labels) == 0, F.lit(0.0)).otherwise(F.abs(F.log(n) - F.aggregate(F.sort_array(sizes), F.lit(0.0), lambda a, s: a + s * F.log(s)) / n))


def k5_distinct(entropy: Column) -> Column:
    """Number of different labels among five from the entropy; values that five labels can't have are an error."""
    # The seven partitions of five.
    table = ((0.0, 1), (0.5004, 2), (0.6730, 2), (0.9503, 3), (1.0549, 3), (1.3322, 4), (1.6094, 5))
    hit = F.coalesce(*(F.when(F.abs(entropy - v) <= 1e-3, n) for v, n in table))
    return F.when(entropy.isNull(), None).otherwise(F.coalesce(hit, F.raise_error(F.lit("not an entropy of five labels")).cast("int")))
