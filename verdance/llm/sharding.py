"""Sharding by sampled splitters.

Records are ordered by a key (hash of the text, then hash of the id, then the id). A size-weighted sample of the
keys gives splitters at its quantiles; these cut the key space into fine ranges. Ranges that turn out heavier than
allowed are subdivided by splitters drawn from a sample of their own. Exact bytes of every range (a few hundred
rows) give each range's offset, a running sum inside the range gives each record's place on the line of all bytes,
and a record's shard is the piece of that line in which the middle of the record falls. So shards differ by at most about one
record's size, equal texts stay neighbours (a group lies in one shard or in consecutive ones), and a key with a
third of all rows is spread like any other bytes: ids, and places in the input, break ties, so a range of one text,
or of one row repeated, can be subdivided too. Ranges get finer with the number of rows (up to `finest` a shard).

Null texts have size 8 and the empty text's crc32; null ids sort first. An empty table gives no rows. Repeated rows
count each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LAW = "bytes"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (k1: text, k2: id, and in its low bits the place in the input, so that equal rows can be cut apart)."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    return docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("k1"),
        F.xxhash64(F.lit(7), F.col("doc_id")).bitwiseAND(F.lit(-1 << 16)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 16) - 1))).alias("k2"),
    )


def _sample(rows: DataFrame, total: int, wanted: int) -> list[tuple[int, int]]:
    """About `wanted` keys (as its mean), each drawn by its own hash with a chance in proportion to the size."""
    u = F.pmod(F.xxhash64(F.lit("draw"), "k1", "k2"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return sorted((r["k1"], r["k2"]) for r in rows.filter(u < F.col("size") * F.lit(wanted / max(total, 1))).select("k1", "k2").collect())


def _quantiles(keys: list[tuple[int, int]], pieces: int) -> list[tuple[int, int]]:
    n = len(keys)
    return sorted({keys[i * n // pieces] for i in range(1, pieces) if n})


def range_of(splitters: list[tuple[int, int]]):
    """How many splitters are at or before the key: a binary search over two literal arrays, padded to a power of two."""
    steps = max(1, len(splitters).bit_length())
    top = (1 << 63) - 1
    padded = [*splitters, *[(top, top)] * ((1 << steps) - len(splitters))]
    first, second = (F.array(*(F.lit(x[i]) for x in padded)) for i in (0, 1))
    k1, k2 = F.col("k1"), F.col("k2")

    def step(low, width):
        at = low + width
        a, b = F.element_at(first, at), F.element_at(second, at)
        return F.when((a < k1) | ((a == k1) & (b <= k2)), at).otherwise(low)

    widths = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
    return F.aggregate(widths, F.lit(0), step)


def shard(docs: DataFrame, shards: int = 24, fineness: int = 8, per_range: int = 16, rounds: int = 4, range_rows: int = 1 << 20, finest: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0), grown_shard (null: the law is `bytes`), range."""
    rows = written(keyed(docs), "shard-keys", compact=True)  # a few dozen bytes a record: the texts are read once
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces = shards * max(fineness, min(finest, -(-count // (shards * range_rows))))  # ranges are sorted by one task each
    splitters = _quantiles(_sample(rows, total, pieces * per_range), pieces)
    weigh = lambda cuts: {r["range"]: r for r in rows.groupBy(range_of(cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("largest")).collect()}
    ranges = weigh(splitters)
    for _ in range(rounds):
        heavy = [i for i, r in ranges.items() if r["bytes"] > 3 * total / pieces and r["rows"] > 1 and r["bytes"] > 2 * r["largest"]]
        if not heavy:
            break
        inside = rows.filter(range_of(splitters).isin(heavy))
        drawn = _sample(inside, sum(ranges[i]["bytes"] for i in heavy), len(heavy) * 4 * per_range)
        more = _quantiles(drawn, len(heavy) * 4)
        if set(more) <= set(splitters):
            break
        splitters = sorted({*splitters, *more})
        ranges = weigh(splitters)

    spark, offsets, at, row = docs.sparkSession, [], 0, 0
    for i in sorted(ranges):
        offsets.append((i, at, row))
        at, row = at + ranges[i]["bytes"], row + ranges[i]["rows"]
    start = spark.createDataFrame(offsets, "range int, at long, row long")
    line = Window.partitionBy("range").orderBy("k1", "k2", F.col("doc_id").asc_nulls_first(), "size")
    middle = F.col("at") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.floor(F.col("size") / 2)
    placed = (
        rows.withColumn("range", range_of(splitters))
        .join(F.broadcast(start), "range")  # one row per range: bounded by the parameters
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(float(shards)) / F.lit(float(max(total, 1))))).cast("int"))
        .withColumn("place", F.col("row") + F.row_number().over(line) - 1)
        .drop("at", "row")
    )
    # places rise with the bytes, so inside a range slots follow from the first place of the shard: one row per (range, shard)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range"
    )
