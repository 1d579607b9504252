"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots, each for one block of `block` words of one source. Slot j lies at the van der Corput
point of j (its bits in reverse) on the line of all targets, and belongs to the source whose stretch holds the point, so any
run of slots has each source near its share. The rank of a slot among its source's follows from the bits of j: as many
points of each aligned power of two below j as fall into the stretch. Each source's documents stand in a shuffled order
(by md5 of id and text) on a line of words, walked twice at most; slot of rank r takes words r * block to
(r + 1) * block of it. Schedule and documents meet in a join on source and block.

Places on a source's line are running sums over buckets of about `BUCKET` documents, over groups of buckets, and over
groups, so that a source with most documents is spread over tasks. Sources are taken to be few: their sizes, targets and
stretches go through the driver, and more than `MAX_SOURCES` are an error.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share `epochs` of all words; a target stops
at `most` times the source's words, and what is over goes to the others by weight: min(most * words, level * weight).

A null or empty text has no words and none is taken of it; its source may still have a weight. Repeated rows are
documents of their own; rows equal in id and text stand side by side. An empty table gives no rows. Other columns are
ignored. Results depend on ids and texts alone, not on the partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_bytes, trimmed, written

WEIGHTS = (5, 2, 1)
BITS = 40  # of a slot's number and of its point
BUCKET, GROUP = 256, 1024
MAX_SOURCES = 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _counted(batches):
    """(row, raw) to (row, size): words of whole texts, counted where they begin."""
    for b in small(batches):
        sizes = []
        for raw in b.column("raw"):
            space = _SPACE[np.frombuffer(raw.as_buffer(), np.uint8)]
            sizes.append(int((~space[:1]).sum() + (space[:-1] & ~space[1:]).sum()))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sizes, pa.int64())], ["row", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key (32 hex digits that shuffle)."""
    raw = text_bytes()
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(raw)))
    rows = docs.select(F.struct("doc_id", "source", key.alias("key")).alias("row"), raw.alias("raw"))
    return rows.mapInArrow(trimmed(_counted), f"row {rows.schema['row'].dataType.simpleString()}, size long").select("row.*", "size")


def targets(sizes: list[int], epochs: float = 1.5, most: int = 2) -> list[float]:
    """Each source's target, sources in their order: min(cap, level * weight), the level such that all share epochs * words."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    left, weight = epochs * sum(sizes), sum(weights)
    level = 0.0
    for cap, w in sorted(((most * n, w) for n, w in zip(sizes, weights, strict=True)), key=lambda x: x[0] / x[1]):
        level = left / weight
        if level * w <= cap:
            break
        left, weight = left - cap, weight - w
    return [float(min(most * n, level * w)) for n, w in zip(sizes, weights, strict=True)]


def reversed_bits(j: np.ndarray) -> np.ndarray:
    out = np.zeros_like(j)
    for b in range(BITS):
        out |= ((j >> b) & 1) << (BITS - 1 - b)
    return out


def points_below(j: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the slots 0 to j - 1 have a point below x: by the aligned powers of two that make up j."""
    rev, n = reversed_bits(j), np.zeros_like(j)
    for p in range(BITS):
        low = rev & ((1 << (BITS - 1 - p)) - 1)  # the point of the part's first slot; its others are whole steps of 1 << (BITS - p) above
        inside = np.clip((x - low + (1 << (BITS - p)) - 1) >> (BITS - p), 0, 1 << p)
        n += np.where((j >> p) & 1 == 1, inside, 0)
    return n


def stretches(wanted: list[float]) -> list[int]:
    """Where the sources' stretches begin on a line of 1 << BITS, and its end. Whole words, so that sums are exact."""
    whole = [int(t) for t in wanted]
    ends = [0]
    for t in whole:
        ends.append(ends[-1] + t)
    return [(e << BITS) // max(ends[-1], 1) for e in ends]


def block_of(words: int) -> int:
    """Words a block: 4,096, less for mixes of under 2 ** 32 words, so that a mix has about a million slots or more."""
    return max(1, min(4096, words >> 20))


def schedule(spark, wanted: list[float], block: int, slots_a_task: int = 1 << 18) -> DataFrame:
    """slot, no (of the source), rank: of whole blocks that make up the targets."""
    edges, words = np.array(stretches(wanted), np.int64), sum(int(t) for t in wanted)
    slots = -(-words // block)
    if slots >= 1 << BITS:
        raise ValueError(f"{slots} slots; take larger blocks")

    def ranked(batches):
        for b in batches:
            j = b.column(0).to_numpy()
            no = np.searchsorted(edges, reversed_bits(j), side="right") - 1
            rank = points_below(j, edges[no + 1]) - points_below(j, edges[no])
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(no.astype(np.int32)), pa.array(rank)], ["slot", "no", "rank"])

    return spark.range(0, slots, 1, max(1, -(-slots // slots_a_task))).mapInArrow(ranked, "slot long, no int, rank long")


def lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's place on its source's line: rows with no, words (of the source) and at (words before it)."""
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["name"])).drop("name")  # sources: at most MAX_SOURCES
    rows = rows.withColumn("bucket", F.shiftright(share * F.col("buckets"), 32)).drop("buckets")
    buckets = rows.groupBy("no", "bucket").agg(F.sum("size").alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = buckets.groupBy("no", "group").agg(F.sum("n").alias("n")).select("no", "group", ahead(Window.partitionBy("no").orderBy("group")).alias("base"))
    starts = buckets.withColumn("ahead", ahead(Window.partitionBy("no", "group").orderBy("bucket"))).join(groups, ["no", "group"]).select("no", "bucket", (F.col("base") + F.col("ahead")).alias("base"))
    line = Window.partitionBy("no", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, ["no", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(line), F.lit(0))).drop("bucket", "base", "key")


def weighed(docs: DataFrame, epochs: float, most: int) -> tuple[DataFrame, list[float], DataFrame]:
    """Sized documents (a table), targets in the sources' order, and the sources: name, no, words, target, buckets."""
    rows = written(sized(docs), "mix-sizes", compact=True)  # a few dozen bytes a document: the texts are read once
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["words"] for r in found], epochs, most)
    table = [(r["source"], i, r["words"], t, -(-r["n"] // BUCKET)) for i, (r, t) in enumerate(zip(found, wanted, strict=True))]
    return rows, wanted, docs.sparkSession.createDataFrame(table, "name string, no int, words long, target double, buckets long")


def pieces(docs: DataFrame, epochs: float = 1.5, most: int = 2, block: int | None = None) -> DataFrame:
    """All documents, cut at blocks for every walk of their source's line, with the slot that takes the piece, or null: doc_id, source, no, size, words, target, at, place (words before it in the block), start, length, slot. A text without words has one piece of length 0."""
    rows, wanted, sources = weighed(docs, epochs, most)
    block = block or block_of(sum(int(t) for t in wanted))
    size, full = F.col("size"), F.col("size") > 0
    walks = lines(rows, sources).withColumn("walk", F.explode(F.when(full, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(F.array(F.lit(0)))))
    walks = walks.withColumn("begin", F.col("walk") * F.col("words") + F.col("at"))
    whole = lambda c: F.call_function("div", c, F.lit(block))
    cut = walks.withColumn("rank", F.explode(F.when(full, F.sequence(whole(F.col("begin")), whole(F.col("begin") + size - 1))).otherwise(F.array(F.lit(-1).cast("long")))))
    cut = cut.withColumn("start", F.when(full, F.greatest(F.col("rank") * block - F.col("begin"), F.lit(0))).otherwise(0))
    cut = cut.withColumn("length", F.when(full, F.least((F.col("rank") + 1) * block - F.col("begin"), size) - F.col("start")).otherwise(0))
    cut = cut.withColumn("place", F.col("begin") + F.col("start") - F.col("rank") * block)
    return cut.join(schedule(docs.sparkSession, wanted, block), ["no", "rank"], "left").select("doc_id", "source", "no", "size", "words", "target", "at", "place", "start", "length", "slot")


def mix(docs: DataFrame, epochs: float = 1.5, most: int = 2, block: int | None = None) -> DataFrame:
    """What the mix reads, to be sorted by slot and place: slot, place (words before it in the slot), source, doc_id, start and length (words of the text)."""
    return pieces(docs, epochs, most, block).filter("slot is not null").select("slot", "place", "source", "doc_id", "start", "length")


def op12(docs: DataFrame) -> DataFrame:
    got = F.sum(F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(0)).alias("taken")
    rows = pieces(docs).groupBy("no", "at", "doc_id", "size").agg(F.first("words").alias("source_size"), F.first("target").alias("target"), got, F.count("*").alias("times"))
    # texts without words share places: equal rows of theirs come out as often as they are
    again = F.explode(F.when(F.col("size") == 0, F.sequence(F.lit(1).cast("long"), F.col("times"))).otherwise(F.array(F.lit(1).cast("long"))))
    return rows.withColumn("time", again).select("doc_id", "size", "source_size", "target", "taken")
