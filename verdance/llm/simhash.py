"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit for each bit that is set in over half of its shingles' hashes (XXH64, seed 42).
Two fingerprints link if they differ in at most 4 bits. To find links, anchors are laid over the cube of
fingerprints so that every point has one within the covering radius R: two points at distance t then share the
anchor nearest to either within R + t.

One code over all 64 bits with a usable radius would send a fingerprint to thousands of anchors, so the cube is
the product of faces: up to WIDE_FROM fingerprints three, of 21, 21 and 22 bits. Of two fingerprints within 4 bits, at least one face differs by at most its
threshold t = 1, 1, 0 (were all over, they would differ in 2 + 2 + 1 = 5). On the first two faces the code is the
perfect Hamming code of length 15 times all words of the other 6 bits (R = 1, 131,072 anchors); a fingerprint is
replicated to every anchor within R + t = 2 (14 or 22 of them). On the third all words are anchors (R = t = 0). Each
anchor's fingerprints are compared with one another. No link is lost, whatever the data.

Three faces have 4.5 million anchors, so with many more fingerprints each anchor's would crowd. Beyond WIDE_FROM
distinct ones the cube is the product of two faces of 32 bits with t = 2 and 1 (both over: 3 + 2 = 5) and the perfect
code of length 31: 268 million anchors, a fingerprint at 189 of them on average. The links are the same ones.

Only distinct fingerprints are replicated, so a group of exact copies costs one row. Each anchor's comparisons run over numpy
arrays and leave a spanning forest, not all pairs. An anchor with more than `block` fingerprints is split by hash into k
blocks, and every two blocks are compared by a task of their own: the same pairs, in bounded memory.

Null and empty texts have no words: fingerprint zero, linked like any other. Rows with a null id get a component
but never name one (unless all of its ids are null). Repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, text_bytes, trimmed, written
from .components import as_batch, components, forest

SEED = 42
LIMIT = 4
BLOCK = 50_000
#: (first bit, bits, threshold) of each face
FACES = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
WIDE = ((0, 32, 2), (32, 32, 1))
WIDE_FROM = 1 << 28
_PAIR_BITS = 29
_LOW = np.uint64(0x0101010101010101)
_ONE = np.uint64(1)


def shingle_hashes(raw: bytes, width: int = 4) -> np.ndarray:
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
    ends = ends[width - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; eight counters of eight bits run in each word, over blocks of 255."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    out = 0
    for shift in range(8):
        counts = ((padded >> np.uint64(shift)) & _LOW).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * counts[byte] > n:
                out |= 1 << (8 * byte + shift)
    return out


def _fingerprints(batches):
    for b in small(batches):
        fps = np.array([majority(shingle_hashes(raw)) for raw in b.column("raw").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), b.column("tag")], ["doc_id", "fp", "tag"])


def fingerprints(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """doc_id, fp and tag (a long that tells rows of one id apart)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_bytes().alias("raw"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    return rows.mapInArrow(trimmed(_fingerprints), f"doc_id {kind}, fp long, tag long")


def _code_length(bits: int) -> int:
    """Of the perfect Hamming code laid over the low bits of a face."""
    return (1 << (bits + 1).bit_length() - 1) - 1


def _syndrome(words: np.ndarray, length: int) -> np.ndarray:
    """Of the low bits: the XOR of the places (from 1) of the bits that are set; zero for codewords."""
    s = np.zeros(len(words), np.int64)
    for place in range(1, length + 1):
        s ^= np.where((words >> (place - 1)) & 1, place, 0)
    return s


def _near_masks(bits: int, radius: int) -> list[np.ndarray]:
    """By syndrome: what to flip in a face's bits to reach each codeword within the radius."""
    masks = np.array([sum(1 << i for i in flips) for n in range(radius + 1) for flips in combinations(range(bits), n)], np.int64)
    length = _code_length(bits)
    s = _syndrome(masks, length)
    return [masks[s == k] for k in range(length + 1)]


def anchors_of(fps: np.ndarray, faces=FACES) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) for every anchor of every fingerprint (uint64)."""
    out, rows = [], []
    for face, (first, bits, threshold) in enumerate(faces):
        part = ((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        if not threshold:
            out.append(part | (face << 32))
            rows.append(np.arange(len(fps)))
            continue
        near = _near_masks(bits, 1 + threshold)
        s = _syndrome(part, len(near) - 1)
        for k in range(len(near)):
            at = np.flatnonzero(s == k)
            out.append((part[at][:, None] ^ near[k][None, :]).ravel() | (face << 32))
            rows.append(np.repeat(at, len(near[k])))
    return np.concatenate(out), np.concatenate(rows)


def _replicated(faces):
    def run(batches):
        for b in small(batches, 4096):
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            anchor, row = anchors_of(fps.view(np.uint64), faces)
            for at in range(0, len(row), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at : at + 200_000]), pa.array(fps[row[at : at + 200_000]])], ["anchor", "fp"])

    return run


def _links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of equal key (sorted); large groups give a forest found by visiting each row once."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    a, b, bits = [], [], fps.view(np.uint64)
    small = size <= 64
    k, f = key[small], bits[small]
    for shift in range(1, min(64, int(sizes[sizes <= 64].max(initial=0)))):
        near = np.flatnonzero((k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= LIMIT))
        a.append(f[near])
        b.append(f[near + shift])
    for start, n in zip(cuts[:-1][sizes > 64], sizes[sizes > 64], strict=True):
        rest = bits[start : start + n]
        while len(rest):
            wave, rest = [rest[0]], rest[1:]
            root = wave[0]
            while wave and len(rest):
                near = np.bitwise_count(rest ^ wave.pop()) <= LIMIT
                if near.any():
                    found, rest = rest[near], rest[~near]
                    wave.extend(found)
                    a.append(np.full(len(found), root))
                    b.append(found)
    return (np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (np.zeros(0, np.int64),) * 2


def _compared(batches):
    """Rows sorted by key; a key's rows may span batches, so the last key waits for the next batch."""
    held: list[tuple] = []

    def emit(key, fps):
        a, b = _links(key, fps)
        if len(a):
            yield as_batch(*forest(a, b))

    for batch in batches:
        key = batch.column("anchor").to_numpy(zero_copy_only=False) * (1 << _PAIR_BITS) + batch.column("pair").to_numpy(zero_copy_only=False)
        held.append((key, batch.column("fp").to_numpy(zero_copy_only=False)))
        if sum(len(k) for k, _ in held) < 200_000 or held[0][0][0] == key[-1]:
            continue
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        last = np.searchsorted(keys, keys[-1])
        held = [(keys[last:], fps[last:])]
        yield from emit(keys[:last], fps[:last])
    if held:
        yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_pairs(distinct: DataFrame, block: int = BLOCK, faces=FACES) -> DataFrame:
    """(a, b): edges that join the same fingerprints as all links within LIMIT bits. distinct: each fingerprint once, as fp."""
    placed = distinct.mapInArrow(trimmed(_replicated(faces)), "anchor long, fp long")
    full = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    if full.isEmpty():
        placed = placed.withColumn("pair", F.lit(0))
    else:
        cut = full.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("k"))
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.least(F.col("own"), o) * F.col("k") + F.greatest(F.col("own"), o))
        placed = placed.join(cut, "anchor", "left").withColumn("own", F.when(F.col("k").isNotNull(), own))
        placed = placed.select("anchor", "fp", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"))
    dealt = placed.repartition(F.col("anchor"), F.col("pair")).sortWithinPartitions("anchor", "pair")
    return dealt.mapInArrow(trimmed(_compared), "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, best): best names the first row of all that fp reaches, as a struct of (unnamed, id, tag): named ids first, then the least id, then the least tag."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), "tag")).alias("best")
    ids = written(prints.groupBy("fp").agg(best), "fingerprint-ids")
    faces = FACES if ids.count() <= WIDE_FROM else WIDE
    roots = components(near_pairs(ids.select("fp"), faces=faces))
    rooted = written(ids.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "root", "best"), "roots")
    linked = rooted.filter("root is not null")
    # written, so that the join below has plain exchanges on both sides: adaptive execution may split a giant component
    least = written(linked.groupBy("root").agg(F.min("best").alias("least")), "least", compact=True)
    return rooted.filter("root is null").select("fp", "best").unionByName(linked.join(least, "root").select("fp", F.col("least").alias("best")))


def op1(docs: DataFrame) -> DataFrame:
    prints = written(fingerprints(docs), "fingerprints", compact=True)
    named = groups(prints).select(F.col("fp").alias("of"), F.col("best.id").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each group of near-duplicates: that of the least id (rows without an id come last), and of equal ids that of the least hash of all its columns."""
    tag = F.xxhash64(*docs.columns)
    prints = written(fingerprints(docs, tag), "fingerprints", compact=True)
    kept = groups(prints).select("best").distinct().select(F.col("best.id").alias("kept_id"), F.col("best.tag").alias("kept_tag"))
    # rows equal in every column count once; each task keeps one of its own before the texts are shuffled
    rows = docs.select(F.col("doc_id").alias("id"), tag.alias("tag"), F.struct("*").alias("row")).groupBy("id", "tag").agg(F.first("row").alias("row"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag")), "left_semi").select("row.*")
