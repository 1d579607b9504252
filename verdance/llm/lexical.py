"""Ranked lexical search by a threshold-seeded join.

Every document is walked once, and leaves a small index row: its length and how often it has each term of the items.
From the index come the corpus counts, and for each term its largest impacts: the `k`-th lower-bounds the k-th score
of any item that has the term (k documents get that much from it alone), the largest bounds what the term can add.
An item's terms stand in falling order of what they can add; the longest end of that order whose bounds sum to less
than the item's threshold can't carry a document over it, so documents are candidates only by the terms before it, and only
if what these give plus the bound of the rest reaches the threshold. Candidates are scored exactly, over all terms.
Each task raises its thresholds by the k-th score that it has found itself, and keeps its k best documents an item;
those are ranked together. All of it is 64-bit integers but the weights, which are floors of doubles.

Items come in blocks of at most `block_terms` distinct terms an item, summed: a block's vocabulary, items and bounds are what
tasks get, so their size is bounded whatever the number of items; each block walks the texts once.

Null and empty texts have no terms, and no document without terms counts or is found; an item without terms finds
nothing. Repeated rows are documents, or items, of their own. Equal scores go by doc_id, nulls last; rows equal in
both share the ranks in any order. Other columns are ignored. `75 * n * N` must fit 64 bits (n: a document's
terms, N: documents), as in the definition.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_bytes, trimmed, written

#: Fixed values of the score: letters and digits of ASCII and all longer characters make terms, only A-Z lose their case.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK_TERMS = 1 << 17


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM).split()


def _indexed(vocabulary):
    """(id, raw) to (id, n, terms, tfs): rows for documents that have a term, lists only of the items' terms, in rising order."""

    def run(batches):
        number = vocabulary.value.get
        for b in small(batches):
            keep, lengths, lists, times = [], [], [], []
            for i, raw in enumerate(b.column("raw").to_pylist()):
                words = terms(raw)
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                keep.append(i)
                lengths.append(len(words))
                lists.append(sorted(found))
                times.append([found[t] for t in lists[-1]])
            ids = b.column("id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["id", "n", "terms", "tfs"])

    return run


class Weights:
    """Corpus counts as weights, and impacts from them."""

    def __init__(self, documents: int, total: int, df: np.ndarray):
        self.documents, self.total = documents, total
        self.w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def postings(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of index rows, flat: row in the batch, term, impact."""
        lists, tf = b.column("terms"), b.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        m = 25 + (75 * b.column("n").to_numpy(zero_copy_only=False) * self.documents) // max(self.total, 1)
        return row, term, self.w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


def raised(best: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
    """Put values into the k best (falling) of their keys' rows."""
    k = best.shape[1]
    more = value > best[key, k - 1]
    key, value = key[more], value[more]
    if not len(key):
        return
    order = np.lexsort((-value, key))
    key, value = key[order], value[order]
    own, first, at = np.unique(key, return_index=True, return_inverse=True)
    place = np.arange(len(key)) - first[at]
    new = np.zeros((len(own), k), best.dtype)
    new[at[place < k], place[place < k]] = value[place < k]
    best[own] = -np.sort(-np.concatenate([best[own], new], axis=1), axis=1)[:, :k]


def _largest(weights, k):
    """Each term's k largest impacts in a task."""

    def run(batches):
        known = weights.value
        best = np.zeros((len(known.w), k), np.int64)
        for b in batches:
            _, term, impact = known.postings(b)
            raised(best, term, impact)
        term, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(best[term, place])], ["term", "impact"])

    return run


class Items:
    """A block of items: flat entries (item, term, times), each item's in falling order of what they can add, with what it and all after it can add."""

    def __init__(self, counts: list[dict[int, int]], top: np.ndarray, kth: np.ndarray):
        self.n = len(counts)
        item = np.repeat(np.arange(self.n), [len(c) for c in counts])
        term = np.array([t for c in counts for t in c], np.int64)
        times = np.array([n for c in counts for n in c.values()], np.int64)
        most = times * top[term]
        order = np.lexsort((-most, item))
        self.item, self.term, self.times, most = item[order], term[order], times[order], most[order]
        self.start = np.searchsorted(self.item, np.arange(self.n + 1))
        below = np.concatenate([[0], np.cumsum(most)])
        self.rest = below[self.start[self.item + 1]] - below[:-1]
        self.seed = np.zeros(self.n, np.int64)
        np.maximum.at(self.seed, self.item, self.times * kth[self.term])

    def essential(self, threshold: np.ndarray):
        """Entries that a document may be found by, and each item's bound of all others."""
        found = self.rest >= threshold[self.item]
        rest = np.zeros(self.n, np.int64)
        np.maximum.at(rest, self.item[~found], self.rest[~found])
        return found, rest

    def scores(self, item: np.ndarray, row: np.ndarray, posting: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
        """Exact scores of pairs. posting: sorted row * width + term of the batch's impacts."""
        sizes = self.start[item + 1] - self.start[item]
        pair = np.repeat(np.arange(len(item)), sizes)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.start[item][pair]
        wanted = row[pair] * width + self.term[entry]
        at = np.minimum(np.searchsorted(posting, wanted), len(posting) - 1)
        gained = np.where(posting[at] == wanted, impact[at] * self.times[entry], 0)
        return np.add.reduceat(gained, np.cumsum(sizes) - sizes) if len(item) else np.zeros(0, np.int64)


def _ranked(weights, block, k, rows=256):
    """(item, id, score) of a task's k best documents an item, those that reach its seed."""

    def best_of(parts):
        import pandas as pd

        found = pd.concat(parts, ignore_index=True).sort_values(["item", "score", "id"], ascending=[True, False, True], na_position="last", kind="stable")
        return [found.groupby("item", sort=False).head(k)]

    def run(batches):
        import pandas as pd

        known, items = weights.value, block.value
        best, width = np.zeros((items.n, k), np.int64), len(known.w)
        by_term = np.argsort(items.term, kind="stable")
        threshold, parts, held, schema = np.maximum(items.seed, 1), [], 0, None
        for whole in batches:
            schema = whole.schema.field("id").type
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                row, term, impact = known.postings(b)
                found, rest = items.essential(threshold)
                entries = by_term[found[by_term]]
                first = np.searchsorted(items.term[entries], term)
                times = np.searchsorted(items.term[entries], term, side="right") - first
                p = np.repeat(np.arange(len(term)), times)
                if not len(p):
                    continue
                e = entries[np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times) + first[p]]
                pair, where = np.unique(row[p] * items.n + items.item[e], return_inverse=True)
                partial = np.zeros(len(pair), np.int64)
                np.add.at(partial, where, impact[p] * items.times[e])
                item, doc = pair % items.n, pair // items.n
                likely = partial + rest[item] >= threshold[item]
                item, doc = item[likely], doc[likely]
                score = items.scores(item, doc, row * width + term, impact, width)
                reached = score >= threshold[item]
                item, doc, score = item[reached], doc[reached], score[reached]
                raised(best, item, score)
                threshold = np.maximum(threshold, best[:, k - 1])
                parts.append(pd.DataFrame({"item": item, "score": score, "id": b.column("id").take(pa.array(doc)).to_pandas(types_mapper=pd.ArrowDtype)}))
                held += len(item)
                if held > 1 << 16:
                    parts = best_of(parts)
                    held = len(parts[0])
        if held:
            out = best_of(parts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(out["item"].to_numpy(np.int32)), pa.array(out["id"], type=schema), pa.array(out["score"].to_numpy(np.int64))], ["item", "id", "score"])

    return run


def _searched(docs: DataFrame, ids: list, counts: list[Counter], item_type: str, k: int) -> DataFrame:
    """(item_id, rank, id, score) of one block of items."""
    sc = docs.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    kind = docs.schema["id"].dataType.simpleString()
    index = written(docs.mapInArrow(trimmed(_indexed(sc.broadcast(vocabulary))), f"id {kind}, n long, terms array<int>, tfs array<int>"), "lexical-index", compact=True)
    documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, top, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[r["term"]] = r["count"]
    weights = sc.broadcast(Weights(documents, total, df))
    best = Window.partitionBy("term").orderBy(F.desc("impact"))
    stored = index.mapInArrow(_largest(weights, k), "term int, impact long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    for r in stored.groupBy("term").agg(F.max("impact").alias("top"), F.min("impact").alias("kth"), F.count("*").alias("n")).collect():  # likewise
        top[r["term"]], kth[r["term"]] = r["top"], r["kth"] if r["n"] == k else 0
    block = sc.broadcast(Items([{vocabulary[t]: n for t, n in c.items()} for c in counts], top, kth))
    found = index.mapInArrow(trimmed(_ranked(weights, block, k)), f"item int, id {kind}, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_type}")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")  # names: as many as the block has items


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    rows = docs.select(F.col(doc_id).alias("id"), text_bytes(text).alias("raw"))
    kind, parts, ids, counts, held = items.schema[item_id].dataType.simpleString(), [], [], [], 0
    for r in items.select(F.col(item_id).alias("id"), text_bytes(text).alias("raw")).toLocalIterator():  # the driver holds one block
        c = Counter(terms(bytes(r["raw"])))
        if c:
            ids.append(r["id"])
            counts.append(c)
            held += len(c)
        if held >= block_terms:
            parts.append(written(_searched(rows, ids, counts, kind, k), "lexical-ranks"))
            ids, counts, held = [], [], 0
    if counts or not parts:
        parts.append(_searched(rows, ids, counts, kind, k) if counts else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, id {rows.schema['id'].dataType.simpleString()}, score long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "rank", F.col("id").alias(doc_id), "score")


def op11(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)
