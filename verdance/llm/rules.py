"""Quality rules by distribution divergence.

Base counts come from one walk over each text. The verdict compares two histograms of a document with references of
its language: character classes, and occurrences of the language's common words. References are sums over all
documents of the language: a first pass counts words and classes per task and merges those counts; the 64 commonest words of
each language become bins (the rest share one). The distance is the root of the Jensen-Shannon divergence to base 2,
so it lies in [0, 1]; a document goes if either distance is over its threshold, but a histogram is looked at only
if the document is long enough for it (`min_chars`, `min_words`). A language with fewer than `min_words_of_language`
words has no reference worth the name and rejects nothing.

Null or empty texts have no words and fail the base rule. Null languages share the reference of "". The number of
languages bounds the references: they reach the driver as one row per language and bin.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_bytes, trimmed

SYMBOLS = b"#*$%&|<>"
COMMON = 64
FLUSH = 400_000
DEFAULTS = {"max_chars_distance": 0.31, "max_words_distance": 0.48, "min_chars": 200, "min_words": 50, "min_words_of_language": 2000}

#: Byte classes: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 sentence marks, 6 symbols, 7 other ASCII, 8 lead bytes of longer characters, 9 their other bytes (not counted).
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[list(b".,;:?'\"-()")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[192:] = 8
_CLASS[128:192] = 9
CLASSES = 9
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)[:CLASSES]


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside a window of 8 that occurs at least twice. Windows are grouped by a hash and compared word by word."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    h = ids.astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(7))) * _MIX
    m = n - window + 1
    mixed, width = h, 1
    while width < window:
        step = np.uint64(pow(0xD1342543DE82EF95, width, 1 << 64))
        mixed = mixed[:-width] * step + mixed[width:]
        width *= 2
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)
    equal = (windows[a] == windows[b]).all(axis=1)
    twice = np.zeros(m, bool)
    twice[a[equal]] = True
    twice[b[equal]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    edge[: m] += twice
    edge[window : window + m] -= twice[: n + 1 - window]
    return int((np.cumsum(edge[:n]) > 0).sum()) if len(starts) else 0


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((joined & 0xC0) != 0x80).sum())
    symbols = int(_IS_SYMBOL[joined].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms; 0 where one is empty."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return 0.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))
    return float(np.sqrt(max(0.0, kl / 2)))


def _counted(batches):
    """(lang, kind, key, n) summed over much of a task: kind 0 has character classes, kind 1 words, kind 2 documents."""
    words: dict[str, Counter] = defaultdict(Counter)
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))
    texts: Counter = Counter()
    held = 0

    def flush():
        rows = [(lang, 1, w, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, 0, b"%d" % i, int(n)) for lang, c in classes.items() for i, n in enumerate(c) if n]
        rows += [(lang, 2, b"", n) for lang, n in texts.items()]
        words.clear()
        classes.clear()
        texts.clear()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        for at in range(0, max(len(rows), 1), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["lang", "kind", "key", "n"])

    for b in small(batches):
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("raw").to_pylist(), strict=True):
            c = words[lang]
            before = len(c)
            c.update(raw.lower().split())
            held += len(c) - before
            classes[lang] += class_counts(raw)
            texts[lang] += 1
            if held > FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def references(docs: DataFrame, common: int = COMMON) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray, int]]:
    """Per language: class histogram, bin of each common word, word histogram (the last bin is for all others), number of words."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), text_bytes().alias("raw"))
    counts = rows.mapInArrow(trimmed(_counted), "lang string, kind int, key binary, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= common)
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("n"))
    # one job for both, so that they share the shuffle of the counts: the texts are walked once
    found = top.select("lang", "kind", "key", "n", "rank").unionByName(totals.select("lang", F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("key"), "n", F.lit(0).alias("rank"))).collect()
    out: dict[str, list] = {r["lang"]: [np.zeros(CLASSES), {}, np.zeros(common + 1), r["n"]] for r in found if r["kind"] == 3}
    for r in found:
        ref = out[r["lang"]]
        if r["kind"] == 0:
            ref[0][int(r["key"])] = r["n"]
        elif r["kind"] == 1:
            ref[1][bytes(r["key"])] = r["rank"] - 1
            ref[2][r["rank"] - 1] = r["n"]
    for ref in out.values():
        ref[2][common] = ref[3] - ref[2][:common].sum()
    return {k: tuple(v) for k, v in out.items()}


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_distance double, words_distance double, kept boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def verdict(lang: str, raw: bytes, refs: dict, limits: dict) -> tuple:
    """The five base counts, base_failed, both distances (0 where not looked at), kept."""
    counts = base_counts(raw)
    n, repeated = counts[0], counts[4]
    failed = n < 20 or 100 * repeated > 30 * n
    chars, bins, words, total = refs[lang]
    d = w = 0.0
    if total >= limits["min_words_of_language"]:
        if counts[1] >= limits["min_chars"]:
            d = distance(class_counts(raw), chars)
        if n >= limits["min_words"]:
            last = len(words) - 1
            w = distance(np.bincount([bins.get(x, last) for x in raw.lower().split()], minlength=last + 1), words)
    return (*counts, failed, d, w, not failed and d <= limits["max_chars_distance"] and w <= limits["max_words_distance"])


def _judged(refs, limits):
    """Batches of (lang, raw, row): row is a struct of what is carried, so no name of it can clash."""

    def run(batches):
        for b in small(batches):
            out = [verdict(lang, raw, refs.value, limits) for lang, raw in zip(b.column("lang").to_pylist(), b.column("raw").to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["row", *NAMES])

    return run


def _kept(refs, limits):
    def run(batches):
        for b in small(batches):
            out = [verdict(lang or "", (text or "").encode(), refs.value, limits)[-1] for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield b.filter(pa.array(out, pa.bool_()))

    return run


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows that the rules keep, with their columns."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs))
    return docs.mapInArrow(trimmed(_kept(refs, DEFAULTS | limits)), docs.schema)


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """The carried columns, whatever their names, and the counts, distances and verdict of every document. A carried column called like an output is an error."""
    if clash := set(carry) & set(NAMES):
        raise ValueError(f"columns of the result have these names: {sorted(clash)}")
    refs = docs.sparkSession.sparkContext.broadcast(references(docs))  # languages x (bins + classes)
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), text_bytes().alias("raw"), F.struct(*carry).alias("row"))
    judged = rows.mapInArrow(trimmed(_judged(refs, DEFAULTS | limits)), f"row {rows.schema['row'].dataType.simpleString()}, {SCHEMA}")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in carry), *NAMES)


def op9(docs: DataFrame) -> DataFrame:
    return judge(docs)
