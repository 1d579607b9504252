"""Best-fit packing with length patterns fitted by non-negative least squares.

Texts become token ids (a byte-level BPE file, then id 0); only documents longer than a sequence are cut, into whole
sequences after a first piece that may be shorter. The plan needs the histogram of piece lengths alone, which has at most
`capacity` numbers: patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat counts
fitted to the histogram by non-negative least squares (accelerated projected gradients) and rounded to what the
histogram still holds; what is left is packed best-fit decreasing, run by run of equal lengths. All of it works on
the histogram, so its cost and the plan's size depend on the capacity, not on the number of documents.

Then every piece gets its rank among those of its length (ranks are counted in salted groups of about `group` pieces, whose
offsets come from a table with a row for each group) and looks its place up in the plan.

Null texts are empty: one piece with id 0. Rows with null ids and repeated rows are packed like any other. Pieces of
equal length are interchangeable; of rows with equal ids and texts either may have either place.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, trimmed, written

CAPACITY = 2048
#: Pieces of one length that one task ranks, about.
GROUP = 1 << 17
PER_LENGTH = 12
STEPS = 400
#: Fixed value: the pattern by which this family of tokenizers splits texts before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLITTERS: dict = {}


class Tokens:
    """Ids of texts as little-endian bytes: those of the `tokenizers` library for the file at path, special tokens in a text included.

    Where the file is a byte-level BPE whose merges lie in the order of their ids, tiktoken merges by those ids: the same
    result (tests hold it against the library on the whole vocabulary), at a third of the time. Any other file, and a text
    too strange for tiktoken's splitting (millions of blanks in a row), goes to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = _by_rank(json.load(f))

    def ids(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # its splitting gave up on this text
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _by_rank(file: dict):
    """A tiktoken encoding of a tokenizer file; None if its rules are not plain byte-level BPE in the order of ids."""
    import tiktoken

    model, split, special = file["model"], file.get("pre_tokenizer") or {}, {t["content"]: t["id"] for t in file["added_tokens"]}
    plain = (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback") and file.get("normalizer") is None
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in file["added_tokens"])
    )
    if not plain:
        return None
    letters, vocab = _byte_letters(), {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocab.get(a + b, -1) for a, b in merges]
    if not all(map(letters.__contains__, set("".join(vocab)))) or order != sorted(set(order)) or min(order, default=0) < 0 or {t for t in vocab if len(t) > 1} != {a + b for a, b in merges}:
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special) if len({t for t in ranks if len(t) == 1}) == 256 else None


def _tokens(path) -> Tokens:
    """path: a file, or a function that names it, called in the task: executors may keep their files elsewhere."""
    path = path() if callable(path) else path
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Tokens(path)
    return _SPLITTERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def _pieces(path, capacity: int):
    def run(batches):
        tokens, lot = _tokens(path), 0
        for b in small(batches, 1024):
            ids = b.column("doc_id")
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text_").to_pylist()):
                raw = tokens.ids(text) + b"\0\0\0\0"
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            lots = pa.array(np.arange(lot, lot + len(row)), pa.int64())
            lot += len(row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), lots],
                ["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
            )

    return run


def pieces(docs: DataFrame, path, capacity: int = CAPACITY) -> DataFrame:
    """Every piece, and its number in its task (lot), by which equal rows can be told apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text_"))
    return rows.mapInArrow(trimmed(_pieces(path, capacity)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, lot long")


def enumerate_patterns(histogram: np.ndarray, capacity: int, per_length: int = PER_LENGTH) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the capacity, of lengths that occur.

    All pairs; and for each longest length, triples whose middle lengths lie evenly among those possible.
    """
    has = histogram > 0
    out = [(capacity, 0, 0)] if has[capacity] else []
    for a in range(capacity - 1, 0, -1):
        if not has[a]:
            continue
        rest = capacity - a
        if rest <= a and has[rest]:
            out.append((a, rest, 0))
        middle = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        middle = middle[has[middle] & has[rest - middle]] if len(middle) else middle
        if len(middle):
            picks = middle[np.unique(np.linspace(0, len(middle) - 1, per_length).astype(int))]
            out.extend((a, int(b), rest - int(b)) for b in picks)
    return np.array(out, np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises the squared distance of the patterns' lengths from the histogram, scaled to its mean."""
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    filled = patterns > 0
    scale = max(1.0, histogram.sum() / max(1, (histogram > 0).sum()))
    target = histogram / scale
    times = lambda x: np.bincount(patterns.ravel(), weights=(x[:, None] * filled).ravel(), minlength=size)
    back = lambda r: (r[patterns] * filled).sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(times(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def pack_histogram(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) that use up the histogram exactly.

    Fitted counts are rounded to the nearest, down, or (for few pieces, where no pattern repeats) to nothing; the plan of fewest sequences stands.
    """
    patterns = enumerate_patterns(histogram, capacity)
    x = fit_counts(patterns, histogram.astype(float))
    plans = [_packed(histogram, capacity, patterns, counts) for counts in (np.round(x), np.floor(x), np.zeros(len(x)))]
    return min(plans, key=lambda plan: sum(count for count, _ in plan))


def _packed(histogram: np.ndarray, capacity: int, patterns: np.ndarray, counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 1:
            break
        lengths = [int(n) for n in patterns[i] if n]
        need = {n: lengths.count(n) for n in lengths}
        repeats = min(int(counts[i]), *(int(left[n]) // k for n, k in need.items()))
        if repeats > 0:
            for n, k in need.items():
                left[n] -= repeats * k
            plan.append((repeats, sorted(need.items(), reverse=True)))
    # best fit decreasing on what is left: open groups of equal sequences by their free space
    free: list[int] = []
    open_: dict[int, list[tuple[int, list]]] = defaultdict(list)

    def put(space: int, count: int, content: list):
        if count:
            if not open_[space]:
                insort(free, space)
            open_[space].append((count, content))

    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            at = bisect_left(free, n)
            if at == len(free):
                space, have, content = capacity, -(-count // (capacity // n)), []
            else:
                space = free[at]
                have, content = open_[space].pop()
                if not open_[space]:
                    free.pop(at)
            fit = space // n
            full = min(have, count // fit)
            put(space - fit * n, full, [*content, (n, fit)])
            count -= full * fit
            have -= full
            if have and count:
                put(space - count * n, 1, [*content, (n, count)])
                have, count = have - 1, 0
            if content:
                put(space, have, content)
    plan += [(count, content) for groups in open_.values() for count, content in groups]
    return plan


def lookup(plan: list) -> dict[str, np.ndarray]:
    """By length and rank: from which rank on, sequence of the first, pieces a sequence, place of the first."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for repeats, content in plan:
        at = 0
        for n, k in content:
            rows.append((n, used[n], sequence, k, at))
            used[n] += repeats * k
            at += n * k
        sequence += repeats
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (cols[:, 0] << 48) | cols[:, 1], "first": cols[:, 1], "sequence": cols[:, 2], "times": cols[:, 3], "at": cols[:, 4]}


def _placed(where):
    def run(batches):
        w = where.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("before_").to_numpy(zero_copy_only=False) + b.column("rank_").to_numpy(zero_copy_only=False) - 1
            i = np.searchsorted(w["key"], (length << 48) | rank, side="right") - 1
            k = rank - w["first"][i]
            sequence = w["sequence"][i] + k // w["times"][i]
            offset = w["at"][i] + k % w["times"][i] * length
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut_up = written(pieces(docs, path, capacity), "pieces", compact=True)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    # a length's pieces are ranked in as many groups as its count asks for, so that no task's share grows with the input
    salts = spark.createDataFrame([(int(n), int(-(-histogram[n] // group))) for n in np.flatnonzero(histogram)], "length long, salts long")
    salt = F.pmod(F.xxhash64("lot", "doc_id", "piece"), F.col("salts")).cast("int")
    salted = cut_up.join(F.broadcast(salts), "length").withColumn("salt_", salt).drop("salts", "lot")
    sizes = salted.groupBy("length", "salt_").agg(F.count("*").alias("n")).collect()  # at most capacity + pieces / group rows
    used = np.zeros(capacity + 1, np.int64)
    offsets = []
    for r in sorted(sizes):
        offsets.append((r["length"], r["salt_"], int(used[r["length"]])))
        used[r["length"]] += r["n"]
    where = spark.sparkContext.broadcast(lookup(pack_histogram(histogram, capacity)))
    before = spark.createDataFrame(offsets, "length long, salt_ int, before_ long")
    ranked = salted.withColumn("rank_", F.row_number().over(Window.partitionBy("length", "salt_").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.join(F.broadcast(before), ["length", "salt_"]).mapInArrow(_placed(where), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_file)
