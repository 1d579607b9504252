"""SentencePiece encoding and decoding by suffix-array matching.

A model's pieces are found in text without a trie: the distinct units of a batch (runs of the blank mark with what follows
them; no piece has the mark after another character) are concatenated and indexed by a suffix array as deep as the longest
piece; every piece's occurrences are one range of it, found by binary search. The occurrences are the edges of a
lattice; sorted by where they end, they are relaxed one after the other. For a model with merges (BPE), the piece that ends
the encoding of a prefix is the one edge whose last merge is compatible with the piece before it, that is, whose two
pieces stay apart when merged alone; so relaxing keeps one edge per position and gives the merges' result. (Pairs are
tried once and remembered.) Characters outside the vocabulary become byte pieces and never merge.

Decoding concatenates the pieces' bytes, turns marks into blanks and drops the leading one.

Null texts stay null; empty texts have no ids. Batches are bounded by Arrow's; units are remembered up to a bound.
Texts in which the mark U+2581 itself occurs decode to blanks there, as the model's own decoder does. Other columns
pass through the general form.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

MARK = "▁"
SEPARATOR = 0xFFFE  # no character
CACHE = 300_000
PART = 60_000
CHUNK = 1 << 22
_MODELS: dict = {}


class Model:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i)}
        self.piece = [m.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if m.is_byte(i):
                self.byte[int(self.piece[i][3:5], 16)] = i
        self.score = {self.piece[i]: m.get_score(i) for i in range(n) if i not in special}
        self.id = {self.piece[i]: i for i in range(n) if i not in special}
        chars = sorted({c for p in self.id for c in p})
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        self.longest = max(map(len, self.id))
        self.known = {c for c in chars if c in self.id}
        # pieces that merging can't reach never end an encoding
        usable = [p for p in self.id if all(c in self.known for c in p) and self.merge(p) == [p]]
        usable.sort()
        self.usable, self.usable_ids = usable, np.array([self.id[p] for p in usable])
        self.lens = np.array([len(p) for p in usable])
        self.codes = np.zeros((len(usable), self.longest), np.uint16)
        for k, p in enumerate(usable):
            self.codes[k, : len(p)] = [self.code[c] for c in p]
        self.pair_keys, self.pair_apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.table = np.zeros(0x110000, np.uint16)
        for c in self.known:
            self.table[ord(c)] = self.code[c]
        self.table[SEPARATOR] = SEPARATOR
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if i in special and p.startswith("<0x") else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]

    def merge(self, text: str) -> list[str]:
        """Merging proper, for short texts: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces apart."""
        keys = a * len(self.piece) + b
        at = np.searchsorted(self.pair_keys, keys)
        missing = np.ones(len(keys), bool) if not len(self.pair_keys) else self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] != keys
        if missing.any():
            new = np.unique(keys[missing])
            pairs = [(self.piece[k // len(self.piece)], self.piece[k % len(self.piece)]) for k in new.tolist()]
            told = np.array([self.merge(x + y) == [x, y] for x, y in pairs])
            all_keys = np.concatenate([self.pair_keys, new])
            order = np.argsort(all_keys, kind="stable")
            self.pair_keys, self.pair_apart = all_keys[order], np.concatenate([self.pair_apart, told])[order]
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_apart[at]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, piece) of every occurrence of every piece in the indexed text.

        Characters are numbered anew among those that occur (0: none), in one byte where that does; pieces with other characters can't occur.
        """
        depth = self.longest
        present = np.unique(codes)
        present = present[present != SEPARATOR]
        kind, top = (np.dtype(np.uint8), 0xFF) if len(present) < 0xFE else (np.dtype(">u2"), 0xFFFF)
        number = np.zeros(0x10000, np.int64)
        number[present] = np.arange(1, len(present) + 1)
        number[SEPARATOR] = top - 1
        text = np.append(number[codes], np.zeros(depth, np.int64)).astype(kind)
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[: len(codes)]).view(f"S{kind.itemsize * depth}").ravel()
        array = np.argsort(keys, kind="stable")
        ordered = keys[array]
        low = np.where(self.codes > 0, number[self.codes], 0)
        can = np.flatnonzero(((low > 0) == (self.codes > 0)).all(axis=1))
        low = low[can]
        high = np.where(self.codes[can] > 0, low, top)
        as_keys = lambda m: np.ascontiguousarray(m.astype(kind)).view(keys.dtype).ravel()
        first, last = np.searchsorted(ordered, as_keys(low), "left"), np.searchsorted(ordered, as_keys(high), "right")
        count = last - first
        piece = np.repeat(can, count)
        start = array[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        return start + self.lens[piece], start, self.usable_ids[piece]

    def _lattice(self, parts: list[str]) -> list[bytes]:
        """Ids of runs of known characters. All runs advance together: edges are relaxed in order of how far from its run's start they end."""
        codes = self.table[np.frombuffer(chr(SEPARATOR).join(parts).encode("utf-32-le"), np.uint32)]
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lens + 1) - lens - 1
        end, start, piece = self.edges(codes)
        far = end - np.repeat(starts, lens + 1)[start]
        far = far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far
        order = np.argsort(far, kind="stable")
        end, start, piece, far = end[order], start[order], piece[order], far[order]
        best = np.full(len(codes) + 2, -1)
        back = np.zeros(len(codes) + 2, np.int64)
        # a position that ends a run and one that starts the next differ by the separator, so marks don't collide
        best[starts] = -2
        cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]])) if len(far) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            before = best[start[i:j]]
            at = np.flatnonzero(before != -1)
            old = before[at] >= 0
            ok = ~old
            ok[old] = self.apart(before[at[old]], piece[i:j][at[old]])
            at = at[ok] + i
            best[end[at]], back[end[at]] = piece[at], start[at]
        steps, place, run = [], starts + lens, np.arange(len(parts))
        counts = np.zeros(len(parts), np.int64)
        while len(run):
            steps.append((run, best[place]))
            counts[run] += 1
            place = back[place]
            more = place > starts[run]
            run, place = run[more], place[more]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), "<u4")
        for k, (run, ids) in enumerate(steps):  # from each run's last piece to its first
            flat[ends[run] - 1 - k] = ids
        blob, at = flat.tobytes(), (4 * ends).tolist()
        return [blob[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _learn(self, units: list[str]) -> None:
        """Encode units: runs of known characters through the lattice, other characters as bytes."""
        known = self.known
        odd = {u: ["".join(g) for _, g in itertools.groupby(u, known.__contains__)] for u in units if not known.issuperset(u)}
        runs = list({*(u for u in units if u not in odd), *(r for rs in odd.values() for r in rs if r[0] in known)})
        done = dict(zip(runs, self._lattice(runs), strict=True)) if runs else {}
        for u in units:
            split = odd.get(u)
            self.units[u] = done[u] if split is None else b"".join([done[r] if r[0] in known else self.byte[list(r.encode())].astype("<u4").tobytes() for r in split])

    _split = staticmethod(regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. About a megabyte of text is split at a time."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if len(self.units) > CACHE:
                self.units, self.older = {}, self.units
            split = [self._split(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at:end]]
            new = set(itertools.chain.from_iterable(split)) - self.units.keys()
            kept = [u for u in new if u in self.older]
            self.units.update(zip(kept, map(self.older.get, kept), strict=True))
            new = list(new.difference(kept))
            for i in range(0, len(new), PART):
                self._learn(new[i : i + PART])
            of = self.units.__getitem__
            out += [b"".join(map(of, s)) for s in split]
            at = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def model(path) -> Model:
    """path: a file, or a function that names it, called in the task: executors may keep their files elsewhere."""
    path = path() if callable(path) else path
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _encoded(path):
    def run(batches):
        m = model(path)
        for b in small(batches, 2048):
            texts = b.column("of").to_pylist()
            ids = iter(m.encode([t for t in texts if t is not None]))
            out = pa.array([None if t is None else np.frombuffer(next(ids), np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("row"), out], ["row", "out"])

    return run


def _decoded(path):
    def run(batches):
        m = model(path)
        for b in small(batches, 2048):
            out = pa.array([None if x is None else m.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("of").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), out], ["row", "out"])

    return run


def _beside(df: DataFrame, run, of: str, carry: list[str], name: str, kind: str) -> DataFrame:
    """The carried columns (inside a struct meanwhile, so that no name of theirs matters) and one new column."""
    if name in carry:
        raise ValueError(f"the result has a column called {name}")
    rows = df.select(F.col(of).alias("of"), F.struct(*carry).alias("row"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, out {kind}")
    return done.select(*(F.col("row").getField(c).alias(c) for c in carry), F.col("out").alias(name))


def encode(df: DataFrame, path, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and ids (array<int>); a carried column called ids is an error."""
    return _beside(df, _encoded(path), text, carry, "ids", "array<int>")


def decode(df: DataFrame, path, carry: list[str], ids: str = "ids") -> DataFrame:
    """The carried columns and decoded (string); a carried column called decoded is an error."""
    return _beside(df, _decoded(path), ids, carry, "decoded", "string")


def _digest(path):
    def run(batches):
        m = model(path)
        for b in small(batches, 2048):
            raws = [t or "" for t in b.column("text_").to_pylist()]
            ids = m.encode(raws)
            back = [m.decode(np.frombuffer(x, np.int32)) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([len(x) for x in back], pa.int64()), pa.array([x == t.encode() for x, t in zip(back, raws, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_bytes", "round_trip"],
            )

    return run


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_bytes and whether decoding gave the text back."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("text_"))
    return rows.mapInArrow(_digest(model_file), f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_bytes long, round_trip boolean")
