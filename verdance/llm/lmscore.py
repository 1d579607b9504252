"""Language-model scores from a probabilistic suffix tree over words.

The base score is that of a unigram model with one added to every count. The tree's symbols are the tokens themselves
(lower-cased words, then an end mark; unseen words share one symbol), its contexts the last 0 to DEPTH tokens; a text
starts after DEPTH start marks, which are contexts only. The root is the base distribution. Candidates are all contexts
seen at least LEAST times in training, whatever the size of the corpus. A candidate's distribution is the mean of what
followed it and of its longest retained suffix's distribution, so each sums to one:

    P(w | s) = count(s w) / (2 count(s)) + P(w | suffix of s) / 2

It is retained if the two diverge (Kullback-Leibler) by at least MIN_DIVERGENCE bits; for this test alone suffix
probabilities are rounded to a fifth of a bit, so that one byte carries them. A score takes, for every token, the
longest retained suffix of what precedes it.

The tree is never in one place. Texts are dealt to batches of about `batch_mb` in chunks of neighbouring rows, by a hash of the
chunk's place in the input (equal rows spread like others); one shuffle of the compressed chunks serves all steps. In step 0 a batch asks the buckets of its words for
their counts; in step d it asks about the strings of d + 1 tokens whose first d have LEAST occurrences. What a batch can
tell by itself is not asked: buckets also say which strings other batches have (in any text, held out or not), and a longer
string that contains one that is here alone is here alone. Buckets add up the counts of a context's followers, test its divergence, and answer with the
other batches' counts and one bit a context. A context with more than `hot` occurrences (and so perhaps a follower list without
bound) is dealt to several buckets by its followers; their shares of the divergence are added up and the contexts that pass
(at most MOST_HOT of them, as `hot` rises with the corpus) come back as one row. Answers that a later step needs travel through the
buckets as a compressed state of each batch. `Model` is the same model in plain dictionaries, for small
corpora; tests hold the two together.

Words are compared by 56 bits of their hashes, contexts by 48 bits of theirs, followers of one context by 24, 32 or 40 bits,
more the more often the context occurs. Null texts are empty: one
token, the end. Null ids hash as the empty string. Repeated rows count each. With no training rows all counts are zero.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_count, fold, slices, small, trimmed, trimmed_group

DEPTH = 2
LEAST = 2
MIN_DIVERGENCE = 0.1
BATCH_MB = 11
HOT = 1 << 20
MOST_HOT = 10_000
END = b"\n"
#: The start marks, the one before the first token first: no word holds a line end.
STARTS = [END * (k + 2) for k in range(DEPTH)]
_NAMES = np.array([xxhash.xxh64_intdigest(END), *(xxhash.xxh64_intdigest(s) for s in STARTS)], np.uint64)
#: Bytes of text in one chunk, about.
CHUNK = 1 << 18
#: Contexts seen fewer times than these tell their followers apart by 24 and by 32 bits.
RARE, SMALL = 64, 4096
#: Bits of a hash that are left out where words and contexts are named.
_WORD, _CONTEXT = 8, 16
_STEP = 5  # parts of a bit to which the test rounds


def tokens(raw: bytes) -> list[bytes]:
    return [*raw.lower().split(), END]


def rounded(p: np.ndarray) -> np.ndarray:
    """Parts of a bit, in one byte."""
    return np.clip(np.round(-_STEP * np.log2(p)), 0, 255).astype(np.uint8)


def divergence_parts(c: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of followers seen c > 0 times after a context seen n times, q being their rounded suffix probabilities. The divergence is sum(a) - (1 - sum(b)) / 2."""
    below = np.exp2(-q.astype(np.float64) / _STEP)
    p = c / (2 * n) + below / 2
    return p * np.log2(p / below), below


class Model:
    """The same tree in dictionaries: log10 probability of token lists."""

    def __init__(self, train: list[list[bytes]], depth: int = DEPTH, least: int = LEAST, min_divergence: float = MIN_DIVERGENCE):
        self.depth, self.words = depth, Counter(w for t in train for w in t)
        self.total = sum(self.words.values()) + len(self.words) + 1
        self.after: dict[tuple, Counter] = {}
        for t in train:
            padded = [*STARTS[:depth][::-1], *t]
            for i in range(depth, len(padded)):
                for d in range(1, depth + 1):
                    self.after.setdefault(tuple(padded[i - d : i]), Counter())[padded[i]] += 1
        self.kept: set[tuple] = set()
        for d in range(1, depth + 1):  # a test needs the suffixes' distributions, which are shorter
            passed = []
            for s, follow in self.after.items():
                n = sum(follow.values())
                if len(s) != d or n < least:
                    continue
                q = rounded(np.array([self.probability(s[1:], w) for w in follow]))
                a, b = divergence_parts(np.array(list(follow.values())), np.full(len(follow), n), q)
                if a.sum() - (1 - b.sum()) / 2 >= min_divergence:
                    passed.append(s)
            self.kept.update(passed)

    def probability(self, s: tuple, w: bytes) -> float:
        """Of w after s: by the longest retained suffix of s."""
        if not s:
            return (self.words[w] + 1) / self.total
        below = self.probability(s[1:], w)
        if s not in self.kept:
            return below
        follow = self.after[s]
        return follow[w] / (2 * sum(follow.values())) + below / 2

    def score(self, t: list[bytes]) -> float:
        padded = [*STARTS[: self.depth][::-1], *t]
        return float(sum(np.log10(self.probability(tuple(padded[i - self.depth : i]), padded[i])) for i in range(self.depth, len(padded))))


# ---- messages ----

ASK = "route int, batch int, kind int, contexts int, entries int, body binary"
ANSWER = "route int, batch int, kind int, body binary"
_COLD, _HOT, _STATE = 0, 1, 2
_CODEC = pa.Codec("zstd", compression_level=3)
_TYPES = {"int": pa.int32(), "binary": pa.binary()}


def _as_table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, _TYPES[kind]) for c, (name, kind) in zip(cols, fields, strict=True)})


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all lowest bytes first: sorted keys and small counts then compress well."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Unsigned columns in so many bytes each, compressed; `_unpack` has to know the lengths."""
    return _CODEC.compress(b"".join(_planes(x, width) for x, width in columns), asbytes=True)


def _unpack(blob: bytes, *shape: tuple[int, int]) -> list[np.ndarray]:
    """shape: (length, width) of each column."""
    raw = pa.decompress(blob, decompressed_size=sum(n * w for n, w in shape), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, w in shape:
        out.append(_column(raw, at, n, w))
        at += n * w
    return out


def _column(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    x = np.zeros((n, 8), np.uint8)
    if n * width:
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return x.view("<u8").ravel()


def _steps(sorted_keys: np.ndarray, less: int) -> np.ndarray:
    """Each key's distance from the one before it, without that many low bits."""
    return np.diff(sorted_keys >> np.uint64(less), prepend=np.uint64(0))


def _keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _followers(h: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words in order of their hashes inside contexts (entries ends[i] to ends[i + 1], seen n times): the high bits, each as its distance from the one before it."""
    f = h >> np.select([n < RARE, n < SMALL], [np.uint64(40), np.uint64(32)], np.uint64(24))
    out = np.diff(f, prepend=np.uint64(0))
    first = ends[:-1][ends[:-1] < ends[1:]]
    out[first] = f[first]
    return out


def _unstepped(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.uint64)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat(total[first] - steps[first], sizes[sizes > 0])


def _route(h: np.ndarray, routes: int) -> np.ndarray:
    """Ranges of the high bits: rising with h."""
    return (((h >> np.uint64(32)) * np.uint64(routes)) >> np.uint64(32)).astype(np.int64)


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h ^ (w * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    s = keys[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return s[fresh], inverse


# ---- batches ----


class Level:
    """Distinct strings of d + 1 tokens of a batch, in the order of their contexts' hashes, then of their last words' hashes."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, context: np.ndarray, word: np.ndarray, suffix: np.ndarray, local: np.ndarray):
        self.at = at  # positions that have such a string, whose context has LEAST occurrences
        self.ids = ids  # the string that ends at each position, -1 elsewhere
        self.context, self.word, self.suffix = context, word, suffix  # by string: strings of d tokens (before the word, ending with it), the word
        self.local = local  # training occurrences in this batch
        self.count = local  # in all batches, once known
        self.shared = np.ones(len(local), bool)  # with other batches, in any of their texts; strings without training occurrences need not say
        self.name = np.zeros(0, np.uint64)  # hash, by which the next level knows it as a context
        self.kept = np.zeros(0, bool)  # by context: retained
        self.p = np.zeros(0)  # of the word after the context's longest retained suffix


def _chunked(batches_of: int):
    """Rows as compressed chunks, each with its batch."""
    import io

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for b in small(batches, 1024):
            # what tokens don't depend on goes: case, and which white space it is
            plain = pc.replace_substring_regex(pc.ascii_lower(b.column("text")), r"[\t-\r ]+", " ")
            b = b.set_column(b.schema.get_field_index("text"), "text", plain)
            at = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)) // CHUNK
            rows = []
            for _, i, j in slices(at):
                part = b.slice(i, j - i)
                with pa.ipc.new_stream(buffer := io.BytesIO(), part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
                    out.write_batch(part)
                rows.append((xxhash.xxh64_intdigest(f"{task}|{number}") % batches_of, buffer.getvalue()))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["batch", "chunk"])

    return run


def _opened(chunks: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in chunks.column("chunk").to_pylist()]).combine_chunks()


class Batch:
    """Texts as one array of word numbers (places among the sorted hashes), start marks before each."""

    def __init__(self, texts: pa.Table):
        col = texts.column("text").combine_chunks()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(col))
        values, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(values), 0)
        owner = owner[full.to_numpy(zero_copy_only=False)]
        coded = values.filter(full).dictionary_encode()
        digest = xxhash.xxh64_intdigest
        names = np.array([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        self.train = texts.column("train").to_numpy(zero_copy_only=False).astype(bool)
        self.words, number = _distinct(np.concatenate([_NAMES, names]))
        k = np.bincount(owner, minlength=len(col)).astype(np.int64)
        self.size = k + 1  # tokens of each text
        starts = np.cumsum(self.size + DEPTH) - self.size - DEPTH
        x = np.empty(int((self.size + DEPTH).sum()), np.int64)
        for j in range(DEPTH):
            x[starts + j] = number[DEPTH - j]
        x[starts + DEPTH + k] = number[0]
        first = np.cumsum(k) - k
        x[starts[owner] + DEPTH + np.arange(len(owner)) - first[owner]] = number[len(_NAMES) + coded.indices.to_numpy(zero_copy_only=False)]
        self.place = (np.arange(len(x)) - np.repeat(starts, self.size + DEPTH)).astype(np.int32)  # in its text
        self.own = np.repeat(self.train, self.size + DEPTH)
        self.token = self.place >= DEPTH
        zero = np.zeros(len(self.words), np.int64)
        local = np.bincount(x[self.own], minlength=len(self.words))
        self.levels = [Level(np.zeros(0, np.int64), x.astype(np.int32), zero, np.arange(len(self.words)), zero, local)]
        self.levels[0].name = self.words

    def counted(self, count: np.ndarray, shared: np.ndarray, total: int) -> None:
        """Counts of the words in all batches, whether others have them, and the root's total."""
        self.levels[0].count, self.levels[0].shared, self.total = count, shared.astype(bool), total
        self.levels[0].p = (count + 1) / total

    def grow(self) -> Level:
        """The next level: strings whose context has LEAST occurrences."""
        d, below = len(self.levels), self.levels[-1]
        at = np.flatnonzero(self.place >= d)
        before = below.ids[at - 1]
        ok = before >= 0
        ok[ok] = below.count[before[ok]] >= LEAST
        at, before = at[ok], before[ok]
        rank = np.empty(len(below.name), np.int64)
        order = np.argsort(below.name)
        rank[order] = np.arange(len(order))
        words = len(self.words)
        keys, inverse = _distinct(rank[before] * words + self.levels[0].ids[at])
        ids = np.full(len(self.place), -1, np.int32)
        ids[at] = inverse
        suffix = np.empty(len(keys), np.int64)
        suffix[inverse] = below.ids[at]  # defined: a context with LEAST occurrences ends in one
        new = Level(at, ids, order[keys // words], keys % words, suffix, np.bincount(inverse[self.own[at]], minlength=len(keys)))
        new.name = _mix(below.name[new.context], self.words[new.word])
        self.levels.append(new)
        return new

    def questions(self, hot: int) -> tuple[list, np.ndarray]:
        """What the newest level has to ask: for cold and for hot contexts (kind, contexts, their shares a and b of the divergence that are known here, entries' strings, entries' contexts); and every string's rounded suffix probability. Contexts that occur here only are settled."""
        new, below = self.levels[-1], self.levels[-2]
        n = below.count[new.context]
        q = rounded(below.p[new.suffix])
        elsewhere = below.shared[new.context]
        open_ = elsewhere & below.shared[new.suffix] & (below.count[new.suffix] > 0)
        known = ~open_ & (new.local > 0)
        a, b = np.zeros(len(n)), np.zeros(len(n))
        a[known], b[known] = divergence_parts(new.local[known], n[known], q[known])
        first = np.flatnonzero(np.concatenate([[True], new.context[1:] != new.context[:-1]])[: len(n)])
        new.kept = np.zeros(len(below.name), bool)
        if not len(first):
            return [], q
        head = new.context[first]
        a, b = np.add.reduceat(a, first), np.add.reduceat(b, first)
        settled = ~elsewhere[first]
        new.kept[head[settled]] = (a - (1 - b) / 2 >= MIN_DIVERGENCE)[settled]
        many = below.count[head] > hot
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
        out = []
        for kind, mine in ((_COLD, ~settled & ~many), (_HOT, ~settled & many)):
            entries = np.flatnonzero(open_ & mine[group])
            out.append((kind, np.flatnonzero(mine), entries, group[entries]))
        return [(kind, head[g], a[g], b[g], entries, np.searchsorted(g, owner)) for kind, g, entries, owner in out], q

    def asked(self, hot: int, routes: int):
        """(kind, route, contexts, entries, body, entries' strings, contexts) of each message, in an order that only the batch's words and the counts decide."""
        found, q = self.questions(hot)
        new, below = self.levels[-1], self.levels[-2]
        for kind, head, a, b, entries, owner in found:
            name, n, follower = below.name[head], below.count[head], self.words[new.word[entries]]
            key, of = name, np.arange(len(head))
            if kind == _HOT and len(head):
                # each slice of a context that has entries, and slice 0 in any case: it carries what is known already
                cut = -(-n // hot)
                piece = (follower % cut[owner].astype(np.uint64)).astype(np.int64)
                pairs, owner = _distinct(np.concatenate([owner * (1 << 32) + piece, np.arange(len(head)) * (1 << 32)]))
                of, owner = pairs >> 32, owner[: len(entries)]
                key = _mix(name[of], (pairs & 0xFFFFFFFF).astype(np.uint64) + np.uint64(1))
                lead = (pairs & 0xFFFFFFFF) == 0
                a, b = np.where(lead, a[of], 0), np.where(lead, b[of], 0)
                by = np.argsort(key)
                back = np.empty(len(by), np.int64)
                back[by] = np.arange(len(by))
                key, of, a, b, owner = key[by], of[by], a[by], b[by], back[owner]
                by = np.lexsort((follower, owner))
                entries, follower, owner = entries[by], follower[by], owner[by]
            ends = np.searchsorted(owner, np.arange(len(key) + 1))
            for route, i, j in slices(_route(key, routes)):
                e = slice(ends[i], ends[j])
                here = ends[i : j + 1] - ends[i]
                steps = _followers(follower[e], np.repeat(n[of[i:j]], np.diff(here)), here)
                share = (a[i:j] + b[i:j] / 2).astype("<f4").view("<u4") >> np.uint32(8)  # 16 bits of precision
                seen = n[of[i:j]] if kind == _HOT else below.local[head[of[i:j]]]  # a bucket hears of every occurrence of a cold context
                body = _pack((_steps(key[i:j], _CONTEXT), 6), (name[of[i:j]], 8 * (kind == _HOT)), (seen, 6), (np.diff(here), 4), (share, 3), (steps, 5), (new.local[entries[e]], 5), (q[entries[e]], 1))
                yield kind, route, j - i, e.stop - e.start, body, entries[e], head[of[i:j]]

    def heard(self, answers: dict[tuple[int, int], bytes], kept_hot: np.ndarray, hot: int, routes: int) -> None:
        """Counts and retained contexts of the newest level, from the buckets' answers."""
        new = self.levels[-1]
        new.count, new.shared = new.local.copy(), np.zeros(len(new.local), bool)
        for kind, route, contexts, entries, _, strings, heads in self.asked(hot, routes):
            count, shared, kept = _unpack(answers[kind, route], (entries, 6), (entries, 1), (contexts, 1))
            new.count[strings] += count.astype(np.int64)  # those of other batches
            new.shared[strings] = shared.astype(bool)
            if kind == _COLD:
                new.kept[heads] = kept.astype(bool)
            else:
                new.kept[heads] = np.isin(self.levels[-2].name[heads], kept_hot)
        self.finish()

    def finish(self) -> None:
        new, below = self.levels[-1], self.levels[-2]
        p = below.p[new.suffix]
        n = np.maximum(below.count[new.context], 1)
        new.p = np.where(new.kept[new.context], new.count / (2 * n) + p / 2, p)

    def state(self) -> bytes:
        """What is known so far: the total, and of each level counts, what is shared and retained contexts; its unpacked size goes before it."""
        others = lambda level: [(level.count - level.local, 6), (level.shared, 1)]
        columns = [(np.array([self.total]), 8), *others(self.levels[0])]
        for level in self.levels[1:]:
            columns += [*others(level), (level.kept, 1)]
        return sum(len(x) * width for x, width in columns).to_bytes(8, "little") + _pack(*columns)

    def restore(self, blob: bytes, grown: int) -> None:
        """The levels up to `grown` as they were when the state was packed; lengths follow from the counts before them."""
        raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        at = 0

        def take(n: int, width: int) -> np.ndarray:
            nonlocal at
            at += n * width
            return _column(raw, at - n * width, n, width).astype(np.int64)

        total = int(take(1, 8)[0])
        self.counted(self.levels[0].local + take(len(self.words), 6), take(len(self.words), 1), total)
        for _ in range(grown):
            new = self.grow()
            new.count, new.shared = new.local + take(len(new.local), 6), take(len(new.local), 1).astype(bool)
            new.kept = take(len(self.levels[-2].name), 1).astype(bool)
            self.finish()

    def hot(self, hot: int) -> int:
        """From how many occurrences on a context is dealt by its followers: so that at most MOST_HOT a level are."""
        return max(hot, self.total // MOST_HOT)

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: known tokens, base score, score (log10)."""
        p = self.levels[0].p[self.levels[0].ids]
        for level in self.levels[1:]:
            p[level.at] = level.p[level.ids[level.at]]
        first = np.cumsum(self.size) - self.size
        word = self.levels[0].ids[self.token]
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  (each text has at least its end mark)
        return add((self.levels[0].count[word] > 0).astype(np.int64)), add(np.log10(self.levels[0].p)[word]), add(np.log10(p[self.token]))


# ---- words ----


def _ask_words(routes: int):
    def run(key, texts):
        batch = Batch(_opened(texts))
        h, n = batch.words, batch.levels[0].local
        rows = [(r, key[0].as_py(), _COLD, 0, j - i, _pack((_steps(h[i:j], _WORD), 7), (n[i:j], 6))) for r, i, j in slices(_route(h, routes))]
        return _as_table(rows, ASK)

    return run


def _words_added(asked: pa.Table):
    parts = [_unpack(x, (n, 7), (n, 6)) for x, n in zip(asked.column("body").to_pylist(), asked.column("entries").to_pylist(), strict=True)]
    parts = [(_keys(steps), n) for steps, n in parts]
    h, inverse = _distinct(np.concatenate([p[0] for p in parts]))
    n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(h)).astype(np.int64)
    return parts, h, n, inverse


def _answer_words(key, asked):
    parts, _, n, inverse = _words_added(asked)
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    shared = np.bincount(inverse) > 1  # a batch names a word once
    rows = [(key[0].as_py(), b, _COLD, _pack((n[inverse[i:j]], 6), (shared[inverse[i:j]], 1))) for b, i, j in zip(asked.column("batch").to_pylist(), ends, ends[1:], strict=False)]
    return _as_table(rows, ANSWER)


def _totals(key, asked):
    _, h, n, _ = _words_added(asked)
    n = n[~np.isin(h, _NAMES[1:] >> np.uint64(_WORD))]  # start marks are no tokens
    return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "kinds": pa.array([int((n > 0).sum())], pa.int64())})


# ---- contexts ----


def _ask_contexts(level: int, routes: int, hot: int):
    """Level 1 hears of the words, later ones of the level before; each sends its state along."""

    def run(key, texts, answers):
        batch = Batch(_opened(texts))
        _hear(batch, level - 1, answers, routes, hot)
        batch.grow()
        number = key[0].as_py()
        rows = [(route, number, kind, contexts, entries, body) for kind, route, contexts, entries, body, _, _ in batch.asked(batch.hot(hot), routes)]
        batch.levels.pop()
        return _as_table([*rows, (number % routes, number, _STATE, 0, 0, batch.state())], ASK)

    return run


def _hear(batch: Batch, level: int, answers: pa.Table, routes: int, hot: int) -> None:
    """Put a batch in the state that the answers about this level leave."""
    rows = answers.to_pylist()
    if level == 0:
        parts = {r["route"]: r["body"] for r in rows}
        h = batch.words
        count, shared = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for r, i, j in slices(_route(h, routes)):
            count[i:j], shared[i:j] = _unpack(parts[r], (j - i, 6), (j - i, 1))
        batch.counted(count, shared, rows[0]["tokens"] + rows[0]["kinds"] + 1)
        return
    state = next(r for r in rows if r["kind"] == _STATE)
    batch.restore(state["body"], level - 1)
    batch.grow()
    kept = np.array(state["kept_hot"], np.int64).view(np.uint64)
    batch.heard({(r["kind"], r["route"]): r["body"] for r in rows if r["kind"] != _STATE}, kept, batch.hot(hot), routes)


def _contexts_added(rows: list[dict]):
    """Of messages: by context (first name, divergence so far), each message's contexts, and by entry the count of all other messages and whether any has it; where each message's contexts and entries begin."""
    parts = []
    for r in rows:
        c, e, h = r["contexts"], r["entries"], 8 * (r["kind"] == _HOT)
        part = _unpack(r["body"], (c, 6), (c, h), (c, 6), (c, 4), (c, 3), (e, 5), (e, 5), (e, 1))
        part[0], part[5] = _keys(part[0]), _unstepped(part[5], part[3].astype(np.int64))
        parts.append(part)
    join = lambda i: np.concatenate([p[i] for p in parts])
    names, context = _distinct(join(0))
    if len(names) >> 24:
        raise ValueError("a bucket has too many contexts for its keys: use smaller batches")
    share = np.bincount(context, weights=(join(4).astype("<u4") << np.uint32(8)).view("<f4").astype(np.float64), minlength=len(names))
    n, original = np.zeros(len(names), np.int64), np.zeros(len(names), np.uint64)
    if rows[0]["kind"] == _HOT:
        n[context] = join(2).astype(np.int64)
    else:
        np.add.at(n, context, join(2).astype(np.int64))
    original[context] = join(1)
    owner = np.repeat(context, join(3).astype(np.int64))
    keys, inverse = _distinct(owner.astype(np.uint64) << np.uint64(40) | join(5))
    local = join(6).astype(np.int64)
    count = np.bincount(inverse, weights=local, minlength=len(keys)).astype(np.int64)
    q = np.zeros(len(keys), np.uint8)
    q[inverse] = join(7).astype(np.uint8)
    of = (keys >> np.uint64(40)).astype(np.int64)
    seen = count > 0
    a, b = divergence_parts(count[seen], n[of[seen]], q[seen])
    share += np.bincount(of[seen], weights=a + b / 2, minlength=len(names))
    shared = np.bincount(inverse, minlength=len(keys)) > 1  # a message names an entry once
    return original, share, context, count[inverse] - local, shared[inverse], np.cumsum([0, *(r["contexts"] for r in rows)]), np.cumsum([0, *(r["entries"] for r in rows)])


def _answer_contexts(key, asked):
    rows = asked.to_pylist()
    out = [(r["route"], r["batch"], _STATE, r["body"]) for r in rows if r["kind"] == _STATE]
    for kind in (_COLD, _HOT):
        if mine := [r for r in rows if r["kind"] == kind]:
            _, share, context, count, shared, heads, entries = _contexts_added(mine)
            kept = (share - 0.5 >= MIN_DIVERGENCE)[context]  # of a hot context's slice it says nothing and isn't read
            for r, i, j, k, m in zip(mine, heads, heads[1:], entries, entries[1:], strict=False):
                out.append((r["route"], r["batch"], kind, _pack((count[k:m], 6), (shared[k:m], 1), (kept[i:j], 1))))
    return _as_table(out, ANSWER)


def _hot_parts(key, asked):
    """What each slice of a hot context adds to its divergence."""
    rows = [r for r in asked.to_pylist() if r["kind"] == _HOT]
    name, share = _contexts_added(rows)[:2] if rows else (np.zeros(0, np.uint64), [])
    return pa.table({"name": pa.array(name.view(np.int64), pa.int64()), "share": pa.array(share, pa.float64())})


def _scored(routes: int, hot: int):
    def run(key, texts, answers):
        texts = _opened(texts)
        batch = Batch(texts)
        _hear(batch, DEPTH, answers, routes, hot)
        known, base, score = batch.scores()
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": pa.array(~batch.train), "n_tokens": pa.array(batch.size), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def op4(docs: DataFrame, batch_mb: int = BATCH_MB, hot: int = HOT) -> DataFrame:
    n = batch_count(docs, "text", batch_mb)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold(7) != 2).alias("train"))
    by_batch = rows.mapInArrow(trimmed(_chunked(n)), "batch int, chunk binary").groupBy("batch")
    by_route = by_batch.applyInArrow(trimmed_group(_ask_words(n)), ASK).groupBy("route")
    totals = by_route.applyInArrow(_totals, "tokens long, kinds long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    answers = by_route.applyInArrow(_answer_words, ANSWER).join(F.broadcast(totals))  # totals: one row
    for level in range(1, DEPTH + 1):
        by_route = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(trimmed_group(_ask_contexts(level, n, hot)), ASK).groupBy("route")
        shares = by_route.applyInArrow(_hot_parts, "name long, share double").groupBy("name").agg(F.sum("share").alias("share"))
        kept = shares.filter(F.col("share") - 0.5 >= MIN_DIVERGENCE).agg(F.collect_list("name").alias("kept"))  # at most MOST_HOT
        answers = by_route.applyInArrow(trimmed_group(_answer_contexts), ANSWER).join(F.broadcast(kept))
        answers = answers.withColumn("kept_hot", F.when(F.col("kind") == _STATE, F.col("kept"))).drop("kept")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(trimmed_group(_scored(n, hot)), schema)
    return scored.join(F.broadcast(totals)).select("doc_id", "held_out", "n_tokens", "n_known", F.col("tokens").alias("train_tokens"), "base_score", "score")
