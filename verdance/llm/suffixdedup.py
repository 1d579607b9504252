"""Removal of repeated passages with a suffix array built column by column.

Every byte covered by a 50-byte string that also starts in a document with a smaller id goes. The strings of all
documents can't be sorted in one place, so they are dealt by content first: a 50-byte window goes where its smallest
24-byte substring (by hash) sends it, and equal windows go together. Neighbouring windows with the same such
substring stay one segment of 50 to 81 bytes. Texts are dealt to batches of about `batch_mb`, however many there are, and
these steps follow, all of them in one plan whose only shuffle of texts is used again by each step:

1. A batch sends the hashes of its segments, once each, with how many segments it has of each, to the hash's bucket, which answers with three bits a hash:
   whether more than one document has it, whether more than GROUP batches do, and whether over CROWD segments have it. Segments of one document are done.
2. A batch puts equal segments among its own together: the copy of its smallest document stands for them and goes on to the
   segment's bucket, and the others are flagged at once if their document is larger. Segments that more than GROUP batches
   have (a passage in a third of all documents) first go to a place for each GROUP batches, where again one copy stands for
   all; so a bucket gets one message for GROUP batches, not one a batch.
   What is left of a crowded hash (one phrase with different words around it) is cut into single windows, each dealt by all
   of its own bytes, so that only equal windows meet, however many segments share the phrase.
3. A bucket takes about a megabyte of different segments at a time (by other bits of the same hash) and builds their
   generalised suffix array column by column: each round inserts one symbol of every segment, from its end to its start,
   into the collection's Burrows-Wheeler transform and updates the common prefixes of the neighbours. Both are streams
   that a round reads and writes in order, in nameless files (which no other task ever sees) once they are over SPOOL_BYTES.
   Runs of common prefixes of 50 or more are equal windows; the smallest document of each run decides which are flagged.
4. A batch takes the flags of its documents and cuts their texts.

Matches never cross documents, equal strings in the same document (or rows of equal id) don't count, and strings are
judged on the input. Batches are dealt by a hash of a row's place in the input, so equal rows are spread like others. Null texts count as empty; texts under 50 bytes stay; rows with a null id stay whole and are no
source. Ids are whole numbers. Other columns pass through the general form.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_count, slices, text_bytes, trimmed_group

LENGTH = 50
GRAM = 24
MOST_WINDOWS = 32
BATCH_MB = 5
SPOOL_BYTES = 1 << 19
CHUNK = 1 << 16
PORTION = 3 << 18
GROUP = 64
CROWD = 1 << 14
_B = 0x9E3779B97F4A7C15


def _step(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    return a * np.uint64(pow(_B, width, 1 << 64)) + b


def window_hashes(data: np.ndarray) -> np.ndarray:
    """For every 50-byte window, the smallest hash of a 24-byte string inside it."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = _step(h1[:-1], h1[1:], 1)
    h4 = _step(h2[:-2], h2[2:], 2)
    h8 = _step(h4[:-4], h4[4:], 4)
    h16 = _step(h8[:-8], h8[8:], 8)
    h = _step(h16[:-8], h8[16:], 8)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    for width in (1, 2, 4, 8):
        h = np.minimum(h[:-width], h[width:])
    return np.minimum(h[:-11], h[11:])  # 16 + 11 = 27 = 50 - 24 + 1


def spread(h: np.ndarray) -> np.ndarray:
    """Minima lie low; mixed once more (one to one), they fill all buckets alike."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def segments(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first window, windows) of every segment of the texts."""
    out: list[tuple] = []
    row = 0
    while row < len(raws):
        end, size = row, 0
        while end < len(raws) and (end == row or size + len(raws[end]) <= CHUNK):
            size += len(raws[end])
            end += 1
        lens = np.fromiter((len(r) for r in raws[row:end]), np.int64, end - row)
        if size >= LENGTH:
            starts = np.cumsum(lens) - lens
            h = window_hashes(np.frombuffer(b"".join(raws[row:end]), np.uint8))
            # runs of one hash; windows that reach over a text's end are runs of their own, and left out
            fresh = np.empty(len(h) + 1, bool)
            fresh[0] = fresh[-1] = True
            np.not_equal(h[1:], h[:-1], out=fresh[1:-1])
            fresh[starts[starts < len(h)]] = True
            over = np.maximum(starts + lens - LENGTH + 1, starts)
            fresh[over[over < len(h)]] = True
            edges = np.flatnonzero(fresh)
            first, count = edges[:-1], np.diff(edges)
            owner = np.searchsorted(starts, first, side="right") - 1  # of empty texts and the text after them: the latter
            inside = first - starts[owner]
            keep = inside + LENGTH <= lens[owner]
            first, count, owner, inside = first[keep], count[keep], owner[keep], inside[keep]
            if len(first):
                parts = -(-count // MOST_WINDOWS)
                which = np.repeat(np.arange(len(first)), parts)
                skip = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_WINDOWS
                out.append((spread(h[first])[which], owner[which] + row, inside[which] + skip, np.minimum(count[which] - skip, MOST_WINDOWS)))
        row = end
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


class Stream:
    """An array written once and read once, in order; in a nameless file where it is large."""

    def __init__(self, values: np.ndarray):
        self.file, self.values, self.kind = None, values, values.dtype
        if values.nbytes > SPOOL_BYTES:
            self.file, self.values = tempfile.TemporaryFile(), None
            values.tofile(self.file)

    def read(self) -> np.ndarray:
        if self.file is None:
            return self.values
        self.file.seek(0)
        out = np.fromfile(self.file, self.kind)
        self.file.close()
        return out


def _range_min(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of a[start:end] (none empty)."""
    if not len(start):
        return np.zeros(0, a.dtype)
    order = np.argsort(start)
    at = np.empty(2 * len(start), np.int64)
    at[0::2], at[1::2] = start[order], end[order]
    out = np.empty(len(start), a.dtype)
    out[order] = np.minimum.reduceat(np.append(a, a[-1:]), at)[::2]
    return out


def _last_to_first(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int32)  # a portion is far below 2**31
    rank[order] = np.arange(len(bwt), dtype=np.int32)
    return order, rank, int((bwt == 0).sum())


def column_wise(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The collection's Burrows-Wheeler transform (0: a string's start), common prefixes with the entry before, and lengths.

    A round takes the suffixes of length j to j + 1: a suffix's place follows from its rank among equal symbols of the
    transform (no suffix is ever compared), and its common prefix with a neighbour is one more than the least common
    prefix between the two entries that it extends.
    """
    m = len(strings)
    lens = np.fromiter(map(len, strings), np.int64, m)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    code = np.zeros(256, np.uint8)
    present = np.unique(flat)
    code[present] = np.arange(1, len(present) + 1)  # UTF-8 has under 255 different bytes
    flat, ends = code[flat], np.cumsum(lens)
    bwt_stream, lcp_stream = Stream(flat[ends - 1]), Stream(np.zeros(m, np.uint8))
    place = np.arange(m)
    for j in range(1, int(lens.max()) + 1):
        bwt, lcp = bwt_stream.read(), lcp_stream.read()
        act = np.flatnonzero(lens >= j)
        at = place[act]
        order, rank, starts = _last_to_first(bwt)
        k = rank[at]
        symbol = bwt[at]
        before = order[np.maximum(k - 1, 0)]
        after = order[np.minimum(k + 1, len(bwt) - 1)]
        has_before = (k > 0) & (bwt[before] == symbol)
        has_after = (k + 1 < len(bwt)) & (bwt[after] == symbol)
        low, high = np.zeros(len(act), np.uint8), np.zeros(len(act), np.uint8)
        low[has_before] = _range_min(lcp, before[has_before] + 1, at[has_before] + 1) + 1
        high[has_after] = _range_min(lcp, at[has_after] + 1, after[has_after] + 1) + 1
        new = m + k - starts
        old = np.ones(len(bwt) + len(act), bool)
        old[new] = False
        bwt2, lcp2 = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        bwt2[old], lcp2[old] = bwt, lcp
        more = lens[act] > j
        bwt2[new] = np.where(more, flat[np.where(more, ends[act] - 1 - j, 0)], 0)
        lcp2[new[has_after] + 1] = high[has_after]
        lcp2[new] = low
        place[act] = new
        bwt_stream, lcp_stream = Stream(bwt2), Stream(lcp2)
    return bwt_stream.read(), lcp_stream.read(), lens


def smallest_owners(strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(table, lengths): table[n - length, i] is the smallest owner among all strings that have the window at which string i has n bytes left."""
    bwt, lcp, lens = column_wise(strings)
    m, longest = len(strings), int(lens.max())
    _, rank, starts = _last_to_first(bwt)
    place = np.arange(m)
    places = np.full((longest - length + 1, m), -1)
    for j in range(1, longest + 1):
        act = np.flatnonzero(lens >= j)
        place[act] = m + rank[place[act]] - starts
        if j >= length:
            places[j - length, act] = place[act]
    top = np.iinfo(np.int64).max
    owner = np.full(len(bwt), top)
    there = places >= 0
    owner[places[there]] = np.broadcast_to(owners, places.shape)[there]
    edge = lcp < length
    least = np.minimum.reduceat(owner, np.flatnonzero(edge))
    group = np.cumsum(edge) - 1
    table = np.full(places.shape, top)
    table[there] = least[group[places[there]]]
    return table, lens


def flagged(table: np.ndarray, left: np.ndarray, windows: np.ndarray, owner: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, first window, windows) of the runs of windows that a smaller owner has. left: bytes of the string."""
    wide = np.arange(int(windows.max(initial=0)))
    inside = wide[None, :] < windows[:, None]
    row = np.where(inside, left[:, None] - wide[None, :] - LENGTH, 0)
    hit = inside & (table[row, string[:, None]] < owner[:, None])
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, start = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return who, start, end - start


def _sorted_rows(texts: pa.Table) -> tuple[list, list[bytes], pa.Table]:
    """Rows in an order that doesn't depend on how they came: by id and text; null ids last."""
    ids, raws = texts.column("id").to_pylist(), texts.column("raw").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raws[i]))
    return [ids[i] for i in order], [raws[i] for i in order], texts.take(pa.array(order, pa.int64())) if order else texts


def _known(ids: list, raws: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    n = next((i for i, x in enumerate(ids) if x is None), len(ids))
    return np.array(ids[:n], np.int64), raws[:n]


ASK = "bucket int, batch int, hashes binary, several binary, count binary"
ANSWER = "batch int, bucket int, bits binary, hot binary, crowded binary"
SENT = "route int, bucket int, kind int, batch int, keys binary, windows binary, ids binary, rows binary, places binary, body binary"
#: Kinds of messages: segments for their bucket, flags on their way back, hot segments for the place of their batches.
_SEGMENTS, _FLAGS, _HOT = 0, 1, 2
_KINDS = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def _as_table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, _KINDS[kind]) for c, (name, kind) in zip(cols, fields, strict=True)})


def _short(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes; the bucket holds the high ones, and a chance match only sends a segment on in vain."""
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(short, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _ask(buckets: int):
    def run(key, texts):
        ids, raws, _ = _sorted_rows(texts)
        h, row, _, _ = segments(_known(ids, raws)[1])
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        fresh = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        unique = h[fresh]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(h)) - 1
        several = row[first] != row[last] if len(h) else np.zeros(0, bool)
        batch = key[0].as_py()
        count = np.minimum(last + 1 - first, 65535).astype(np.uint16)
        return _as_table([(b, batch, _short(unique[i:j]), np.packbits(several[i:j]).tobytes(), count[i:j].tobytes()) for b, i, j in slices(_buckets(unique, buckets))], ASK)

    return run


def _answer(crowd: int):
    def run(key, asked):
        parts = [_long(x) for x in asked.column("hashes").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)] for x, p in zip(asked.column("several").to_pylist(), parts, strict=True)]
        h, shared = np.concatenate(parts), np.concatenate(several).astype(bool)
        count = np.concatenate([np.frombuffer(x, np.uint16) for x in asked.column("count").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        s = h[order]
        fresh = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
        batches = np.diff(np.append(fresh, len(s)))  # that have it: a batch names a hash once
        hot, crowded = np.zeros(len(h), bool), np.zeros(len(h), bool)
        shared[order] |= np.repeat(batches > 1, batches)
        hot[order] = np.repeat(batches > GROUP, batches)
        if len(h):
            crowded[order] = np.repeat(np.add.reduceat(count[order], fresh) > crowd, batches)
        out, at = [], 0
        for batch, p in zip(asked.column("batch").to_pylist(), parts, strict=True):
            out.append((batch, key[0].as_py(), *(np.packbits(x[at : at + len(p)]).tobytes() for x in (shared, hot, crowded))))
            at += len(p)
        return _as_table(out, ANSWER)

    return run


def _send(buckets: int):
    def run(key, texts, answers):
        batch = key[0].as_py()
        ids, raws, _ = _sorted_rows(texts)
        ids, raws = _known(ids, raws)
        h, row, first, windows = segments(raws)
        unique = np.unique(h)
        asked = {b: (i, j) for b, i, j in slices(_buckets(unique, buckets))}
        shared, hot, crowded = (np.zeros(len(unique), bool) for _ in range(3))
        for b, *bits in zip(*(answers.column(c).to_pylist() for c in ("bucket", "bits", "hot", "crowded")), strict=True):
            i, j = asked[b]
            shared[i:j], hot[i:j], crowded[i:j] = (np.unpackbits(np.frombuffer(x, np.uint8))[: j - i] for x in bits)
        at = np.searchsorted(unique, h)
        keep = shared[at] if len(h) else np.zeros(0, bool)
        h, row, first, windows, at = h[keep], row[keep], first[keep], windows[keep], at[keep]
        hot, crowded = hot[at], crowded[at]
        # rows are in order of id, so the first owner of a content has the smallest id
        owner: dict[bytes, int] = {}
        local = np.zeros(len(h), bool)
        body: list = [None] * len(h)
        for i, (r, a, w) in enumerate(zip(row.tolist(), first.tolist(), windows.tolist(), strict=True)):
            x = raws[r][a : a + w + LENGTH - 1]
            if ids[owner.setdefault(x, r)] < ids[r]:
                local[i] = True
            else:
                body[i] = x
        out = [_flag_row(batch % buckets, batch, row[local], first[local], windows[local])] if local.any() else []
        if (cut := np.flatnonzero(crowded & ~local)).size:
            keys, of, place = _single([body[i] for i in cut.tolist()])
            whole, of = np.flatnonzero(~crowded & ~local), cut[of]
            body = [*(body[i] for i in whole.tolist()), *(body[i][w : w + LENGTH] for i, w in zip(of.tolist(), place.tolist(), strict=True))]
            h, row, hot = (np.concatenate([x[whole], y]) for x, y in ((h, keys), (row, row[of]), (hot, hot[of])))
            first, windows = np.concatenate([first[whole], first[of] + place]), np.concatenate([windows[whole], np.ones(len(of), windows.dtype)])
            local = np.zeros(len(h), bool)
        for kind, mine in ((_SEGMENTS, ~local & ~hot), (_HOT, ~local & hot)):
            sent = np.flatnonzero(mine)
            bucket = _buckets(h[sent], buckets)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            for b, i, j in slices(bucket):
                s = sent[i:j]
                route = b if kind == _SEGMENTS else (b + batch // GROUP * 7919) % buckets
                out.append((route, b, kind, batch, _bytes(h[s] & np.uint64(0xFFFFFFFF), np.uint32), _bytes(windows[s], np.int32), _bytes(ids[row[s]], np.int64), _bytes(row[s], np.int32), _bytes(first[s], np.int32), _squeezed([body[x] for x in s.tolist()])))
        return _as_table(out, SENT)

    return run


def _single(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, string, first byte) of every window of the strings. By all of its bytes, so that equal windows of any two strings have one hash."""
    keys, of, place = [], [], []
    for i, x in enumerate(strings):
        for w in range(len(x) - LENGTH + 1):
            k = hashlib.blake2b(x[w : w + LENGTH], digest_size=8).digest()
            keys.append(k)
            of.append(i)
            place.append(w)
    return np.frombuffer(b"".join(keys), np.uint64), np.array(of, np.int64), np.array(place, np.int64)


def _bytes(v, kind) -> bytes:
    return np.ascontiguousarray(v, kind).tobytes()


def _squeezed(strings: list[bytes]) -> bytes:
    """Segments one after the other, smaller than the shuffle's own compression would make them; their lengths follow from their windows."""
    return pa.compress(b"".join(strings), codec="zstd", asbytes=True)


def _flag_row(route: int, batch: int, rows, places, windows) -> tuple:
    return (route, 0, _FLAGS, batch, b"", _bytes(windows, np.int32), b"", _bytes(rows, np.int32), _bytes(places, np.int32), b"")


class _Held:
    """Messages of segments, unpacked: one row a segment."""

    def __init__(self, rows: list[dict]):
        column = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows] or [np.zeros(0, kind)])
        self.keys, self.windows = column("keys", np.uint32), column("windows", np.int32)
        self.ids, self.rows, self.places = column("ids", np.int64), column("rows", np.int32), column("places", np.int32)
        count = [len(r["keys"]) // 4 for r in rows]
        self.batch, self.bucket = (np.repeat(np.array([r[c] for r in rows], np.int64), count) for c in ("batch", "bucket"))
        long = self.windows.astype(np.int64) + LENGTH - 1
        ends = np.cumsum(long)
        last = np.concatenate([[0], ends])[np.cumsum([0, *count])]  # where each message's segments begin, and the last one's end
        self.bodies = [pa.decompress(r["body"], decompressed_size=int(b - a), codec="zstd", asbytes=True) for r, a, b in zip(rows, last, last[1:], strict=False)]
        self.message = np.repeat(np.arange(len(rows)), count)
        self.end = ends - last[self.message]
        self.start = self.end - long

    def strings(self, at: np.ndarray) -> list[bytes]:
        bodies = self.bodies
        return [bodies[m][a:b] for m, a, b in zip(self.message[at].tolist(), self.start[at].tolist(), self.end[at].tolist(), strict=True)]

    def flags(self, at: np.ndarray, start: np.ndarray, windows: np.ndarray, buckets: int) -> list[tuple]:
        """Rows of flags for the batches of these segments: windows from each one's start on."""
        order = np.argsort(self.batch[at], kind="stable")
        at, start, windows = at[order], start[order], windows[order]
        return [_flag_row(b % buckets, b, self.rows[at[i:j]], self.places[at[i:j]] + start[i:j], windows[i:j]) for b, i, j in slices(self.batch[at])]


def _combine(buckets: int):
    """Of hot segments of GROUP batches, equal ones are put together: the copy of the smallest document goes on, the rest are flagged if their document is larger."""

    def run(rows: list[dict]) -> list[tuple]:
        held = _Held(rows)
        order = np.argsort(held.ids, kind="stable")
        owner: dict[tuple, int] = {}
        lost = np.zeros(len(order), bool)
        stays = []
        for i, b, x in zip(order.tolist(), held.bucket[order].tolist(), held.strings(order), strict=True):
            best = owner.setdefault((b, x), i)
            if held.ids[best] < held.ids[i]:
                lost[i] = True
            else:
                stays.append(i)
        gone, stays = np.flatnonzero(lost), np.array(stays, np.int64)
        out = held.flags(gone, np.zeros(len(gone), np.int64), held.windows[gone], buckets)
        stays = stays[np.lexsort((held.batch[stays], held.bucket[stays]))]
        for _, i, j in slices(held.bucket[stays] * (1 << 32) + held.batch[stays]):
            s = stays[i:j]
            b = int(held.bucket[s[0]])
            out.append((b, b, _SEGMENTS, int(held.batch[s[0]]), _bytes(held.keys[s], np.uint32), _bytes(held.windows[s], np.int32), _bytes(held.ids[s], np.int64), _bytes(held.rows[s], np.int32), _bytes(held.places[s], np.int32), _squeezed(held.strings(s))))
        return out

    return run


def _portions(held: _Held) -> list[np.ndarray]:
    """Segments by parts of the bucket (equal windows share one of 256), put together to about PORTION bytes each."""
    part = held.keys & np.uint32(255)
    size = np.bincount(part, weights=held.windows + LENGTH - 1, minlength=256)
    number = np.zeros(256, np.int64)
    portion, full = 0, 0.0
    for i in range(256):
        if full and full + size[i] > PORTION:
            portion, full = portion + 1, 0.0
        full += size[i]
        number[i] = portion
    mine = number[part]
    order = np.argsort(mine, kind="stable")
    return [order[i:j] for _, i, j in slices(mine[order])]


def _alone(strings: list[bytes]) -> np.ndarray:
    """Which strings have no window that comes twice, by hashes of whole windows: equal windows have one hash, so none with a partner is alone."""
    n = np.array([len(x) for x in strings], np.int64)
    h1 = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
    h2 = _step(h1[:-1], h1[1:], 1)
    h4 = _step(h2[:-2], h2[2:], 2)
    h8 = _step(h4[:-4], h4[4:], 4)
    h16 = _step(h8[:-8], h8[8:], 8)
    h = _step(_step(h16[:-16], h16[16:], 16)[:-18], _step(h16[32:-2], h2[48:], 2), 18)  # 32 + 16 + 2 bytes
    start = np.cumsum(n) - n
    windows = n - LENGTH + 1
    of = np.repeat(np.arange(len(n)), windows)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    value = h[at]
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    alone = np.ones(len(n), bool)
    alone[of[order[1:][same]]] = alone[of[order[:-1][same]]] = False
    return alone


def _resolve(rows: list[dict], buckets: int) -> list[tuple]:
    """Flags of all windows that a smaller document has, from the suffix arrays of the bucket's different segments. Segments that came once and have no window with a partner have nothing to be decided, and are left out."""
    held, out = _Held(rows), []
    for at in _portions(held):
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(x, len(number)) for x in held.strings(at)])
        idle = _alone(list(number)) & (np.bincount(which, minlength=len(number)) == 1)
        if idle.any():
            stays = ~idle[which]
            at, place = at[stays], np.cumsum(~idle) - 1
            which, number = place[which[stays]], {x: None for x, i in zip(number, idle.tolist(), strict=True) if not i}
            if not len(at):
                continue
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, held.ids[at])
        table, lens = smallest_owners(list(number), least)
        who, start, n = flagged(table, lens[which], held.windows[at], held.ids[at], which)
        out += held.flags(at[who], start, n, buckets)
    return out


def _places(buckets: int):
    """At a route: flags pass, segments of the bucket are resolved, hot ones of some batches are put together and go on to their bucket, for a second turn.

    A hash is hot for all of its segments or for none, so no segment of the first turn has windows in common with one of the second.
    """
    combine = _combine(buckets)

    def run(key, sent):
        rows = sent.to_pylist()
        by = {kind: [r for r in rows if r["kind"] == kind] for kind in (_SEGMENTS, _FLAGS, _HOT)}
        out = [tuple(r.values()) for r in by[_FLAGS]]
        return _as_table([*out, *(_resolve(by[_SEGMENTS], buckets) if by[_SEGMENTS] else []), *(combine(by[_HOT]) if by[_HOT] else [])], SENT)

    return run


def _cut(key, texts, flags):
    ids, raws, texts = _sorted_rows(texts)
    unpack = lambda c: np.concatenate([np.frombuffer(x, np.int32) for x in flags.column(c).to_pylist()] or [np.zeros(0, np.int32)])
    rows, places, windows = unpack("rows"), unpack("places"), unpack("windows")
    order = np.argsort(rows, kind="stable")
    rows, places, windows = rows[order], places[order], windows[order]
    cuts = np.searchsorted(rows, np.arange(len(raws) + 1))
    kept, removed, spans = [], [], []
    for i, raw in enumerate(raws):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            kept.append(raw)
            removed.append(0)
            spans.append(0)
            continue
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, places[a:b], 1)
        np.add.at(edge, places[a:b] + windows[a:b] + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        removed.append(int(gone.sum()))
        spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
    return pa.table({
        "row": texts.column("row"), "n_bytes": pa.array([len(r) for r in raws], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
        "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    })


def _cut_light(key, texts, flags):
    return _cut(key, texts, flags).drop_columns(["kept"])


def _cut_text(key, texts, flags):
    cut = _cut(key, texts, flags)
    return pa.table({"row": cut.column("row"), "text": pa.array([x.decode("utf-8", "ignore") for x in cut.column("kept").to_pylist()], pa.string())})


def dedup(docs: DataFrame, carry: list[str], finish=_cut, output: str = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string", batch_mb: int = BATCH_MB, crowd: int = CROWD) -> DataFrame:
    """row (struct of the carried columns) and what `finish` makes of each text's flags: by default n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256."""
    n = batch_count(docs, "text", batch_mb)
    raw = text_bytes()
    batch = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), raw.alias("raw"), F.struct(*carry).alias("row"), batch.alias("batch"))
    by_batch = texts.groupBy("batch")
    answers = by_batch.applyInArrow(trimmed_group(_ask(n)), ASK).groupBy("bucket").applyInArrow(_answer(crowd), ANSWER)
    sent = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(trimmed_group(_send(n)), SENT)
    for _ in range(2):
        sent = sent.groupBy("route").applyInArrow(trimmed_group(_places(n)), SENT)
    kind = texts.schema["row"].dataType.simpleString()
    return by_batch.cogroup(sent.groupBy("batch")).applyInArrow(trimmed_group(finish), f"row {kind}, {output}")


def op7(docs: DataFrame) -> DataFrame:
    return dedup(docs, ["doc_id"], _cut_light, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut from their texts; pieces of a character whose other bytes went go too."""
    rows = dedup(docs, [c for c in docs.columns if c != "text"], _cut_text, "text string")
    return rows.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
