"""Likeness of two texts by matching blocks, for whole batches of pairs at once.

The longest block that both texts have is taken (of equals the first in one text, then in the other), then the same to its left and to its
right, until nothing matches; the likeness is twice the matched characters over all characters. In a second text of 200 characters
or more, characters that make up over a hundredth of it begin no block, but extend one. A round looks for the blocks of
all open stretches of all pairs together: numpy walks the first texts character by character, side by side.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the definition: from which length on frequent characters begin no block, and how frequent that is.
LONG, SHARE = 200, 100


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum(n) - n, n


def _startable(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The second texts' characters, those that begin no block as -1."""
    out = codes.copy()
    for i in np.flatnonzero(n >= LONG):
        own = codes[start[i] : start[i] + n[i]]
        values, place, count = np.unique(own, return_inverse=True, return_counts=True)
        out[start[i] : start[i] + n[i]][(count > n[i] // SHARE + 1)[place]] = -1
    return out


def _longest(a: np.ndarray, b: np.ndarray, alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, length) of the first longest block of each stretch; places in the flat codes."""
    wide = np.arange(int((bhi - blo).max()))
    at = blo[:, None] + wide
    inside = at < bhi[:, None]
    right = np.where(inside, b[np.where(inside, at, 0)], -1)
    run = np.zeros(right.shape, np.int64)
    best, besti, bestj = np.zeros(len(alo), np.int64), alo.copy(), blo.copy()
    rows = np.arange(len(alo))
    for i in range(int((ahi - alo).max())):
        here = alo + i < ahi
        same = (right == np.where(here, a[np.where(here, alo + i, 0)], -2)[:, None])
        run[:, 1:] = np.where(same[:, 1:], run[:, :-1] + 1, 0)
        run[:, 0] = same[:, 0]
        j = run.argmax(axis=1)
        most = run[rows, j]
        more = most > best
        best = np.where(more, most, best)
        besti, bestj = np.where(more, alo + i - most + 1, besti), np.where(more, blo + j - most + 1, bestj)
    return besti, bestj, best


def ratios(one: list[str], two: list[str], cells: int = 1 << 21) -> np.ndarray:
    """Likeness of each pair; two empty texts are alike. cells: how many characters of second texts a step may hold."""
    a, a0, an = _codes(one)
    b, b0, bn = _codes(two)
    first = _startable(b, b0, bn)
    matched = np.zeros(len(one), np.int64)
    pair = np.flatnonzero((an > 0) & (bn > 0))
    open_ = [pair, a0[pair], a0[pair] + an[pair], b0[pair], b0[pair] + bn[pair]]
    while len(open_[0]):
        order = np.argsort(open_[4] - open_[3], kind="stable")
        open_ = [x[order] for x in open_]
        left = []
        at = 0
        while at < len(order):
            width = open_[4][at:] - open_[3][at:]
            n = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), cells, side="right")))
            p, alo, ahi, blo, bhi = (x[at : at + n] for x in open_)
            at += n
            i, j, size = _longest(a, first, alo, ahi, blo, bhi)
            while (more := (i > alo) & (j > blo) & (a[np.maximum(i - 1, 0)] == b[np.maximum(j - 1, 0)])).any():
                i, j, size = i - more, j - more, size + more
            while (more := (i + size < ahi) & (j + size < bhi) & (a[np.minimum(i + size, len(a) - 1)] == b[np.minimum(j + size, len(b) - 1)])).any():
                size = size + more
            np.add.at(matched, p, size)
            for x in ((p, alo, i, blo, j), (p, i + size, ahi, j + size, bhi)):
                keep = (size > 0) & (x[2] > x[1]) & (x[4] > x[3])
                left.append([y[keep] for y in x])
        open_ = [np.concatenate(x) for x in zip(*left, strict=True)]
    total = an + bn
    return np.where(total > 0, 2 * matched / np.maximum(total, 1), 1.0)
