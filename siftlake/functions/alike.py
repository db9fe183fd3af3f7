"""Pairs of texts that are alike, without measuring all of them letter by letter: numpy on letter counts and on bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from siftlake.functions.spans import similarity

#: Kinds of letters (a to z, digits, blank, all others) and the code behind them, repetitions of a letter that are counted, and rows compared at once.
KINDS, MOST, CHUNK = 38, 6, 256


def alike_pairs(texts: list[str], others: list[str] | None, least: float) -> Iterator[tuple[int, int]]:
    """Places i, k of texts[i] and others[k] with similarity() of `least` or more; without others, of each two texts once.

    No two texts are closer than their lengths and their counts of letters, which are compared as bits for all pairs; the few
    that are left are measured, as similarity() does it, all at once.
    """
    both, n = texts + (others or []), len(texts)
    size = np.array([len(t) for t in both], dtype=np.int64)
    kind = _kinds(both)
    row = np.repeat(np.arange(len(both)), size)
    counts = np.bincount(row * KINDS + kind, minlength=len(both) * KINDS).reshape(-1, KINDS)
    bits = (counts[:, :, None] > np.arange(MOST)).reshape(len(both), KINDS * MOST)
    bits = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)
    measured = _Measure(both, size, kind, row, counts, least)
    rows = np.argsort(size[:n], kind="stable")
    cols = rows if others is None else n + np.argsort(size[n:], kind="stable")
    ratio = least / (200 - least)
    for i in range(0, len(rows), CHUNK):
        x = rows[i : i + CHUNK]
        lo = i if others is None else int(np.searchsorted(size[cols], size[x[0]] * ratio - 1e-6, "left"))
        y = cols[lo : int(np.searchsorted(size[cols], size[x[-1]] / ratio + 1e-6, "right"))]
        apart = sum(np.bitwise_count(bits[x, k][:, None] ^ bits[y, k]) for k in range(bits.shape[1]))
        p, q = np.nonzero(apart <= (1 - least / 100) * (size[x][:, None] + size[y]) + 1e-6)
        if others is None:
            p, q = p[q > p], q[q > p]
        a, b = x[p], y[q]
        fits = measured(a, b)
        yield from zip(a[fits].tolist(), (b[fits] if others is None else b[fits] - n).tolist())


def _kinds(texts: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.where((code >= 97) & (code <= 122), code - 97, np.where((code >= 48) & (code <= 57), code - 22, np.where(code == 32, 36, 37)))


class _Measure:
    """Which of many pairs are alike: the bit-parallel longest common subsequence, one letter of all pairs at a time, if the shorter text has 64 letters at most and none of the other kind."""

    def __init__(self, texts: list[str], size: np.ndarray, kind: np.ndarray, row: np.ndarray, counts: np.ndarray, least: float):
        self.texts, self.size, self.least = texts, size, least
        place = np.arange(len(kind)) - np.repeat(np.cumsum(size) - size, size)
        self.plain = counts[:, KINDS - 1] == 0
        self.codes = np.full((len(texts), max(1, size.max(initial=0))), KINDS, dtype=np.uint8)
        self.codes[row, place] = kind
        self.bits = np.zeros((len(texts), KINDS + 1), dtype=np.uint64)
        short = place < 64
        np.bitwise_or.at(self.bits, (row[short], kind[short]), np.uint64(1) << place[short].astype(np.uint64))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        fast = (self.size[a] <= 64) & (self.size[a] > 0) & self.plain[a] & self.plain[b]
        out = np.zeros(len(a), dtype=bool)
        out[~fast] = [similarity(self.texts[i], self.texts[k]) >= self.least for i, k in zip(a[~fast], b[~fast])]
        a, b = a[fast], b[fast]
        full = np.uint64(2**64 - 1) >> (64 - self.size[a]).astype(np.uint64)
        state = full.copy()
        for k in range(self.size[b].max(initial=0)):
            met = state & self.bits[a, self.codes[b, k]]
            state = state + met | state - met
        out[fast] = 200.0 * (self.size[a] - np.bitwise_count(state & full)) / (self.size[a] + self.size[b]) >= self.least
        return out
