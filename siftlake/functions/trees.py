"""A calibrated random forest in numpy: level-wise histogram trees on binned features, isotonic confidence."""

from __future__ import annotations

import numpy as np


class Forest:
    """Classification trees on uint8 features (at most 64 bins each), bagged, with calibrated confidence.

    fit() keeps a fifth of its rows from the trees and fits on them, by pooling adjacent violators, the share of right
    answers as a function of the forest's raw confidence.
    """

    def __init__(self, trees: int = 24, depth: int = 7, least: int = 4, seed: int = 7):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.classes, target = np.unique(y, return_inverse=True)
        held = rng.random(len(x)) < 0.2
        if held.all() or not held.any() or len(x) < 20:
            held[:] = False
        rows = np.flatnonzero(~held)
        self.nodes = [self._tree(x, target, rng.choice(rows, len(rows)), rng) for _ in range(self.trees)]
        test = np.flatnonzero(held) if held.any() else rows
        p = self._raw(x[test])
        self.steps = _isotonic(p.max(1), (p.argmax(1) == target[test]).astype(float))
        self.held_out = float((p.argmax(1) == target[test]).mean())
        return self

    def _tree(self, x, y, rows, rng):
        k, d = len(self.classes), x.shape[1]
        size = 2 ** (self.depth + 1) - 1
        feature, cut, leaf = np.full(size, -1), np.zeros(size, np.uint8), np.zeros((size, k))
        at = np.zeros(len(rows), np.int64)
        xs, ys = x[rows], y[rows]
        for level in range(self.depth + 1):
            begin = 2**level - 1
            count = np.bincount((at - begin).clip(0) * k + ys, weights=at >= begin, minlength=2**level * k)[: 2**level * k].reshape(-1, k)
            leaf[begin : begin + 2**level] = (count + 0.1) / (count.sum(1, keepdims=True) + 0.1 * k)
            if level == self.depth:
                break
            best, gain = np.full(2**level, -1), np.full(2**level, 1e-9)
            split = np.zeros(2**level, np.uint8)
            live = at >= begin
            total = count.sum(1)
            parent = (count**2).sum(1) / np.maximum(total, 1)
            for f in rng.permutation(d)[: max(2, int(np.ceil(d * 0.6)))]:
                code = ((at[live] - begin) * 64 + xs[live, f]) * k + ys[live]
                left = np.bincount(code, minlength=2**level * 64 * k).reshape(-1, 64, k).cumsum(1)
                right = count[:, None, :] - left
                nl, nr = left.sum(2), right.sum(2)
                g = (left**2).sum(2) / np.maximum(nl, 1) + (right**2).sum(2) / np.maximum(nr, 1) - parent[:, None]
                g[(nl < self.least) | (nr < self.least)] = 0
                b = g.argmax(1)
                better = g[np.arange(len(b)), b] > gain
                best[better], split[better], gain[better] = f, b[better], g[np.arange(len(b)), b][better]
            feature[begin : begin + 2**level], cut[begin : begin + 2**level] = best, split
            f = np.where(live, feature[at.clip(0)], -1)
            go = f >= 0
            at = np.where(go, 2 * at + 1 + (xs[np.arange(len(at)), f.clip(0)] > cut[at.clip(0)]), -1)
        return feature, cut, leaf

    def _raw(self, x):
        total = np.zeros((len(x), len(self.classes)))
        for feature, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[np.arange(len(x)), f.clip(0)] > cut[at]), at)
            total += leaf[at]
        return total / len(self.nodes)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest class of each row and its calibrated confidence."""
        p = self._raw(x)
        edges, values = self.steps
        return self.classes[p.argmax(1)], values[np.searchsorted(edges, p.max(1), "right").clip(1) - 1]


def _isotonic(score: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least scores of the steps and the steps' values of a rising fit of right on score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, r in zip(score[order], right[order]):
        blocks.append([s, r, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, r1, n1 = blocks.pop()
            blocks[-1][1] += r1
            blocks[-1][2] += n1
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
