"""Histogram gradient-boosted trees in numpy: logistic loss, level-wise growth, trees kept as
flat arrays that are traversed for whole columns at once."""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, *, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base = 0.0
        n = (1 << depth) - 1
        self.feature = np.zeros((0, n), np.int32)
        self.cut = np.zeros((0, n))
        self.value = np.zeros((0, n + 1))
        self.shift, self.scale = 0.0, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        """x: rows by features, finite; y: 0 or 1."""
        n, f = x.shape
        mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        if n < 2 or len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(f)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], 1)  # code > b iff x > edges[b]
        width = self.bins
        flat = code + np.arange(f) * width
        raw = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        features, cuts, values = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, k = (1 << level) - 1, 1 << level
                at = ((node - first)[:, None] * (f * width) + flat).ravel()
                hg = np.bincount(at, np.repeat(g, f), k * f * width).reshape(k, f, width)
                hh = np.bincount(at, np.repeat(h, f), k * f * width).reshape(k, f, width)
                lg, lh = hg.cumsum(2)[:, :, :-1], hh.cumsum(2)[:, :, :-1]
                tg, th = hg.sum(2)[:, :1, None], hh.sum(2)[:, :1, None]
                rg, rh = tg - lg, th - lh
                gain = lg**2 / (lh + self.l2) + rg**2 / (rh + self.l2) - tg**2 / (th + self.l2)
                gain[(lh < self.least) | (rh < self.least)] = 0
                for j in range(f):
                    gain[:, j, len(edges[j]) :] = 0
                best = gain.reshape(k, -1).argmax(1)
                won = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
                fj, b = best // (width - 1), best % (width - 1)
                feature[first : first + k] = np.where(won, fj, 0)
                cut[first : first + k] = [edges[j][c] if w else np.inf for j, c, w in zip(fj, b, won, strict=True)]
                own = node - first
                right = won[own] & (code[np.arange(n), fj[own]] > b[own])
                node = 2 * node + 1 + right
            leaf = node - inner
            value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            raw += value[leaf]
            features.append(feature)
            cuts.append(cut)
            values.append(value)
        self.feature, self.cut, self.value = np.array(features), np.array(cuts), np.array(values)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        """Platt scaling on rows that the trees haven't seen."""
        if not len(self.feature) or len(np.unique(y)) < 2:
            return self
        z = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = np.maximum(p * (1 - p), 1e-9)
            ga, gb = ((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()
            haa, hab, hbb = (w * z * z).sum() + 1e-2, (w * z).sum(), w.sum() + 1e-9
            det = haa * hbb - hab * hab
            if det <= 1e-12:
                break
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        if np.isfinite(a) and np.isfinite(b) and a > 0:
            self.scale, self.shift = float(a), float(b)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -35, 35)))
