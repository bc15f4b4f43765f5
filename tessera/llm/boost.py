"""Gradient-boosted trees in numpy with monotonic constraints, flattened for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees of one depth: node i has the children 2i+1 and 2i+2; rows at most the cut go to the first."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 8, ridge: float = 2.0) -> Boosted:
    """Boosting for the log loss of y in {0, 1}. monotone: -1, 0 or 1 for each column; the score falls, is free or rises with it."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, edges, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node, bounds = np.zeros(n, np.int64), {0: (-np.inf, np.inf)}
        for i in range(inner):
            rows, (low, high) = np.flatnonzero(node == i), bounds[i]
            best = (1e-6, None)
            if len(rows) >= 2 * least:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    size = len(cuts[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None))
                    gr, hr = g.sum() - gl, h.sum() - hl
                    left, right = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = (2 * left * gl - left**2 * (hl + ridge)) + (2 * right * gr - right**2 * (hr + ridge)) - whole
                    bad = (nl < least) | (len(rows) - nl < least) | (monotone[j] * (right - left) < 0)
                    gain = np.where(bad, -np.inf, gain)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, left[k], right[k]))
            if best[1] is None:
                bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
                node[rows] = 2 * i + 1
                continue
            j, k, left, right = best[1]
            features[t, i], edges[t, i] = j, cuts[j][k]
            middle = (left + right) / 2
            bounds[2 * i + 1] = (low, min(high, middle)) if monotone[j] > 0 else (max(low, middle), high) if monotone[j] < 0 else (low, high)
            bounds[2 * i + 2] = (max(low, middle), high) if monotone[j] > 0 else (low, min(high, middle)) if monotone[j] < 0 else (low, high)
            node[rows] = 2 * i + 1 + (binned[rows, j] > k)
        for leaf in range(leaves):
            rows, (low, high) = np.flatnonzero(node == inner + leaf), bounds[inner + leaf]
            values[t, leaf] = rate * np.clip(grad[rows].sum() / (hess[rows].sum() + ridge), low, high)
        score += values[t, node - inner]
    return Boosted(features, edges, values, base)
