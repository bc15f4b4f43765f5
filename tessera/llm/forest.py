"""A random forest in numpy: bagged trees of Gini splits on random columns, flattened for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: node i has the children 2i+1 and 2i+2; rows at most the cut go to the first."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of 1 in the leaves that the rows of x reach."""
        rows, inner, out = np.arange(len(x)), self.feature.shape[1], np.zeros(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out / len(self.feature)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 6, columns: int = 4, seed: int = 1) -> Forest:
    rng = np.random.default_rng(seed)
    n, width = x.shape
    inner = 2**depth - 1
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        bag = rng.integers(0, n, n)
        at, share = np.zeros(n, np.int64), np.full(2 * inner + 1, y.mean())
        for i in range(inner):
            rows = bag[at == i]
            if len(rows):
                share[i] = y[rows].mean()
            share[2 * i + 1] = share[2 * i + 2] = share[i]
            best = (1e-9, 0, np.inf)
            if 0 < share[i] < 1:
                for j in rng.choice(width, min(columns, width), replace=False):
                    order = np.argsort(x[rows, j], kind="stable")
                    v, ones = x[rows, j][order], np.cumsum(y[rows][order])
                    k = np.flatnonzero(v[1:] > v[:-1])
                    if len(k):
                        nl, left = k + 1.0, ones[k]
                        nr, right = len(rows) - nl, ones[-1] - left
                        gain = left**2 / nl + right**2 / nr - ones[-1] ** 2 / len(rows)
                        if gain.max() > best[0]:
                            g = int(gain.argmax())
                            best = (gain[g], j, (v[k[g]] + v[k[g] + 1]) / 2)
            features[t, i], cuts[t, i] = best[1], best[2]
            here = at == i
            at[here] = 2 * i + 1 + (x[bag[here], best[1]] > best[2])
        for leaf in range(inner + 1):
            rows = bag[at == inner + leaf]
            values[t, leaf] = y[rows].mean() if len(rows) else share[inner + leaf]
    return Forest(features, cuts, values)
