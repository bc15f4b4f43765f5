"""A linear-chain conditional random field in numpy: fitted by stochastic gradients, decoded by Viterbi in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Weights of (feature, label) and of (label, next label)."""

    emit: np.ndarray
    step: np.ndarray

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Labels of all tokens of sequences laid end to end; features has the feature numbers of each token."""
        labels, n = self.step.shape[0], len(lengths)
        out = np.zeros(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        scores = self.emit[features].sum(1)
        for a in range(0, n, 4096):
            part = order[a : a + 4096]
            part = part[lengths[part] > 0]
            if not len(part):
                continue
            size, at = lengths[part], starts[part]
            longest = int(size[0])
            back = np.zeros((longest, len(part), labels), np.int8)
            state = scores[at]
            for t in range(1, longest):
                alive = int(np.searchsorted(-size, -t))  # sequences longer than t come first
                ways = state[:alive, :, None] + self.step
                back[t, :alive] = ways.argmax(1)
                state[:alive] = ways.max(1) + scores[at[:alive] + t]
            label = state.argmax(1)
            rows = np.arange(len(part))
            for t in range(longest - 1, -1, -1):
                alive = int(np.searchsorted(-size, -t))
                out[at[:alive] + t] = label[:alive]
                if t:
                    label[:alive] = back[t, rows[:alive], label[:alive]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], features: int, labels: int, rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """From (feature numbers of each token, labels), by gradients of the likelihood with adapted rates."""
    emit, step = np.zeros((features, labels)), np.zeros((labels, labels))
    emit_sum, step_sum = np.full_like(emit, 1e-6), np.full_like(step, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(sequences)):
            x, y = sequences[i]
            n, score = len(x), emit[x].sum(1)
            ahead, behind = np.empty((n, labels)), np.zeros((n, labels))
            ahead[0] = score[0]
            for t in range(1, n):
                ahead[t] = score[t] + _log_sum(ahead[t - 1][:, None] + step, 0)
            for t in range(n - 2, -1, -1):
                behind[t] = _log_sum(step + (score[t + 1] + behind[t + 1])[None], 1)
            whole = _log_sum(ahead[-1], 0)
            one = np.exp(ahead + behind - whole)
            one[np.arange(n), y] -= 1
            two = np.exp(ahead[:-1, :, None] + step + (score + behind)[1:, None] - whole).sum(0)
            np.subtract.at(two, (y[:-1], y[1:]), 1)
            used, where = np.unique(x.ravel(), return_inverse=True)
            grad = np.zeros((len(used), labels))
            np.add.at(grad, where, np.repeat(one, x.shape[1], 0))
            grad += decay * emit[used]
            emit_sum[used] += grad**2
            emit[used] -= rate * grad / np.sqrt(emit_sum[used])
            step_sum += two**2
            step -= rate * two / np.sqrt(step_sum)
    return Chain(emit, step)
