"""Multinomial logistic regression over sparse binary features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _sums(values: np.ndarray, starts: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; zero where there are none."""
    if not len(values):
        return np.zeros((len(starts), values.shape[1]))
    out = np.add.reduceat(values, np.minimum(starts, len(values) - 1), axis=0)
    out[empty] = 0.0
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Logistic:
    """``weights`` features x classes and ``bias``. A row is an array of feature numbers."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def scores(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(rows) else np.empty(0, np.int64)
        return _sums(self.weights[flat], starts, sizes == 0) + self.bias

    def probabilities(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return softmax(self.scores(rows))

    @classmethod
    def fit(
        cls, rows: Sequence[np.ndarray], classes: np.ndarray, features: int, n_classes: int, penalty: float = 1e-4, rounds: int = 80, rate: float = 0.1
    ) -> Logistic:
        """Fitted by full-batch Adam; deterministic."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate(rows).astype(np.int64)
        used, flat = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of_row = np.repeat(np.arange(len(rows)), sizes)
        truth = np.eye(n_classes)[classes]
        weights, bias = np.zeros((len(used), n_classes)), np.log(truth.mean(axis=0) + 1e-3)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, bias)]
        for step in range(1, rounds + 1):
            error = (softmax(_sums(weights[flat], starts, sizes == 0) + bias) - truth) / len(rows)
            gradient = np.stack([np.bincount(flat, error[of_row, k], len(used)) for k in range(n_classes)], axis=1)
            for x, g, (m, v) in zip((weights, bias), (gradient + penalty * weights, error.sum(axis=0)), moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        full = np.zeros((features, n_classes))
        full[used] = weights
        return cls(full, bias)
