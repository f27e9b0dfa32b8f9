"""Sparse softmax regression by follow-the-regularised-leader with an elastic net."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # features and their values


class Ftrl:
    """Per-coordinate FTRL-proximal over ``features`` and ``classes``.

    The last feature is the constant one, which is not penalised by the first norm.
    """

    def __init__(
        self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0
    ):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.constant = features

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        kept = np.abs(z) - self.l1
        w = np.where(kept > 0, -np.sign(z) * kept / rate, 0.0)
        own = np.arange(len(self.z))[at] == self.constant
        w[own] = -z[own] / rate[own]
        return w

    def fit(self, rows: Sequence[Row], labels: np.ndarray, passes: int, seed: int = 0) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(passes):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                at, x = np.append(at, self.constant), np.append(x, 1.0)
                w = self.weights(at)
                p = softmax(x @ w)
                p[labels[i]] -= 1.0
                g = x[:, None] * p[None, :]
                n = self.n[at]
                grown = n + g * g
                self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[at] = grown
        return self


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def scores(rows: Sequence[Row], weights: np.ndarray) -> np.ndarray:
    """Logits; the last row of ``weights`` is the constant."""
    if not rows:
        return np.zeros((0, weights.shape[1]))
    return np.stack([x @ weights[at] + weights[-1] for at, x in rows])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a fine logarithmic grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    if not len(labels):
        return 1.0
    at = np.arange(len(labels))
    losses = [-np.log(softmax(logits / t)[at, labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])
