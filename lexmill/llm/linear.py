"""Sparse linear models trained by follow-the-regularised-leader (FTRL-proximal) with elastic net."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Multinomial logistic regression on sparse rows; weights appear only where the L1 penalty lets them."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.z, self.n = np.zeros((classes, features)), np.zeros((classes, features))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)

    def update(self, index: np.ndarray, value: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One step on a row; target has a probability for each class."""
        z, n = self.z[:, index], self.n[:, index]
        w = self._weights(z, n)
        g = weight * (softmax(w @ value) - target)[:, None] * value
        square = g * g
        self.z[:, index] = z + g - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[:, index] = n + square


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The T that gives softmax(logits / T) the least log loss on held-back rows; golden section over log T."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.clip((p * target).sum(axis=1), 1e-12, 1)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
