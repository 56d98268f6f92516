"""Follow-the-regularised-leader with an elastic-net penalty, for the small fits of this subpackage."""

from __future__ import annotations

import numpy as np


class Leader:
    """Weights of ``features`` x ``outputs``, kept as sums of gradients; most weights stay exactly zero."""

    def __init__(self, features: int, outputs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.5, positive: bool = False):
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.minimum(z + self.l1, 0) if self.positive else np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        """One update of the distinct features ``at`` whose current weights are ``weights``."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = grown


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits under which ``truth`` is likeliest: golden-section search over its logarithm."""

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    low, high, golden = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
