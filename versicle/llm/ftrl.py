"""FTRL-proximal logistic regression with per-coordinate rates and L1 sparsity."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """An online learner over ``size`` hashed coordinates and an unregularised bias.

    A coordinate's rate falls with its own squared gradients; its weight is exactly zero until
    the gradients gathered for it exceed ``l1``, so rare features never enter the model.
    """

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return float(-self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1])))

    def learn(self, at: np.ndarray, values: np.ndarray | float, label: float, weight: float = 1.0) -> None:
        """One step on a row with distinct coordinates ``at``."""
        w, bias = self.weights(at), self.bias()
        wrong = weight * (sigmoid(float((w * values).sum()) + bias) - label)
        gradient = wrong * values
        old = self.n[at]
        self.z[at] += gradient - (np.sqrt(old + gradient**2) - np.sqrt(old)) / self.alpha * w
        self.n[at] = old + gradient**2
        old = self.n[-1]
        self.z[-1] += wrong - (np.sqrt(old + wrong**2) - np.sqrt(old)) / self.alpha * bias
        self.n[-1] = old + wrong**2


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero: what is broadcast."""
    at = np.flatnonzero(weights).astype(np.int32)
    return at, weights[at].astype(np.float32)
