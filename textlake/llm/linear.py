"""A small logistic model on a bounded sample of feature rows, fitted with numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

KNOTS = (-1.0, 0.0, 1.0, 2.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Weights over standardised features and their hinges at ``KNOTS``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, *[np.maximum(z - c, 0) for c in KNOTS]], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.design(x) @ self.weights)


def standard(x: np.ndarray) -> Model:
    """A model of the features' mean and spread, all weights 0."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    return Model(mean, scale, np.zeros(1 + x.shape[1] * (1 + len(KNOTS))))


def descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Gradient steps with running first and second moments (Adam)."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
