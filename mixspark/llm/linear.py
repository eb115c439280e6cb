"""Small logistic models in numpy, for features that fit on the driver (a bounded sample)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def proba(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """Ridge logistic regression by Newton steps. Without rows, or with one class only, the score is
    the smoothed share of ones."""
    n, d = x.shape
    mean = x.mean(0) if n else np.zeros(d)
    scale = x.std(0) if n else np.ones(d)
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = np.zeros(d + 1)
    share = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(share / (1 - share))
    if n and 0 < y.sum() < n:
        z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(n)])
        penalty = np.append(np.full(d, ridge), 1e-6)
        for _ in range(steps):
            p = sigmoid(z @ w)
            g = z.T @ (p - y) + penalty * w
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
    return Logistic(mean, scale, w)
