"""Logistic regression on bounded samples, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Marks:
    """A matrix of zeros and ones, given by the places of the ones; it multiplies vectors like an array."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=vector[self.columns], minlength=self.shape[0])

    @property
    def T(self) -> Marks:
        return Marks(self.columns, self.rows, self.shape[::-1])


def fit(matrix: np.ndarray | Marks, labels: np.ndarray, l1: float = 0.0, l2: float = 0.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss with a lasso and a ridge penalty on the weights.

    Accelerated proximal gradient with restarts; the step is the inverse of a bound of the curvature.
    """
    rows, columns = matrix.shape
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    weights, intercept = np.zeros(columns), float(np.log(share / (1 - share)))
    if not columns or labels.min() == labels.max():
        return weights, intercept
    vector = np.random.default_rng(0).normal(size=columns)
    for _ in range(30):  # largest eigenvalue by power iteration
        vector = matrix.T @ (matrix @ vector)
        norm = np.linalg.norm(vector) or 1.0
        vector /= norm
    step = 1 / (0.25 * (norm / rows + 1) * 1.1 + l2)
    ahead, ahead_0, momentum = weights.copy(), intercept, 1.0
    for _ in range(rounds):
        error = sigmoid(matrix @ ahead + ahead_0) - labels
        moved = ahead - step * (matrix.T @ error / rows + l2 * ahead)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        moved_0 = ahead_0 - step * error.mean()
        change, change_0 = moved - weights, moved_0 - intercept
        if change @ (ahead - moved) > 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_0 = moved + (momentum - 1) / following * change, moved_0 + (momentum - 1) / following * change_0
        weights, intercept, momentum = moved, moved_0, following
    return weights, float(intercept)
