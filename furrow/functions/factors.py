"""Gradients of factorization machines over blocks of rows, and their steps, numpy.

A machine of rank k predicts ``b + x w + sum over f of ((x V_f)^2 - x^2 V_f^2) / 2``. Its linear weights are the last column
of ``weights``, its factors the others. Blocks keep the values of their rows that are not 0, and are laid out whole one at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

# Values of a block once it is laid out whole: 2 MB.
CELLS = 1 << 18


def packed(rows: np.ndarray, labels: np.ndarray) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Blocks of dense rows: labels, where a value other than 0 stands, and the values."""
    step = max(1, CELLS // max(1, rows.shape[1]))
    for i in range(0, len(rows), step):
        flat = rows[i:i + step].ravel()
        at = np.flatnonzero(flat).astype(np.uint32)
        yield labels[i:i + step].astype(float).tobytes(), at.tobytes(), flat[at].tobytes()


def gradient(blocks: Iterable[tuple[bytes, bytes, bytes]], weights: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
    """Sums over all rows of the squared error's slopes by ``weights`` and by the intercept."""
    width, factors = len(weights), weights[:, :-1]
    squares, slopes, curved, slope = (factors * factors).sum(1), np.zeros(weights.shape), np.zeros(width), 0.0
    for labels, at, values in blocks:
        y = np.frombuffer(labels)
        x = np.zeros((len(y), width))
        x.ravel()[np.frombuffer(at, np.uint32)] = np.frombuffer(values)
        sums, x2 = x @ weights, x * x
        found = intercept + sums[:, -1] + 0.5 * ((sums[:, :-1] ** 2).sum(1) - x2 @ squares)
        twice = 2 * (found - y)
        sums[:, -1] = 1
        slopes += x.T @ (sums * twice[:, None])
        curved += x2.T @ twice
        slope += twice.sum()
    slopes[:, :-1] -= factors * curved[:, None]
    return slopes, slope


@dataclass
class Steps:
    """Adam with decoupled weight decay, with MLlib's constants; ``decay`` is its ``regParam``."""

    rate: float
    decay: float
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0
    taken: int = 0

    def after(self, weights: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        self.taken += 1
        self.first = 0.9 * self.first + 0.1 * slopes
        self.second = 0.999 * self.second + 0.001 * (slopes * slopes)
        first, second = self.first / (1 - 0.9 ** self.taken), self.second / (1 - 0.999 ** self.taken)
        return weights - (self.rate * first / (np.sqrt(second) + 1e-8) + self.decay * weights)


def settled(before: np.ndarray, after: np.ndarray, tol: float) -> bool:
    return bool(np.linalg.norm(before - after) < tol * max(np.linalg.norm(after), 1.0))
