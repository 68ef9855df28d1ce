"""Count, means and co-moments of many columns as a state that can be merged, numpy.

For each pair of columns only the rows count in which both are there, so the state holds four square
matrices: ``n`` rows, ``mean`` of the first column, ``square`` (its squared distances from that mean) and
``cross`` (products of both distances). They are centred, so large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Moments:
    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        """State of rows by columns; NaN is missing."""
        there = ~np.isnan(rows)
        count = there.sum(0)
        first = np.divide(np.where(there, rows, 0).sum(0), count, out=np.zeros(rows.shape[1]), where=count > 0)
        # distances from the columns' own means; the pairs' means are near them
        near = np.where(there, rows - first, 0.0)
        mask = there.astype(float)
        n = mask.T @ mask
        some = np.maximum(n, 1)
        shift = near.T @ mask / some
        square = np.maximum((near * near).T @ mask - some * shift * shift, 0)
        cross = near.T @ near - some * shift * shift.T
        return cls(n, np.where(n > 0, first[:, None] + shift, 0), square, cross)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        some = np.maximum(n, 1)
        step = other.mean - self.mean
        weight = self.n * other.n / some
        mean = np.where(self.n == 0, other.mean, np.where(other.n == 0, self.mean, self.mean + step * (other.n / some)))
        return Moments(n, mean, self.square + other.square + step * step * weight, self.cross + other.cross + step * step.T * weight)

    @classmethod
    def total(cls, states: Iterable[Moments]) -> Moments:
        first, *rest = states
        for state in rest:
            first = first.merge(state)
        return first

    def correlations(self) -> np.ndarray:
        """Pearson correlation per pair; NaN for a constant column or fewer than two rows."""
        spread = np.sqrt(self.square * self.square.T)
        # what rounding leaves of a constant column is no spread
        flat = self.square <= 1e-24 * np.maximum(self.n, 1) * self.mean**2
        return np.divide(self.cross, spread, out=np.full_like(spread, np.nan), where=(spread > 0) & ~flat & ~flat.T & (self.n > 1))

    def pack(self) -> list[list[float]]:
        return [x.ravel().tolist() for x in (self.n, self.mean, self.square, self.cross)]

    @classmethod
    def unpack(cls, parts: Iterable) -> Moments:
        arrays = [np.asarray(x, float) for x in parts]
        width = int(round(len(arrays[0]) ** 0.5))
        return cls(*(x.reshape(width, width) for x in arrays))
