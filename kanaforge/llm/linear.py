"""Sparse logistic regression over hashed features, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np


def sigmoid(x):
    return np.where(np.isneginf(x), 0.0, 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


@dataclass
class Ftrl:
    """FTRL-proximal with one learning rate per coordinate; the last coordinate is the bias."""

    dim: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros(self.dim + 1)
        self.n = np.zeros(self.dim + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.sign(z) * self.l1 - z
        w = free / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        bias = np.arange(self.dim + 1)[at] == self.dim
        return np.where((np.abs(z) <= self.l1) & ~bias, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int, importance: float) -> None:
        """One example; at holds distinct coordinates."""
        at = np.append(at, self.dim)
        x = np.append(x, 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * importance * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: Iterable[tuple[np.ndarray, np.ndarray, int]], importance: dict[int, float], epochs: int) -> "Ftrl":
        rows = list(rows)
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                at, x, y = rows[i]
                self.update(at, x, y, importance[y])
        return self


def ordered(rows: list[tuple]) -> list[tuple]:
    """Training rows (coordinates, ..., label) in an order of their own, whatever the order in which they came.

    Coordinates are compared only between rows of one label and length, so no copy of all of them is made."""
    groups: dict[tuple[int, int], list[tuple]] = {}
    for row in rows:
        groups.setdefault((row[-1], len(row[0])), []).append(row)
    return [row for key in sorted(groups) for row in sorted(groups[key], key=lambda r: [c.tobytes() for c in r[:-1]])]
