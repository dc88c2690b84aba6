"""Gradient-boosted trees: fitted in numpy on a bounded table, applied as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float, least: int):
    """A tree as (feature, threshold, left, right), or a leaf's value: a Newton step."""
    leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    base = total_g**2 / (total_h + 1.0)
    for f in range(x.shape[1]):
        values = x[rows, f]
        order = np.argsort(values, kind="stable")
        v = values[order]
        gl, hl = np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
        ok = v[1:] > v[:-1]
        ok[: least - 1] = ok[len(ok) - least + 1 :] = False
        if not ok.any():
            continue
        gain = np.where(ok, gl**2 / (hl + 1.0) + (total_g - gl) ** 2 / (total_h - hl + 1.0) - base, -1.0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, g, h, rows[left], depth - 1, rate, least), _grow(x, g, h, rows[~left], depth - 1, rate, least))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, low, high = tree
    return np.where(x[:, f] <= at, _apply(low, x), _apply(high, x))


def _column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, at, low, high = tree
    return F.when(F.get(x, F.lit(f)) <= at, _column(low, x)).otherwise(_column(high, x))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple
    scale: float
    shift: float
    #: probability from which a candidate of each kind is taken
    thresholds: tuple[float, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(_apply(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.raw(x) + self.shift)

    def column(self, x: Column) -> Column:
        """The calibrated probability from an array<double> of features."""
        raw = F.lit(self.start)
        for t in self.trees:
            raw = raw + _column(t, x)
        return 1.0 / (1.0 + F.exp(-(raw * self.scale + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, kind: np.ndarray, kinds: int, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, precision: float = 0.99) -> Model:
    """Trees on the even rows; calibration (Platt) and each kind's threshold for the precision on the odd ones."""
    fit_rows, held = np.arange(0, len(y), 2), np.arange(1, len(y), 2)
    p0 = float(np.clip(y[fit_rows].mean(), 0.01, 0.99))
    start, trees = float(np.log(p0 / (1 - p0))), []
    z = np.full(len(y), start)
    for _ in range(rounds):
        p = _sigmoid(z)
        tree = _grow(x, y - p, p * (1 - p), fit_rows, depth, rate, least)
        trees.append(tree)
        z = z + _apply(tree, x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on two parameters
        p = _sigmoid(a * z[held] + b)
        d = np.stack([z[held], np.ones(len(held))])
        grad = d @ (y[held] - p) - np.array([1e-2 * (a - 1), 0])
        hess = (d * (p * (1 - p))) @ d.T + np.eye(2) * 1e-2
        step = np.linalg.solve(hess, grad)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    p = _sigmoid(a * z[held] + b)
    thresholds = []
    for k in range(kinds):
        mine = kind[held] == k
        order = np.argsort(-p[mine])
        hit = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(hit >= precision)
        thresholds.append(max(0.5, float(p[mine][order][good[-1]])) if len(good) else 1.1)
    return Model(start, tuple(trees), a, b, tuple(thresholds))
