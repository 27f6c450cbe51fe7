"""Small regression trees on binned statistics, as flat numpy arrays.

Used on bounded samples only: by the boosted quality model (scored in
tasks) and by the rule ensemble (whose paths become column expressions).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node arrays; a leaf has ``feature`` -1. Rows with x <= threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)


def bin_edges(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Candidate thresholds of each column: midpoints between its quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        if len(v) > bins:
            v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="nearest"))
        out.append((v[:-1] + v[1:]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds the values with edges[b-1] < x <= edges[b]."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) \
        if edges else np.zeros((len(x), 0), dtype=np.int64)


def grow(xb: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, *, depth: int,
         min_weight: float, ridge: float = 1.0, monotone: dict[int, int] | None = None,
         features: np.ndarray | None = None) -> Tree:
    """One second-order tree. ``monotone[j]`` is +1 or -1 where the output must
    not fall (rise) as column j grows: such splits are refused when the
    children's values disagree, and the children keep within their midpoint."""
    monotone = monotone or {}
    features = np.arange(len(edges)) if features is None else features
    nodes: list[list[float]] = []

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, weight(g, h, low, high)])
        best, best_gain = None, 1e-6
        if level < depth and len(rows) > 1:
            for j in features:
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                gl = np.cumsum(np.bincount(xb[rows, j], weights=grad[rows], minlength=k))[:-1]
                hl = np.cumsum(np.bincount(xb[rows, j], weights=hess[rows], minlength=k))[:-1]
                gr, hr = g - gl, h - hl
                gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - g ** 2 / (h + ridge)
                ok = (hl >= min_weight) & (hr >= min_weight)
                if j in monotone:
                    wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    ok &= monotone[j] * (wr - wl) >= 0
                gain = np.where(ok, gain, -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > best_gain:
                    best, best_gain = (int(j), at, gl[at], hl[at]), gain[at]
        if best is None:
            return here
        j, at, gl, hl = best
        goes_left = xb[rows, j] <= at
        lows, highs = [low, low], [high, high]
        if j in monotone:
            mid = (weight(gl, hl, low, high) + weight(g - gl, h - hl, low, high)) / 2
            if monotone[j] > 0:
                highs[0], lows[1] = mid, mid
            else:
                lows[0], highs[1] = mid, mid
        left = build(rows[goes_left], level + 1, lows[0], highs[0])
        right = build(rows[~goes_left], level + 1, lows[1], highs[1])
        nodes[here][:4] = [j, float(edges[j][at]), left, right]
        return here

    build(np.arange(len(xb)), 0, -np.inf, np.inf)
    a = np.array(nodes, dtype=float)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


def boost(x: np.ndarray, y: np.ndarray, weights: np.ndarray, *, rounds: int, depth: int, rate: float,
          min_weight: float, seed: int, subsample: float = 1.0, columns: float = 1.0,
          monotone: dict[int, int] | None = None) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting; returns the base margin and the trees (already scaled by ``rate``)."""
    rng = np.random.default_rng(seed)
    p0 = np.clip(np.average(y, weights=weights), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    edges = bin_edges(x)
    xb = binned(x, edges)
    margin = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weights * (p - y), weights * np.maximum(p * (1 - p), 1e-6)
        rows = np.flatnonzero(rng.random(len(y)) < subsample) if subsample < 1 else np.arange(len(y))
        if not len(rows):
            break
        cols = np.sort(rng.choice(len(edges), max(1, round(columns * len(edges))), replace=False))
        t = grow(xb[rows], edges, grad[rows], hess[rows], depth=depth, min_weight=min_weight,
                 monotone=monotone, features=cols)
        t.value *= rate
        margin += t.predict(x)
        trees.append(t)
    return base, trees
