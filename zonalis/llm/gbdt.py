"""Small gradient-boosted trees (logistic loss, histograms) and isotonic calibration, in numpy.

They are fitted on the driver over bounded samples whose bounds are parameters of the callers, and shipped to the
executors as plain arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves, with the learning rate
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: int = 4) -> Trees:
    """Boost `trees` complete trees of `depth` levels; cuts are quantiles. Equal input gives an equal model."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1) if d else np.zeros((n, 0), int)
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    f = np.full(n, base)
    inner = 2**depth - 1
    all_feature, all_cut, all_leaf = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            local = at - first
            for j in range(d):
                if not len(edges[j]):
                    continue
                size = len(edges[j]) + 1
                key = local * size + code[:, j]
                gs = np.bincount(key, g, width * size).reshape(width, size).cumsum(1)
                hs = np.bincount(key, h, width * size).reshape(width, size).cumsum(1)
                ns = np.bincount(key, minlength=width * size).reshape(width, size).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain = np.where((ns >= least) & (nt - ns >= least), gain, 0)[:, :-1]
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], cut[first + i] = top[i], j, edges[j][k[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        local = at - inner
        leaf = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + l2)
        f += leaf[local]
        all_feature.append(feature)
        all_cut.append(cut)
        all_leaf.append(leaf)
    return Trees(edges, np.array(all_feature), np.array(all_cut), np.array(all_leaf), base)


@dataclass
class Isotonic:
    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated probability, with a small share of the raw order kept inside flat steps."""
        p = np.interp(raw, self.x, self.y)
        return np.clip(0.998 * p + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over the order of raw; a step is put at the mean of its members."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += t
    if not blocks:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    a = np.array(blocks)
    return Isotonic(a[:, 2] / a[:, 1], (a[:, 0] + 0.02) / (a[:, 1] + 0.04))
