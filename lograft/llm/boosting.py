"""A small gradient-boosted tree classifier for bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Perfect binary trees: the feature and cut of each inner node, and the value of each leaf."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        out = np.full(len(x), self.base)
        depth, rows = int(np.log2(self.leaves.shape[1])), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**depth - 1)]
        return out

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.scores(x)))


def _split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: np.ndarray, ridge: float) -> tuple[int, float]:
    """The feature and cut that gain most; a cut at infinity where none gains."""
    n, wide = bins.shape[1], edges.shape[1] + 1
    at = (bins + np.arange(n) * wide).ravel()
    gl, hl = (np.cumsum(np.bincount(at, np.repeat(v, n), n * wide).reshape(n, wide), axis=1)[:, :-1] for v in (grad, hess))
    g, h = grad.sum(), hess.sum()
    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
    gain[~np.isfinite(edges)] = 0
    f, k = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), float(edges[f, k])) if gain[f, k] > 1e-9 else (0, np.inf)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Fit trees to 0/1 labels by Newton steps on the logistic loss."""
    cuts_of = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[:-1], method="lower")) for c in x.T if len(c)]
    edges = np.full((len(cuts_of), bins), np.inf)
    for f, e in enumerate(cuts_of):
        edges[f, : len(e)] = e
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), *(np.zeros((0, n)) for n in (2**depth - 1, 2**depth - 1, 2**depth)))
    score = np.full(len(x), model.base)
    features, cuts, leaves = [], [], []
    more = 0 < y.sum() < len(y)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if more else None
    for _ in range(trees if more else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        f, c, leaf = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth)
        at = np.zeros(len(x), np.int64)
        for node in range(2**depth - 1):
            own = np.nonzero(at == node)[0]
            if len(own):
                f[node], c[node] = _split(binned[own], grad[own], hess[own], edges, ridge)
            at[own] = 2 * node + 1 + (x[own, f[node]] > c[node])
        at -= 2**depth - 1
        leaf = -rate * np.bincount(at, grad, 2**depth) / (np.bincount(at, hess, 2**depth) + ridge)
        score += leaf[at]
        features.append(f), cuts.append(c), leaves.append(leaf)
    if features:
        model = Trees(model.base, np.array(features), np.array(cuts), np.array(leaves))
    model.features = model.features.astype(np.int64)
    return model
