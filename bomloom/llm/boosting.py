"""Gradient-boosted trees on binned features, with calibrated output."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting of depth-limited trees; deterministic, numpy only.

    ``fit`` needs a bounded labelled sample.  Rows with NaN features aren't
    supported.  ``probability`` is calibrated by Platt scaling on held-out rows.
    """

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 24
    leaf_penalty: float = 1.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
        width = max(len(k) for k in cuts) + 1
        rate = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            tree, leaf = self._grow(coded, cuts, grad, hess, width)
            self.trees.append(tree)
            margin += tree[2][leaf]
        self._calibrate(self.margin(held_x), held_y)
        return self

    def _grow(self, coded: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, width: int):
        n_inner = 2**self.depth - 1
        feature, limit = np.zeros(n_inner, dtype=np.int64), np.full(n_inner, np.inf)
        node = np.zeros(len(grad), dtype=np.int64)
        for level in range(self.depth):
            first = 2**level - 1
            for at in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == at)
                best = (1e-6, -1, 0)
                if len(rows) > 1:
                    g, h = grad[rows], hess[rows]
                    total_g, total_h = g.sum(), h.sum()
                    own = total_g**2 / (total_h + self.leaf_penalty)
                    for f in range(coded.shape[1]):
                        if len(cuts[f]) == 0:
                            continue
                        b = coded[rows, f]
                        gl = np.cumsum(np.bincount(b, g, width))[: len(cuts[f])]
                        hl = np.cumsum(np.bincount(b, h, width))[: len(cuts[f])]
                        gain = gl**2 / (hl + self.leaf_penalty) + (total_g - gl) ** 2 / (total_h - hl + self.leaf_penalty) - own
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    feature[at], limit[at] = best[1], cuts[best[1]][best[2]]
                    node[rows] = 2 * at + 1 + (coded[rows, best[1]] > best[2])
                else:
                    node[rows] = 2 * at + 1
        leaf = node - n_inner
        n_leaves = 2**self.depth
        value = -np.bincount(leaf, grad, n_leaves) / (np.bincount(leaf, hess, n_leaves) + self.leaf_penalty) * self.rate
        return (feature, limit, value), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def _calibrate(self, margin: np.ndarray, y: np.ndarray, steps: int = 200) -> None:
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * margin + b)))
            h = p * (1 - p) + 1e-6
            ga, gb = ((p - y) * margin).mean() + 1e-3 * (a - 1), (p - y).mean()
            a, b = a - 0.5 * ga / (h * margin**2).mean(), b - 0.5 * gb / h.mean()
            a = min(max(a, 0.2), 3.0)
        self.scale = (float(a), float(b))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.margin(x) + self.scale[1])))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which the F1 score on held-out rows is highest: the middle of the best range.

    It is at most 0.5, as for calibrated probabilities the best threshold is half the best F1 score.
    """
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    at = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low = p[order][min(at[-1] + 1, len(p) - 1)]
    return min(float((p[order][at[-1]] + low) / 2), 0.5)
