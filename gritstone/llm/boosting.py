"""Histogram gradient-boosted trees (logistic loss) in numpy, flattened for array traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in shared arrays. A leaf points to itself, so every row takes ``depth`` steps."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    l2: float = 1.0, min_hessian: float = 1.0,
) -> Forest:
    """Trees over ``x`` (rows, features) for labels 0 or 1. One class or no row: a constant forest."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        coded = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            at = np.full(len(y), len(nodes))
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            level = [roots[-1]]
            for d in range(depth + 1):
                ids = {n: i for i, n in enumerate(level)}
                live = np.isin(at, level)
                slot = np.array([ids[n] for n in at[live]], dtype=np.int64)
                size = len(level) * bins
                gs, hs = np.bincount(slot, g[live], len(level)), np.bincount(slot, h[live], len(level))
                for i, n in enumerate(level):
                    nodes[n][4] = float(-rate * gs[i] / (hs[i] + l2))
                if d == depth:
                    break
                best = np.full(len(level), 1e-6)
                pick: list[tuple[int, int] | None] = [None] * len(level)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    key = slot * bins + coded[live, f]
                    gl = np.bincount(key, g[live], size).reshape(-1, bins).cumsum(1)[:, : len(cuts[f])]
                    hl = np.bincount(key, h[live], size).reshape(-1, bins).cumsum(1)[:, : len(cuts[f])]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None]
                    gain[(hl < min_hessian) | (hr < min_hessian)] = -1
                    top = gain.argmax(1)
                    for i in np.nonzero(gain[np.arange(len(level)), top] > best)[0]:
                        best[i], pick[i] = gain[i, top[i]], (f, int(top[i]))
                nxt: list[int] = []
                for n, chosen in zip(level, pick):
                    if chosen is None:
                        continue
                    f, cut = chosen
                    a, b = len(nodes), len(nodes) + 1
                    nodes[n][:4] = [f, float(cuts[f][cut]), a, b]
                    nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, b, b, 0.0]]
                    mine = at == n
                    at[mine] = np.where(coded[mine, f] <= cut, a, b)
                    nxt += [a, b]
                level = nxt
                if not level:
                    break
            table = np.array([n[4] for n in nodes])
            margin += table[at]
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Forest(
        base, np.array(roots, dtype=np.int64), a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64),
        a[:, 3].astype(np.int64), a[:, 4], depth,
    )
