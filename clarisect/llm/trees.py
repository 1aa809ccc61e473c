"""Small boosted decision trees on NumPy, for samples of bounded size that the driver holds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    """A sum of shallow trees on the log-odds scale; a row goes left when its value is at most the threshold."""

    base: float
    trees: list[Node] = field(default_factory=list)

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), out)
        return out

    def _add(self, node: Node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if node.feature < 0:
            out[rows] += node.value
            return
        left = x[rows, node.feature] <= node.threshold
        self._add(node.left, x, rows[left], out)
        self._add(node.right, x, rows[~left], out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 64, share: float = 0.7, smooth: float = 1.0, least: int = 5, seed: int = 1) -> Boosted:
    """Gradient boosting of the logistic loss with Newton leaves over quantile cuts; same inputs, same trees."""
    rng = np.random.default_rng(seed)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return model
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[:-1] + values[1:]) / 2
        edges.append(middle if len(middle) <= cuts else np.unique(np.quantile(middle, np.linspace(0, 1, cuts))))
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Node:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        node = Node(rate * total_g / (total_h + smooth))
        if left == 0 or len(rows) < 2 * least:
            return node
        best, gain = None, 1e-6
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            sums = np.cumsum(np.stack([np.bincount(b, w, len(edges[f]) + 1) for w in (g[rows], h[rows], np.ones(len(rows)))]), axis=1)[:, :-1]
            gl, hl, nl = sums
            score = gl**2 / (hl + smooth) + (total_g - gl) ** 2 / (total_h - hl + smooth) - total_g**2 / (total_h + smooth)
            score[(nl < least) | (len(rows) - nl < least)] = 0
            k = int(score.argmax())
            if score[k] > gain + 1e-9:
                best, gain = (f, k), score[k]
        if best is not None:
            f, k = best
            go = binned[rows, f] <= k
            node.feature, node.threshold = f, float(edges[f][k])
            node.left, node.right = grow(rows[go], g, h, left - 1), grow(rows[~go], g, h, left - 1)
        return node

    for _ in range(trees):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < share)
        tree = grow(rows, y - p, p * (1 - p), depth)
        if tree.feature < 0:
            break
        model.trees.append(tree)
        z += Boosted(0.0, [tree]).decision(x)
    return model
