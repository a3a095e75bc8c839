"""Gradient-boosted trees on a bounded sample: binned fit, monotone features, flat node arrays."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays. A leaf points at itself, so a walk of fixed length ends there."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


class _Nodes:
    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float) -> int:
        at = len(self.value)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(at)
        self.right.append(at)
        self.value.append(value)
        return at


def _best_split(bins, edges, rows, grad, hess, direction, low, high, smallest, shrink):
    """(gain, feature, bin, left value, right value) of the best allowed split, or None."""
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    parent = g_all * g_all / (h_all + shrink)
    best = None
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        codes, size = bins[rows, f], len(cuts) + 1
        g = np.cumsum(np.bincount(codes, grad[rows], size))[:-1]
        h = np.cumsum(np.bincount(codes, hess[rows], size))[:-1]
        n = np.cumsum(np.bincount(codes, minlength=size))[:-1]
        left = np.clip(-g / (h + shrink), low, high)
        right = np.clip(-(g_all - g) / (h_all - h + shrink), low, high)
        gain = g**2 / (h + shrink) + (g_all - g) ** 2 / (h_all - h + shrink) - parent
        fits = (n >= smallest) & (len(rows) - n >= smallest)
        if direction[f]:
            fits &= direction[f] * (right - left) >= 0
        gain = np.where(fits, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
            best = gain[at], f, at, left[at], right[at]
    return best


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Mapping[int, int] | None = None,
    trees: int = 40,
    depth: int = 3,
    bins: int = 64,
    rate: float = 0.2,
    smallest: int = 10,
    shrink: float = 1.0,
) -> Forest:
    """Logistic boosting. monotone: feature to +1 (score may only rise with it) or -1 (only fall).

    A split on a monotone feature is taken only if its sides stand in that order; the middle of the
    two values then bounds both subtrees, so the whole tree keeps the order.
    """
    direction = np.zeros(x.shape[1], int)
    for f, sign in (monotone or {}).items():
        direction[f] = sign
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=False)]
    coded = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=False)]) if edges else None
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes, roots = _Nodes(), []
    total = np.full(len(y), base)
    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        root = nodes.add(0.0)
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for _ in range(depth):
            deeper = []
            for node, rows, low, high in open_nodes:
                found = _best_split(
                    coded, edges, rows, grad, hess, direction, low, high, smallest, shrink
                )
                if found is None:
                    continue
                _, f, at, left, right = found
                is_left = coded[rows, f] <= at
                middle, sign = (left + right) / 2, direction[f]
                nodes.feature[node], nodes.threshold[node] = f, edges[f][at]
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
                sides = bounds.get(sign, ((low, high), (low, high)))
                for side, value, part, (a, b) in (
                    (nodes.left, left, rows[is_left], sides[0]),
                    (nodes.right, right, rows[~is_left], sides[1]),
                ):
                    child = nodes.add(float(rate * value))
                    side[node] = child
                    total[part] += rate * value - nodes.value[node]
                    deeper.append((child, part, a, b))
            open_nodes = deeper
    return Forest(
        np.array(nodes.feature, int), np.array(nodes.threshold, float), np.array(nodes.left, int),
        np.array(nodes.right, int), np.array(nodes.value, float), np.array(roots, int), depth, base,
    )
