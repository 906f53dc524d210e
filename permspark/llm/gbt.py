"""Gradient-boosted trees for a yes/no target, kept as flat numpy arrays of nodes.

Training works on a bounded sample in memory; scoring walks all rows and all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node k splits on feature[k] at threshold[k]; a leaf points at itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log odds per row; a missing feature counts as zero."""
        x = np.nan_to_num(np.asarray(x, dtype=np.float64))
        out = np.full(len(x), self.base)
        for start in range(0, len(x), rows):
            part = x[start : start + rows]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            line = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[line, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[start : start + rows] += self.value[at].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def _best_split(grad, hess, codes, members, bins, monotone, low, high, l2, least):
    """Gain, feature, bin and the two leaf weights of the best allowed split, or None."""
    g_all, h_all = grad[members].sum(), hess[members].sum()
    best, parent = None, g_all**2 / (h_all + l2)
    for f in range(codes.shape[1]):
        code = codes[members, f]
        g = np.bincount(code, grad[members], bins)[:-1].cumsum()
        h = np.bincount(code, hess[members], bins)[:-1].cumsum()
        n = np.bincount(code, minlength=bins)[:-1].cumsum()
        wl = np.clip(-g / (h + l2), low, high)
        wr = np.clip(-(g_all - g) / (h_all - h + l2), low, high)
        gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - parent
        allowed = (n >= least) & (len(members) - n >= least) & (monotone[f] * (wr - wl) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        b = int(gain.argmax())
        if gain[b] > 1e-6 and (best is None or gain[b] > best[0]):
            best = (float(gain[b]), f, b, float(wl[b]), float(wr[b]))
    return best


def train(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    l2: float = 1.0,
    least: int = 5,
    bins: int = 64,
) -> Forest:
    """Second-order boosting of the logistic loss over quantile bins.

    monotone[f] is 1 or -1 where the score may only rise or fall with feature f, else 0. A split on such a
    feature orders its two weights, and the mean of both bounds everything below, so the order holds for whole trees.
    """
    x = np.nan_to_num(np.asarray(x, dtype=np.float64))
    y = np.asarray(y, dtype=np.float64)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(x), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(weight: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(rate * weight)
        return k

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(node(float(-grad.sum() / (hess.sum() + l2))))
        level = [(roots[-1], np.arange(len(x)), -np.inf, np.inf)]
        for _ in range(depth):
            below = []
            for k, members, low, high in level:
                split = _best_split(grad, hess, codes, members, bins, monotone, low, high, l2, least)
                if split is None:
                    margin[members] += value[k]
                    continue
                _, f, b, wl, wr = split
                side = codes[members, f] <= b
                feature[k], threshold[k], left[k], right[k] = f, float(cuts[f][b]), node(wl), node(wr)
                middle = (wl + wr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[monotone[f]]
                below += [(left[k], members[side], *bounds[0]), (right[k], members[~side], *bounds[1])]
            level = below
        for k, members, _, _ in level:
            margin[members] += value[k]
    return Forest(
        np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base
    )
