"""Small decision trees: exact CART training, trees flattened into arrays, vectorised traversal."""

from __future__ import annotations

import numpy as np


class FlatTree:
    """``feature`` is -1 at a leaf; rows go left where ``x[feature] <= threshold``."""

    def __init__(self, feature, threshold, left, right, value):
        self.feature, self.threshold, self.left, self.right, self.value = map(np.asarray, (feature, threshold, left, right, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            node = at[live]
            goes_left = x[live, self.feature[node]] <= self.threshold[node]
            at[live] = np.where(goes_left, self.left[node], self.right[node])
            live = live[self.feature[at[live]] >= 0]
        return self.value[at]


def train_tree(x: np.ndarray, y: np.ndarray, max_depth: int = 8, least: int = 1) -> FlatTree:
    """Gini CART on a small table; ``value`` is the share of label 1."""
    feature, threshold, left, right, value = [], [], [], [], []

    def split(rows: np.ndarray) -> tuple[float, int, float]:
        best = (0.0, -1, 0.0)
        p = y[rows].mean()
        whole = 2 * p * (1 - p) * len(rows)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(rows) - least)]
            if not len(cut):
                continue
            a, b = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(rows) - cut)
            gain = whole - 2 * a * (1 - a) * cut - 2 * b * (1 - b) * (len(rows) - cut)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), f, float((v[cut[i] - 1] + v[cut[i]]) / 2))
        return best

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, float(y[rows].mean()))):
            column.append(v)
        gain, f, cut = split(rows) if depth < max_depth else (0.0, -1, 0.0)
        if f >= 0:
            feature[me], threshold[me] = f, cut
            below = x[rows, f] <= cut
            left[me] = grow(rows[below], depth + 1)
            right[me] = grow(rows[~below], depth + 1)
        return me

    grow(np.arange(len(y)), 0)
    return FlatTree(feature, threshold, left, right, value)
