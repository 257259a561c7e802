"""Hashed features of texts and logistic regression on them, in NumPy."""

from __future__ import annotations

import numpy as np

from ._text import Texts, group_sums, owners


def char_grams(texts: Texts, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bucket of each run of ``size`` characters (code points), and how many each text has (none for a shorter one)."""
    points, offsets = texts.points()
    n = np.maximum(0, np.diff(offsets) - size + 1)
    m = len(points) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), n * 0
    code = np.zeros(m, np.uint64)
    for i in range(size):
        code = (code << np.uint64(21)) + (code >> np.uint64(43)) + points[i : i + m]
    bucket = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    if texts.n > 1 and size > 1:
        last = np.repeat(offsets[1:], np.diff(offsets))[:m]
        bucket = bucket[np.arange(m) + size <= last]
    return bucket.astype(np.int64), n


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray):
        self.index, self.value, self.counts = index, value, counts
        self.owner = owners(counts)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.value * w[self.index], minlength=len(self.counts))

    def transposed_times(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.owner], minlength=width)

    def take(self, keep: np.ndarray) -> Rows:
        inner = keep[self.owner]
        return Rows(self.index[inner], self.value[inner], self.counts[keep])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Rows, y: np.ndarray, width: int, l2: float = 1e-3, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch gradient steps with per-weight scaling; both classes weigh the same."""
    w, b = np.zeros(width), 0.0
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / max(1, len(y))
    first, second, fb, sb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (sigmoid(x.times(w) + b) - y) * weight
        gw, gb = x.transposed_times(g, width) + l2 * w, g.sum()
        first, second, fb, sb = 0.9 * first + 0.1 * gw, 0.99 * second + 0.01 * gw * gw, 0.9 * fb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (first / c1) / (np.sqrt(second / c2) + 1e-8)
        b -= rate * (fb / c1) / (np.sqrt(sb / c2) + 1e-8)
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Calibration ``sigmoid(a * score + b)`` by Newton steps on smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        v = p * (1 - p) + 1e-9
        ga, gb = ((p - t) * score).sum() + 1e-6 * a, (p - t).sum()
        haa, hab, hbb = (v * score * score).sum() + 1e-6, (v * score).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return max(a, 1e-3), b


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """Fold of each row by a hash of its id."""
    from ._text import mix

    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(k)).astype(np.int64)


def text_means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return group_sums(values, counts) / np.maximum(1, counts)
