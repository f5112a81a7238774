"""Cumulative-link ordinal regression on sparse hashed features.

P(grade >= k) = sigmoid(s - t_k) with one score s = w . x for all grades and thresholds
t_1 < t_2 < ...; the weights are shared, so every grade boundary learns from all
examples. Fitting is full-batch accelerated proximal gradient with an L1 penalty on a
sample whose bound the caller states; it is deterministic.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

#: Hashed feature space.
BITS = 31
SIZE = 1 << BITS


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (SIZE - 1)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


@dataclass
class CumulativeLink:
    """weights: {bucket: weight}, nonzero ones only; thresholds: ascending, one fewer than grades."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [0.0])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return sigmoid(np.asarray(score, dtype=float)[:, None] - np.array(self.thresholds)[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of the tail probabilities."""
        return self.tails(score).sum(axis=1)


#: Change of all weights and thresholds in a step under which the fit has settled.
SETTLED = 1e-6


def fit(rows: list[tuple], grades: list[int], l1: float = 1e-4, steps: int = 400, least_rows: int = 3, levels: int | None = None) -> CumulativeLink:
    """rows: (buckets, values) of each example, buckets distinct within a row; levels: number of grades (by default those met).

    Grades that do not occur are skipped over; with one grade only the model has no weights and its
    thresholds say so (every tail probability is near 0 or 1), and without examples each tail is 0.5.
    Buckets in under least_rows examples get no weight. The fit ends when it has settled, or after steps.
    """
    levels = levels or max(2, int(max(grades, default=0)) + 1)
    if not rows:
        return CumulativeLink({}, [0.0] * (levels - 1))
    if len(set(grades)) < 2:
        return CumulativeLink({}, [-9.0 if k <= grades[0] else 9.0 for k in range(1, levels)])
    y = np.array(grades)
    lens = np.array([len(r[0]) for r in rows])
    cols = np.concatenate([np.asarray(r[0], dtype=np.int32) for r in rows]) if lens.sum() else np.zeros(0, np.int32)
    vals = np.concatenate([np.asarray(r[1], dtype=np.float32) for r in rows]) if lens.sum() else np.zeros(0, np.float32)
    which = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    names, cols, often = np.unique(cols, return_inverse=True, return_counts=True)
    keep = (often >= least_rows)[cols]
    names, cols, vals, which = names[often >= least_rows], cols[keep], vals[keep], which[keep]
    cols = (np.cumsum(often >= least_rows) - 1)[cols]
    n, d = len(rows), len(names)
    # Features get unit root mean square, so that one penalty suits rare and frequent ones.
    scale = np.sqrt(np.bincount(cols, vals**2, minlength=d) / n)
    vals = vals / np.where(scale[cols] > 0, scale[cols], 1.0) if d else vals

    def forward(w):
        return np.bincount(which, vals * w[cols], minlength=n)

    def back(g):
        return np.bincount(cols, vals * g[which], minlength=d) / n

    v = np.full(d, 1.0)
    bound = 1.0
    for _ in range(25):
        v = back(forward(v))
        bound = float(np.linalg.norm(v)) or 1.0
        v /= bound
    step_w, step_t = 1.0 / (0.3 * bound + 1e-9), 1.0
    shares = np.array([(y >= k).mean() for k in range(1, levels)])
    t = -np.log(np.clip(shares, 1e-3, 1 - 1e-3) / np.clip(1 - shares, 1e-3, 1 - 1e-3))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(levels - 1))
    w, w_at, t_at, momentum = np.zeros(d), np.zeros(d), t.copy(), 1.0
    for _ in range(steps):
        s = forward(w_at)
        edges = np.concatenate([[-np.inf], t_at, [np.inf]])
        with np.errstate(over="ignore"):
            high, low = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
        p = np.maximum(high - low, 1e-9)
        grad_w = back(1.0 - high - low)
        up, down = -high * (1 - high) / p, low * (1 - low) / p
        grad_t = np.array([up[y == k].sum() + down[y == k + 1].sum() for k in range(levels - 1)]) / n
        new_w = w_at - step_w * grad_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step_w * l1, 0.0)
        # Thresholds stay in order, at least a thousandth apart.
        new_t = np.maximum.accumulate(t_at - step_t * grad_t - 1e-3 * np.arange(levels - 1)) + 1e-3 * np.arange(levels - 1)
        new_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / new_momentum
        w_at, t_at = new_w + pull * (new_w - w), new_t + pull * (new_t - t)
        t_at = np.maximum.accumulate(t_at - 1e-3 * np.arange(levels - 1)) + 1e-3 * np.arange(levels - 1)
        moved = max(np.abs(new_w - w).max(initial=0.0), np.abs(new_t - t).max(initial=0.0))
        w, t, momentum = new_w, new_t, new_momentum
        if moved < SETTLED:
            break
    weights = {int(b): float(x) for b, x in zip(names, w / np.where(scale > 0, scale, 1.0), strict=True) if x != 0.0}
    return CumulativeLink(weights, [float(x) for x in t])
