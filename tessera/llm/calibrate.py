"""Places a classifier's cut so that a given score means 'predict 1'."""

from __future__ import annotations

import numpy as np


def cut_point(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(cut, slope) of raw values z: the middle of the widest gap between neighbouring values at which the balanced error is least, and one over half the distance of the class medians."""
    if len(z) == 0 or y.min() == y.max():
        return 0.0, 1.0
    by = np.argsort(z, kind="stable")
    z, y = z[by], y[by]
    below = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    above = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum())
    error = below + above
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    best = error <= error.min() + 1e-12
    i = int(np.argmax(np.where(best, gap, -1)))
    spread = abs(np.median(z[y == 1]) - np.median(z[y == 0])) / 2
    return float((edges[i] + edges[i + 1]) / 2), float(4.0 / max(spread, 1e-9))


def score(z: np.ndarray, cut: float, slope: float, at: float) -> np.ndarray:
    """A logistic score that equals `at` at the cut."""
    return 1 / (1 + np.exp(-np.clip(slope * (z - cut) + np.log(at / (1 - at)), -30, 30)))
