"""Paired tests and bootstrap intervals on small vectors (one value per fold or column)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

from lacuna.kernels.transforms import average_ranks


def _interval(draws: np.ndarray, level: float) -> tuple[float, float]:
    tail = 100.0 * (1.0 - level) / 2.0
    low, high = np.percentile(draws, [tail, 100.0 - tail])
    return float(low), float(high)


def fraction_interval(flags: Sequence[bool], draws: int = 10_000, seed: int = 42, level: float = 0.95) -> dict:
    x = np.asarray(flags, dtype=float)
    if not len(x):
        return {"n": 0, "fraction": None, "low": None, "high": None}
    picks = np.random.RandomState(seed).randint(0, len(x), size=(draws, len(x)))
    low, high = _interval(x[picks].mean(axis=1), level)
    return {"n": len(x), "fraction": float(x.mean()), "low": low, "high": high}


def reduction_interval(base: Sequence[float], arm: Sequence[float], draws: int = 10_000, seed: int = 42, level: float = 0.95) -> dict:
    """1 - median(arm)/median(base) with folds resampled together."""
    b, a = np.asarray(base, dtype=float), np.asarray(arm, dtype=float)
    keep = np.isfinite(b) & np.isfinite(a)
    b, a = b[keep], a[keep]
    if not len(b):
        return {"n": 0, "reduction": None, "low": None, "high": None}
    picks = np.random.RandomState(seed).randint(0, len(b), size=(draws, len(b)))
    low, high = _interval(1.0 - np.median(a[picks], axis=1) / np.median(b[picks], axis=1), level)
    return {"n": len(b), "reduction": float(1.0 - np.median(a) / np.median(b)), "low": low, "high": high}


def signed_rank(a: Sequence[float], b: Sequence[float]) -> dict:
    """Two-sided Wilcoxon test; zeros dropped.  Exact for up to 50 pairs without ties, else normal with tie correction."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    d = d[np.isfinite(d)]
    pairs, d = len(d), d[d != 0]
    n = len(d)
    if not n:
        return {"n_pairs": pairs, "n_nonzero": 0, "statistic": None, "p": None}
    ranks = average_ranks(np.abs(d))
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    _, ties = np.unique(np.abs(d), return_counts=True)
    if n <= 50 and n == pairs and ties.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        p = min(1.0, 2.0 * ways[: int(w) + 1].sum() / 2.0**n)
    else:
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - (ties**3 - ties).sum() / 48.0)
        p = min(1.0, 2.0 * NormalDist().cdf((w - n * (n + 1) / 4.0) / spread))
    return {"n_pairs": pairs, "n_nonzero": n, "statistic": float(w), "p": float(p)}
