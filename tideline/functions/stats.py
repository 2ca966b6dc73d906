"""Distribution functions without scipy, as plain functions and pandas UDFs."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(stat: float, df: float) -> float:
    """P(|T| >= |stat|) of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + stat * stat))


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """(statistic, two-sided p) of the signed-rank test; zeros are left out. Exact for up to 50 untied differences without zeros, else normal with the tie correction."""
    d = np.asarray(d, dtype=float)
    zeros, d = (d == 0).any(), d[d != 0]
    n = len(d)
    if not n:
        return float("nan"), float("nan")
    a = np.abs(d)
    order = np.argsort(a, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(a[order]) != 0, [True]]))
    rank = np.empty(n)
    sizes = []
    for lo, hi in pairwise(edges):
        rank[order[lo:hi]] = (lo + hi + 1) / 2
        sizes.append(hi - lo)
    plus = rank[d > 0].sum()
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not zeros and max(sizes) == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(w), float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(s**3 - s for s in sizes) / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var)
    return float(w), float(math.erfc(abs(z) / math.sqrt(2)))


def p_of_t(stat, df):
    """Two-sided p-value of a column of t statistics."""

    def p(stat: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(float(s), float(d)) if s == s and d == d else None for s, d in zip(stat, df)], dtype=float)

    return F.pandas_udf(p, T.DoubleType())(stat, df)


def p_of_ranks(differences):
    """Two-sided signed-rank p-value of a column of arrays; null for fewer than 5 differences, or where all are 0."""

    def p(d: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon(x)[1] if len(x) >= 5 and np.any(x != 0) else None for x in map(np.asarray, d)], dtype=float)

    return F.pandas_udf(p, T.DoubleType())(differences)


def block_bootstrap(calls_a, calls_b, truth, draws: int = 1000, block: int = 24, seed: int = 0) -> tuple[float, float, float]:
    """5th and 95th percentile of the difference in balanced accuracy over moving-block resamples, and the share of draws at or below 0."""
    ok = {k: (np.stack([calls_a, calls_b]) == k) for k in (-1, 0, 1)}
    rng, n = np.random.default_rng(seed), len(truth)
    block = min(block, n)
    out = np.empty(draws)
    for d in range(draws):
        at = (rng.integers(0, n - block + 1, -(-n // block))[:, None] + np.arange(block)).ravel()[:n]
        recalls = [ok[k][:, at[truth[at] == k]].mean(axis=1) for k in (-1, 0, 1) if (truth[at] == k).any()]
        a, b = np.mean(recalls, axis=0)
        out[d] = a - b
    lo, hi = np.percentile(out, [5, 95])
    return float(lo), float(hi), float((out <= 0).mean())
