"""Special functions in numpy, and Arrow UDFs over them: incomplete beta, binomial and beta-binomial tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, float)).astype(float)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a) + log_gamma(b) - log_gamma(np.asarray(a) + np.asarray(b))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out *= step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0."""
    a, b, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, b, x))
    inner = (x > 0) & (x < 1)
    xi = np.where(inner, x, 0.5)
    front = np.exp(a * np.log(xi) + b * np.log1p(-xi) - log_beta(a, b))
    direct = xi < (a + 1) / (a + b + 2)
    value = np.where(direct, front * _fraction(a, b, np.where(direct, xi, 0.0)) / a, 1.0 - front * _fraction(b, a, np.where(direct, 0.0, 1 - xi)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(value, 0.0, 1.0)))


def binomial_cdf(k, n, p) -> np.ndarray:
    """P(X <= k)."""
    k, n, p = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(k, n, p))
    inner = (k >= 0) & (k < n)
    value = incomplete_beta(np.where(inner, n - k, 1.0), np.where(inner, k + 1, 1.0), 1 - p)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, value))


def binomial_at_least(k, n, p) -> np.ndarray:
    """P(X >= k)."""
    k, n, p = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(k, n, p))
    inner = (k > 0) & (k <= n)
    value = incomplete_beta(np.where(inner, k, 1.0), np.where(inner, n - k + 1, 1.0), p)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, value))


def clopper_pearson(k, n, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Exact interval of a binomial share; (0, 1) for n = 0."""
    k, n = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(k, n))

    def solve(low_side: bool) -> np.ndarray:
        lo, hi = np.zeros_like(k), np.ones_like(k)
        for _ in range(60):
            mid = (lo + hi) / 2
            tail = binomial_at_least(k, n, mid) if low_side else binomial_cdf(k, n, mid)
            up = tail < alpha / 2 if low_side else tail > alpha / 2
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        return (lo + hi) / 2

    return np.where((k <= 0) | (n <= 0), 0.0, solve(True)), np.where((k >= n) | (n <= 0), 1.0, solve(False))


def beta_binomial_log_pmf(k, n, a: float, b: float) -> np.ndarray:
    k, n = np.asarray(k, float), np.asarray(n, float)
    choose = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    return choose + log_beta(k + a, n - k + b) - log_beta(np.full_like(k, a), np.full_like(k, b))


def beta_binomial_tails(k: int, n: int, a: float, b: float) -> tuple[float, float]:
    """P(X <= k) and P(X >= k), by exact sums of logarithms."""
    log = beta_binomial_log_pmf(np.arange(n + 1), np.full(n + 1, n), a, b)
    top = log.max()
    mass = np.exp(log - top)
    return min(1.0, float(np.exp(top) * mass[: k + 1].sum())), min(1.0, float(np.exp(top) * mass[k:].sum()))


def fit_beta_binomial(k: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """alpha and beta with mean sum(k) / sum(n), the strength by the largest likelihood."""
    p = k.sum() / n.sum()
    cost = lambda log_a: -beta_binomial_log_pmf(k, n, math.exp(log_a), math.exp(log_a) * (1 - p) / p).sum()
    lo, hi, golden = math.log(1e-3), math.log(1e7), (math.sqrt(5) - 1) / 2
    grid = np.linspace(lo, hi, 60)
    best = int(np.argmin([cost(g) for g in grid]))
    lo, hi = grid[max(0, best - 1)], grid[min(59, best + 1)]
    x, y = hi - golden * (hi - lo), lo + golden * (hi - lo)
    fx, fy = cost(x), cost(y)
    for _ in range(80):
        if fx < fy:
            hi, y, fy = y, x, fx
            x = hi - golden * (hi - lo)
            fx = cost(x)
        else:
            lo, x, fx = x, y, fy
            y = lo + golden * (hi - lo)
            fy = cost(y)
    a = math.exp((lo + hi) / 2)
    return a, a * (1 - p) / p


def _udf(f):
    """An Arrow UDF of double columns that gives null where an argument is null."""

    @F.pandas_udf("double")
    def call(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        have = k.notna() & n.notna() & p.notna()
        out = np.full(len(k), np.nan)
        if have.any():
            out[have.to_numpy()] = f(k[have].to_numpy(float), n[have].to_numpy(float), p[have].to_numpy(float))
        return pd.Series(out).where(have.reset_index(drop=True), None)

    return call


def binomial_cdf_udf():
    return _udf(binomial_cdf)


def binomial_at_least_udf():
    return _udf(binomial_at_least)


def clopper_pearson_udf(alpha: float = 0.05):
    """An Arrow UDF (k, n) -> struct<low, high>."""

    @F.pandas_udf("low double, high double")
    def call(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = clopper_pearson(k.fillna(0).to_numpy(float), n.fillna(0).to_numpy(float), alpha)
        return pd.DataFrame({"low": low, "high": high})

    return call
