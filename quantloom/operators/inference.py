"""Tests on date series. Spark reduces to one value a date; the closed forms then run on that bounded series.

Every function takes a series of at most a few thousand values, as NumPy arrays; ``series`` reads one from a DataFrame
and refuses a longer one.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, exp, floor, inf, lgamma, log, nan, sqrt

import numpy as np
from pyspark.sql import DataFrame

from ..functions import EPS

MOST_DATES = 100_000


def series(df: DataFrame, time: str, *columns: str) -> list[np.ndarray]:
    """Columns in time order; more than ``MOST_DATES`` rows are an error."""
    rows = df.select(time, *columns).orderBy(time).limit(MOST_DATES + 1).toPandas()
    if len(rows) > MOST_DATES:
        raise ValueError("not a date series")
    return [rows[c].to_numpy(np.float64) for c in columns]


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return 1 - erf(abs(z) / sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz scheme."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny, key=abs)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + num * d, tiny, key=abs)
            c = max(1 + num / c, tiny, key=abs)
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if np.isfinite(t) else (0.0 if abs(t) == inf else nan)


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with ``k`` degrees, by the recurrence in ``k``."""
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        term = total = exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    total, term = normal_tail(sqrt(x)), sqrt(2 * x / np.pi) * exp(-x / 2)
    for i in range(1, (k + 1) // 2):
        total += term
        term *= x / (2 * i + 1)
    return min(1.0, float(total))


def bandwidth(n: int) -> int:
    return 0 if n < 2 else floor(4 * (n / 100) ** (2 / 9))


def long_run_variance(x: np.ndarray, lag: int | None = None) -> float:
    """Bartlett-weighted autocovariances, not below zero."""
    x = x[np.isfinite(x)]
    lag, d = bandwidth(len(x)) if lag is None else lag, x - x.mean()
    return max(0.0, float(d @ d + 2 * sum((1 - k / (lag + 1)) * (d[k:] @ d[:-k]) for k in range(1, min(lag, len(x) - 1) + 1))) / len(x))


@dataclass(frozen=True)
class Test:
    estimate: float
    statistic: float
    p_value: float
    observations: int
    standard_error: float = nan


def hac_mean_test(x: np.ndarray, null: float = 0.0, lag: int | None = None, alternative: str = "two-sided") -> Test:
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 3:
        return Test(nan, nan, nan, n)
    se = sqrt(long_run_variance(x, lag) / n)
    t = (x.mean() - null) / se if se > EPS else nan
    p = student_tail(t, n - 1)
    if alternative != "two-sided":
        p = p / 2 if (t > 0) == (alternative == "greater") else 1 - p / 2
    return Test(float(x.mean()), t, p, n, se)


def bootstrap_indices(n: int, block: float, times: int, rng: np.random.Generator) -> np.ndarray:
    """Stationary bootstrap: blocks of geometric length that wrap around; starts, then restarts, then fresh places are drawn."""
    first, again, fresh = rng.integers(0, n, times), rng.random((times, n)) < 1 / block, rng.integers(0, n, (times, n))
    out = np.empty((times, n), np.int64)
    out[:, 0] = first
    for i in range(1, n):
        out[:, i] = np.where(again[:, i], fresh[:, i], (out[:, i - 1] + 1) % n)
    return out


def sharpe(x: np.ndarray, periods: int = 252) -> float:
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(x.mean() / s * sqrt(periods)) if s > EPS else nan


def sharpe_significance(x: np.ndarray, periods: int = 252, lag: int | None = None, times: int = 2000, block: float = 10, seed: int = 42, confidence: float = 0.95) -> tuple[Test, float, float]:
    """HAC test of the mean excess return, and a bootstrap percentile interval of the Sharpe ratio."""
    x = x[np.isfinite(x)]
    test = hac_mean_test(x, lag=lag)
    drawn = np.array([sharpe(x[i], periods) for i in bootstrap_indices(len(x), block, times, np.random.default_rng(seed))])
    low, high = np.nanquantile(drawn, [(1 - confidence) / 2, (1 + confidence) / 2])
    return test, float(low), float(high)


def pesaran_timmermann(predicted_up: np.ndarray, actual_up: np.ndarray) -> Test:
    """Are predicted and actual directions independent? Normal p-value, upper tail."""
    n = len(actual_up)
    py, px, p = actual_up.mean(), predicted_up.mean(), (predicted_up == actual_up).mean()
    star = py * px + (1 - py) * (1 - px)
    v, w = star * (1 - star) / n, ((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / n**2
    if v - w <= EPS:
        return Test(float(p), nan, nan, n)
    z = (p - star) / sqrt(v - w)
    tail = normal_tail(z) / 2
    return Test(float(p), float(z), tail if z > 0 else 1 - tail, n)


def diebold_mariano(a: np.ndarray, b: np.ndarray, horizon: int = 1, lag: int | None = None) -> Test:
    """Equal predictive loss, with the small-sample factor; two-sided t."""
    d = (a - b)[np.isfinite(a) & np.isfinite(b)]
    n = len(d)
    if n < 3:
        return Test(nan, nan, nan, n)
    v = long_run_variance(d, horizon - 1 if lag is None else lag) / n
    if v <= EPS * EPS:
        return Test(float(d.mean()), nan, nan, n)
    t = d.mean() / sqrt(v) * sqrt(max(0.0, (n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n))
    return Test(float(d.mean()), float(t), student_tail(t, n - 1), n)


def sharpe_difference(a: np.ndarray, b: np.ndarray, periods: int = 252, times: int = 2000, block: float = 10, seed: int = 42) -> tuple[Test, float]:
    """Memmel's z for equal Sharpe ratios, and a paired bootstrap p-value."""
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = a[ok], b[ok]
    n, sa, sb = len(a), sharpe(a, 1), sharpe(b, 1)
    if n < 3 or not np.isfinite(sa + sb):
        return Test(nan, nan, nan, n), nan
    rho = np.corrcoef(a, b)[0, 1]
    v = (2 - 2 * rho + (sa * sa + sb * sb - 2 * sa * sb * rho * rho) / 2) / n
    z = (sa - sb) / sqrt(v) if v > EPS * EPS else nan
    drawn = np.array([sharpe(a[i], 1) - sharpe(b[i], 1) for i in bootstrap_indices(n, block, times, np.random.default_rng(seed))])
    p = (1 + (np.abs(drawn - (sa - sb)) >= abs(sa - sb)).sum()) / (times + 1)
    return Test((sa - sb) * sqrt(periods), z, normal_tail(z) if np.isfinite(z) else nan, n), float(p)


def model_confidence_set(losses: np.ndarray, times: int = 1000, block: float = 10, seed: int = 42) -> np.ndarray:
    """P-value of each model (column): the range statistic, worst model out, until one is left. Equal columns share a fate."""
    _, first, back = np.unique(losses, axis=1, return_index=True, return_inverse=True)
    back, x = back.ravel(), losses[:, first]
    n, m = x.shape
    p = np.ones(m)
    if n < 2 or m < 2:
        return p[back]
    drawn = bootstrap_indices(n, block, times, np.random.default_rng(seed))
    means, boot = x.mean(axis=0), np.stack([x[i].mean(axis=0) for i in drawn])
    return eliminated(means, boot)[back]


def eliminated(means: np.ndarray, boot: np.ndarray) -> np.ndarray:
    """P-values of models from their mean losses and the same of each resample (rows): the worst goes, by the range statistic, until one is left."""
    p, left, running = np.ones(len(means)), list(range(len(means))), 0.0
    while len(left) > 1:
        t, most = np.zeros((len(left), len(left))), np.zeros(len(boot))
        for i, own in enumerate(left):  # one model against all others at a time, for memory's sake
            d = means[own] - means[left]
            db = boot[:, own, None] - boot[:, left] - d
            sd = np.sqrt(np.maximum((db**2).mean(axis=0), EPS * EPS))
            t[i] = d / sd
            most = np.maximum(most, np.abs(db / sd).max(axis=1))
        running = max(running, float((most >= np.abs(t).max()).mean()))
        worst = left[int(t.max(axis=1).argmax())]
        p[worst] = running
        left.remove(worst)
    return p


def hac_ols(y: np.ndarray, x: np.ndarray, lag: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients with intercept first, their covariance, R squared); Newey-West, no small-sample factor."""
    z = np.column_stack([np.ones(len(y)), x])
    lag = bandwidth(len(y)) if lag is None else lag
    inverse = np.linalg.pinv(z.T @ z)
    beta = inverse @ (z.T @ y)
    e = y - z @ beta
    u = z * e[:, None]
    meat = u.T @ u
    for k in range(1, min(lag, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lag + 1)) * (g + g.T)
    total = ((y - y.mean()) ** 2).sum()
    return beta, inverse @ meat @ inverse, float(1 - e @ e / total) if total > EPS * EPS else nan


def factor_alpha(y: np.ndarray, x: np.ndarray, periods: int = 252, lag: int | None = None) -> dict | None:
    """Alpha with HAC error and normal p-value, loadings and R squared; None with too few rows."""
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    y, x = y[ok], x[ok]
    if len(y) <= x.shape[1] + 1:
        return None
    beta, cov, r2 = hac_ols(y, x, lag)
    se = sqrt(max(cov[0, 0], 0.0))
    t = beta[0] / se if se > EPS else nan
    return {"alpha": beta[0], "annualized_alpha": beta[0] * periods, "standard_error": se, "t": t, "p_value": normal_tail(t) if np.isfinite(t) else nan, "betas": beta[1:], "r_squared": r2, "observations": len(y)}


def alpha_difference(a: np.ndarray, b: np.ndarray, x: np.ndarray, lag: int | None = None) -> dict | None:
    return factor_alpha(a - b, x, lag=lag)


def timing_design(market: np.ndarray, instruments: np.ndarray, square: bool = True, conditional_alpha: bool = False) -> np.ndarray:
    """Columns of the timing regression: market, its square, market times demeaned lagged instruments, and those themselves."""
    z = instruments - np.nanmean(instruments, axis=0)
    parts = [market[:, None], *([market[:, None] ** 2] if square else []), market[:, None] * z, *([z] if conditional_alpha else [])]
    return np.concatenate(parts, axis=1)


def spanning_test(y: np.ndarray, x: np.ndarray, lag: int | None = None) -> Test:
    """Wald test that alpha is zero and the loadings sum to one."""
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    y, x = y[ok], x[ok]
    beta, cov, _ = hac_ols(y, x, lag)
    r = np.zeros((2, len(beta)))
    r[0, 0], r[1, 1:] = 1, 1
    d = r @ beta - np.array([0.0, 1.0])
    w = float(d @ np.linalg.pinv(r @ cov @ r.T) @ d)
    return Test(float(beta[0]), w, chi2_tail(w, 2), len(y))


def joint_alpha_test(y: np.ndarray, x: np.ndarray, lag: int | None = None) -> Test:
    """Are all portfolios' alphas (columns of ``y``) zero? Wald form with the HAC covariance of the moments."""
    ok = np.isfinite(y).all(axis=1) & np.isfinite(x).all(axis=1)
    y, x = y[ok], x[ok]
    n, m = y.shape
    z = np.column_stack([np.ones(n), x])
    lag = bandwidth(n) if lag is None else lag
    inverse = np.linalg.pinv(z.T @ z / n)
    beta = inverse @ (z.T @ y / n)
    u = (z @ inverse[:, 0])[:, None] * (y - z @ beta)
    s = u.T @ u / n
    for k in range(1, min(lag, n - 1) + 1):
        g = u[k:].T @ u[:-k] / n
        s += (1 - k / (lag + 1)) * (g + g.T)
    w = float(n * beta[0] @ np.linalg.pinv(s) @ beta[0])
    return Test(float(np.abs(beta[0]).mean()), w, chi2_tail(w, m), n)


def rolling_betas(y: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Least-squares loadings over each full trailing window; rows before it are missing."""
    z = np.column_stack([np.ones(len(y)), x])
    out = np.full(z.shape, nan)
    for i in range(window - 1, len(y)):
        part = slice(i - window + 1, i + 1)
        if np.isfinite(y[part]).all() and np.isfinite(z[part]).all():
            out[i] = np.linalg.lstsq(z[part], y[part], rcond=None)[0]
    return out


def cumulative_alpha(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Running sum of what the loadings leave unexplained."""
    beta, _, _ = hac_ols(y, x, 0)
    return np.cumsum(y - x @ beta[1:])
