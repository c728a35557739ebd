"""Statistical tails and tests in numpy."""

from __future__ import annotations

import math

import numpy as np


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n <= 2 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = (n - 2) * r * r / (1 - r * r)
    return beta_tail((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def critical_correlation(n: int, p: float) -> float:
    """The least |r| of ``n`` pairs whose p-value is at most ``p``; above 1 if there is none."""
    if n <= 2:
        return 2.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if correlation_p(mid, n) <= p else (mid, hi)
    return hi


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f)."""
    if math.isnan(f) or d2 <= 0:
        return float("nan")
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def digamma(n: int) -> float:
    """At positive integers: a harmonic number less Euler's constant."""
    return float(sum(1 / k for k in range(1, n))) - 0.5772156649015329


def ssr(y: np.ndarray, x: np.ndarray) -> float:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    return float(e @ e)


# MacKinnon's approximate p-value of the ADF statistic, constant only.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SPLIT, ADF_MAX, ADF_MIN = -1.61, 2.74, -18.83


def adf_p(y: np.ndarray) -> float:
    """p-value of the augmented Dickey-Fuller test, lag by AIC on a common sample."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        return 1.0
    d = np.diff(y)

    def design(lag: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        cols = [y[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lag + 1)], np.ones(len(d) - skip)]
        return d[skip:], np.column_stack(cols)

    def aic(lag: int) -> float:
        t, x = design(lag, most)
        return len(t) * math.log(max(ssr(t, x), 1e-300) / len(t)) + 2 * x.shape[1]

    lag = min(range(most + 1), key=aic)
    t, x = design(lag, lag)
    beta, *_ = np.linalg.lstsq(x, t, rcond=None)
    e = t - x @ beta
    var = float(e @ e) / max(1, len(t) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0]
    if var <= 0:
        return 0.0
    tau = float(beta[0]) / math.sqrt(var)
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    poly = ADF_SMALL if tau <= ADF_SPLIT else ADF_LARGE
    z = sum(c * tau**k for k, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def stationary(y: np.ndarray, max_diff: int = 2) -> np.ndarray:
    """Difference until the test rejects a unit root, at most ``max_diff`` times."""
    for _ in range(max_diff):
        if adf_p(y) < 0.05:
            break
        y = np.diff(y)
    return y


def lag_order(x: np.ndarray, y: np.ndarray, max_lag: int) -> int:
    """Lag of least BIC of y on lags of x and y."""
    n = len(y)
    best, found = 1, math.inf
    for lag in range(1, max(1, min(max_lag, n // 5 - 1)) + 1):
        target = y[lag:]
        design = np.column_stack([*[s[lag - k : n - k] for s in (x, y) for k in range(1, lag + 1)], np.ones(n - lag)])
        bic = n * math.log(max(ssr(target, design), 1e-300) / n) + design.shape[1] * math.log(n)
        if bic < found:
            best, found = lag, bic
    return best


def granger(cause: np.ndarray, effect: np.ndarray, lag: int) -> tuple[float, float]:
    """F statistic and p-value of lags of ``cause`` added to lags of ``effect``."""
    n = len(effect)
    own = [effect[lag - k : n - k] for k in range(1, lag + 1)]
    other = [cause[lag - k : n - k] for k in range(1, lag + 1)]
    one = np.ones(n - lag)
    restricted, full = ssr(effect[lag:], np.column_stack([*own, one])), ssr(effect[lag:], np.column_stack([*own, *other, one]))
    d2 = (n - lag) - 2 * lag - 1
    if d2 <= 0 or full <= 0:
        return float("nan"), float("nan")
    f = ((restricted - full) / lag) / (full / d2)
    return f, f_tail(f, lag, d2)


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Shrunk covariance of rows of observations."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s * s).sum() - 2 * mu * np.trace(s) + p * mu * mu) / p
    beta = (((x * x).T @ (x * x)).sum() / n - (s * s).sum()) / (p * n)
    shrink = min(beta, delta) / delta if delta > 0 else 0.0
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def graphical_lasso(s: np.ndarray, alpha: float, max_iter: int = 200, tol: float = 1e-4) -> np.ndarray:
    """Sparse precision matrix by block coordinate descent."""
    p = len(s)
    w = s.copy()
    np.fill_diagonal(w, np.diag(s))
    beta = np.zeros((p, p))
    for _ in range(max_iter):
        old = w.copy()
        for j in range(p):
            rest = np.delete(np.arange(p), j)
            a, b = w[np.ix_(rest, rest)], s[rest, j]
            c = beta[rest, j]
            for _ in range(100):
                before = c.copy()
                for k in range(p - 1):
                    g = b[k] - a[k] @ c + a[k, k] * c[k]
                    c[k] = np.sign(g) * max(abs(g) - alpha, 0) / a[k, k]
                if np.abs(c - before).max(initial=0) < tol * 0.01:
                    break
            beta[rest, j] = c
            w[rest, j] = w[j, rest] = a @ c
        if np.abs(w - old).mean() < tol * max(np.abs(s - np.diag(np.diag(s))).mean(), 1e-12):
            break
    return np.linalg.inv(w)


def graphical_lasso_cv(x: np.ndarray, folds: int = 5, grid: int = 4, refinements: int = 4) -> np.ndarray:
    """Penalty by cross-validated likelihood on a grid that closes in on its best point."""
    s = np.cov(x.T, bias=True)
    top = np.abs(s - np.diag(np.diag(s))).max()
    if top <= 0:
        return np.diag(1 / np.maximum(np.diag(s), 1e-12))
    parts = np.array_split(np.arange(len(x)), folds)
    scores: dict[float, float] = {}

    def score(alpha: float) -> float:
        if alpha not in scores:
            total = 0.0
            for part in parts:
                train = np.cov(np.delete(x, part, 0).T, bias=True)
                test = np.cov(x[part].T, bias=True)
                try:
                    prec = graphical_lasso(train, alpha, 50)
                    sign, logdet = np.linalg.slogdet(prec)
                    total += logdet - (test * prec).sum() if sign > 0 else -1e12
                except np.linalg.LinAlgError:
                    total -= 1e12
            scores[alpha] = total
        return scores[alpha]

    low, high = 0.01 * top, top
    for _ in range(refinements):
        points = [float(a) for a in np.geomspace(low, high, grid)]
        best = max(range(grid), key=lambda i: score(points[i]))
        low, high = points[max(0, best - 1)], points[min(grid - 1, best + 1)]
    return graphical_lasso(s, max(scores, key=scores.get))


def ksg(x: np.ndarray, y: np.ndarray, k: int = 5) -> float:
    """Mutual information by the k nearest neighbours in the maximum norm, in nats, 0 at least."""
    n = len(x)
    x, y = ((v - v.mean()) / (v.std() + 1e-9) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    eps = np.partition(joint, k - 1, axis=1)[:, k - 1]
    nx = np.maximum(1, (dx <= eps[:, None]).sum(1) - 1)
    ny = np.maximum(1, (dy <= eps[:, None]).sum(1) - 1)
    psi = np.concatenate(([0.0, -0.5772156649015329], -0.5772156649015329 + np.cumsum(1 / np.arange(1, n + 1))))
    return max(0.0, float(psi[k] + psi[n] - (psi[nx] + psi[ny]).mean()))
