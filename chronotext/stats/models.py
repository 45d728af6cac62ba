"""Regressions, factors and tests on arrays, and their distribution over specifications.

All functions take complete numeric arrays (rows with a null or NaN are dropped by `complete`), and return plain numbers,
so that each runs whole inside one task of `per_specification`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronotext.stats import tails


def complete(*arrays: np.ndarray) -> list[np.ndarray]:
    ok = np.all([np.isfinite(a).reshape(len(a), -1).all(1) for a in arrays], axis=0)
    return [a[ok] for a in arrays]


def with_constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def ols(y: np.ndarray, x: np.ndarray, cov: str = "HC3", lags: int = 4) -> dict:
    """OLS with constant. cov: nonrobust, HC3 or HAC (Bartlett). Fit measures, and coefficients with their errors and p."""
    X = with_constant(x)
    n, k = X.shape
    inv = np.linalg.pinv(X.T @ X)
    beta = inv @ X.T @ y
    e = y - X @ beta
    ssr, sst = float(e @ e), float(((y - y.mean()) ** 2).sum())
    if cov == "HC3":
        h = np.einsum("ij,jk,ik->i", X, inv, X)
        V = inv @ (X.T * (e / np.maximum(1 - h, 1e-12)) ** 2) @ X @ inv
    elif cov == "HAC":
        g = X * e[:, None]
        S = g.T @ g
        for j in range(1, min(lags, n - 1) + 1):
            c = g[j:].T @ g[:-j]
            S += (1 - j / (lags + 1)) * (c + c.T)
        V = inv @ S @ inv
    else:
        V = inv * ssr / max(n - k, 1)
    se = np.sqrt(np.maximum(np.diag(V), 0))
    t = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    p = [2 * tails.normal_sf(abs(v)) for v in t] if cov == "HAC" else [tails.t_p(v, n - k) for v in t]
    r2 = 1 - ssr / sst if sst > 0 else float("nan")
    ll = -n / 2 * (math.log(2 * math.pi * max(ssr, 1e-300) / n) + 1)
    wald = float(beta[1:] @ np.linalg.pinv(V[1:, 1:]) @ beta[1:] / (k - 1)) if k > 1 else float("nan")
    return {"n": n, "k": k, "beta": beta, "se": se, "t": t, "p": p, "ssr": ssr, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / max(n - k, 1), "ll": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll, "f": wald, "f_p": tails.f_sf(wald, k - 1, n - k) if k > 1 else float("nan"), "fitted": X @ beta, "resid": e}


def nested_f(y: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[float, float]:
    a, b = ols(y, small, "nonrobust"), ols(y, large, "nonrobust")
    q, df = b["k"] - a["k"], b["n"] - b["k"]
    f = (a["ssr"] - b["ssr"]) / q / (b["ssr"] / df)
    return f, tails.f_sf(f, q, df)


def likelihood_ratio(y: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[float, float]:
    a, b = ols(y, small, "nonrobust"), ols(y, large, "nonrobust")
    lr = 2 * (b["ll"] - a["ll"])
    return lr, tails.chi2_sf(lr, b["k"] - a["k"])


def vif(x: np.ndarray) -> np.ndarray:
    """Variance inflation with constant: the diagonal of the inverse correlation."""
    return np.diag(np.linalg.pinv(np.corrcoef(x, rowvar=False)))


def pca(x: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors, loadings, shares): population z-scores, as many components as reach `share`; largest loading positive."""
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    part = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    vt = vt * sign[:, None]
    return z @ vt[:k].T, vt[:k], part[:k]


def oos_rmse(y: np.ndarray, x: np.ndarray, share: float = 0.6, horizon: int = 1) -> float:
    """One-step errors of expanding fits, from max(share n, 10); with a horizon the fit ends that much earlier."""
    X, err = with_constant(x), []
    for t in range(max(int(share * len(y)), 10), len(y)):
        end = t - horizon + 1
        err.append(y[t] - X[t] @ np.linalg.lstsq(X[:end], y[:end], rcond=None)[0])
    return float(np.sqrt(np.mean(np.square(err)))) if err else float("nan")


def rolling_ols(y: np.ndarray, x: np.ndarray, rows: int = 20) -> np.ndarray:
    """Coefficients fitted on the `rows` rows before each row; NaN where there are fewer."""
    out = np.full((len(y), x.shape[1] + 1), np.nan)
    for t in range(rows, len(y)):
        out[t] = np.linalg.lstsq(with_constant(x[t - rows : t]), y[t - rows : t], rcond=None)[0]
    return out


def placebo_p(y: np.ndarray, x: np.ndarray, column: int, times: int = 500, seed: int = 42) -> float:
    """Share of shuffles of one column that reach the observed adjusted R2."""
    rng, seen, z = np.random.default_rng(seed), ols(y, x, "nonrobust")["adj_r2"], x.copy()
    hits = 0
    for _ in range(times):
        z[:, column] = rng.permutation(x[:, column])
        hits += ols(y, z, "nonrobust")["adj_r2"] >= seen
    return hits / times


def clark_west(y: np.ndarray, small: np.ndarray, large: np.ndarray, horizon: int = 1) -> tuple[float, float]:
    """Test of equal forecast accuracy of nested models from their forecasts; one-sided normal p."""
    f = (y - small) ** 2 - ((y - large) ** 2 - (small - large) ** 2)
    m = ols(f, np.zeros((len(f), 0)), "HAC", max(1, horizon))
    t = float(m["t"][0])
    return t, tails.normal_sf(t)


def adf(y: np.ndarray, most: int | None = None) -> tuple[float, int]:
    """Augmented Dickey-Fuller statistic with constant, lags by AIC; compare with -3.43, -2.86, -2.57 (1, 5, 10 %)."""
    n = len(y)
    most = int(12 * (n / 100) ** 0.25) if most is None else most
    most = max(0, min(most, n // 2 - 3))
    dy, best = np.diff(y), (math.inf, 0.0, 0)
    for lag in range(most + 1):
        rows = np.arange(most, len(dy))
        x = np.column_stack([y[rows], *[dy[rows - j] for j in range(1, lag + 1)]])
        m = ols(dy[rows], x, "nonrobust")
        if m["aic"] < best[0]:
            best = (m["aic"], float(m["t"][1]), lag)
    return best[1], best[2]


def kpss(y: np.ndarray) -> float:
    """KPSS statistic around a level, lags int(4 (n / 100)^0.25); compare with 0.739, 0.463, 0.347 (1, 5, 10 %)."""
    e, n = y - y.mean(), len(y)
    lags = int(4 * (n / 100) ** 0.25)
    s = e @ e / n + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) / n for j in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / n**2 / s) if s > 0 else float("nan")


def ordered_probit(y: np.ndarray, x: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, cuts, log-likelihood) for classes 0, 1, 2 by damped Newton steps on numeric derivatives."""
    k = x.shape[1]
    cdf = np.vectorize(lambda z: 1 - tails.normal_sf(z))
    share = np.clip([(y <= 0).mean(), (y <= 1).mean()], 0.01, 0.99)
    inv = lambda p: math.copysign(math.sqrt(max(0.0, -1.6 * math.log(1 - (2 * p - 1) ** 2))), p - 0.5)
    theta = np.r_[np.zeros(k), inv(share[0]), math.log(max(inv(share[1]) - inv(share[0]), 0.1))]

    def ll(v: np.ndarray) -> float:
        xb, a = x @ v[:k], v[k]
        b = a + math.exp(min(v[k + 1], 20))
        low, high = cdf(a - xb), cdf(b - xb)
        return float(np.log(np.maximum(np.select([y == 0, y == 1], [low, high - low], 1 - high), 1e-12)).sum())

    now, h = ll(theta), 1e-4
    for _ in range(steps):
        eye = np.eye(len(theta)) * h
        up, down = np.array([ll(theta + e) for e in eye]), np.array([ll(theta - e) for e in eye])
        g = (up - down) / (2 * h)
        H = np.array([[(ll(theta + a + b) - ll(theta + a - b) - ll(theta - a + b) + ll(theta - a - b)) / (4 * h * h) for b in eye] for a in eye])
        step = np.linalg.lstsq(H - 1e-6 * np.eye(len(theta)), -g, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and ll(theta + size * step) <= now:
            size /= 2
        if size <= 1e-6:
            break
        theta = theta + size * step
        gain, now = ll(theta) - now, ll(theta)
        if gain < 1e-9:
            break
    return theta[:k], np.array([theta[k], theta[k] + math.exp(theta[k + 1])]), now


def directional_accuracy(actual: np.ndarray, forecast: np.ndarray, active: float = 0.001) -> tuple[float, int, float]:
    """(share of right signs, active cases, binomial p) where the actual change is more than `active`."""
    on = np.abs(actual) > active
    right, n = int((np.sign(actual[on]) == np.sign(forecast[on])).sum()), int(on.sum())
    return (right / n if n else float("nan")), n, tails.binomial_sf(right, n) if n else float("nan")


def per_specification(panel: DataFrame, specs: DataFrame, on: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`run` on the panel rows of each specification. panel: a small, already aggregated table; specs: one row each.

    Each specification is one task's group; its size is that of the panel, never of the corpus.
    """
    return panel.join(specs, list(on)).groupBy("spec").applyInPandas(run, schema)
