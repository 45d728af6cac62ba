"""Factor-augmented regressions on a panel of meetings: baseline, grids of added terms, masks, sweeps, robustness, walk-forward tests.

A panel has one row per meeting. Each function takes it whole as a pandas frame and returns one result row, so that
specifications run beside each other as groups of `models.per_specification`; nothing here grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from chronotext.stats import models as m
from chronotext.stats import tails

LEAST_ROWS, MACRO_SHARE, TEXT_SHARE = 30, 0.90, 0.85
RESULT = "spec string, n long, k long, r2 double, adj_r2 double, aic double, bic double, f double, f_p double, oos_rmse double, note string"
#: Fixed values of tests: MacKinnon (1994) polynomials with a constant, and the table of KPSS around a level.
ADF_SMALL, ADF_LARGE, ADF_TURN = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def stars(p: float) -> str:
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.10 else ""


def kaiser_pca(x: np.ndarray, share: float = 0.999) -> tuple[np.ndarray, int]:
    """(factors, number kept): as many as have a sample eigenvalue over 1, or as reach the share, at least one."""
    factors, _, part = m.pca(x, 1.0)
    eigenvalues = (factors**2).sum(0) / (len(x) - 1)
    keep = max(int((eigenvalues > 1).sum()), int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1), 1)
    return factors[:, :keep], min(keep, factors.shape[1])


def uncentered_vif(x: np.ndarray) -> np.ndarray:
    """Variance inflation without a constant: each column against the others, shares of the plain sum of squares."""
    out = []
    for i in range(x.shape[1]):
        other = np.delete(x, i, 1)
        e = x[:, i] - other @ np.linalg.lstsq(other, x[:, i], rcond=None)[0]
        out.append(float((x[:, i] ** 2).sum() / max(float(e @ e), 1e-300)))
    return np.array(out)


def factors(panel: pd.DataFrame, columns: Sequence[str], share: float, name: str = "PC") -> pd.DataFrame | None:
    """Factors of the columns that exist and are not all missing, on their complete rows; None with fewer than two columns."""
    have = [c for c in columns if c in panel and panel[c].notna().any()]
    rows = panel[have].dropna()
    if len(have) < 2 or len(rows) < 3:
        return None
    f, _, _ = m.pca(rows.to_numpy(float), share)
    return pd.DataFrame(f, index=rows.index, columns=[f"{name}{i + 1}" for i in range(f.shape[1])])


def fitted(y: pd.Series, x: pd.DataFrame, cov: str = "HC3", least: int = LEAST_ROWS) -> dict | None:
    """OLS on the complete rows; None if there are fewer than `least`."""
    both = pd.concat([y.rename("__y"), x], axis=1).dropna()
    if len(both) < least:
        return None
    out = m.ols(both["__y"].to_numpy(float), both[x.columns].to_numpy(float), cov)
    return out | {"y": both["__y"].to_numpy(float), "x": both[x.columns].to_numpy(float), "columns": list(x.columns)}


def row(spec: str, fit: dict | None, note: str = "") -> tuple:
    """The result row of a fit, rounded as the comparison table is; a skipped fit has no figures."""
    if fit is None:
        return (spec, 0, 0, None, None, None, None, None, None, None, note or "too few rows")
    r = lambda v, d: round(float(v), d) if math.isfinite(v) else None
    return (spec, fit["n"], fit["k"], r(fit["r2"], 4), r(fit["adj_r2"], 4), r(fit["aic"], 2), r(fit["bic"], 2), r(fit["f"], 4), r(fit["f_p"], 6), r(m.oos_rmse(fit["y"], fit["x"]), 6), note)


def ahead(panel: pd.DataFrame, target: str, rows: int = 1) -> pd.Series:
    return panel[target].shift(-rows)


def added_terms(panel: pd.DataFrame, spec: str, topics: Sequence[str], matched: dict[str, str], crossed: Sequence[str], end: float = 2.0) -> pd.DataFrame | None:
    """The columns a specification adds to the factors; sentiment columns are scaled by end / 2 first. None if it has none."""
    p = panel.copy()
    sent = [c for c in p if c.startswith("sent_")]
    p[sent] = p[sent] * (end / 2)
    by_topic = [f"sent_{t}" for t in topics if f"sent_{t}" in p]
    if spec == "topic_factors":
        return factors(p, by_topic, TEXT_SHARE, "SPC")
    made = {
        "total": lambda: p[["sent_total"]],
        "sd": lambda: p[["sent_sd"]],
        "var": lambda: p[["sent_var"]],
        "sd_var": lambda: p[["sent_sd", "sent_var"]],
        "all_topics": lambda: p[by_topic],
        "total_by_macro": lambda: pd.DataFrame({f"total_x_{c}": p["sent_total"] * p[c] for c in crossed if c in p}),
        "matched": lambda: pd.DataFrame({f"{s}_x_{c}": p[s] * p[c] for s, c in matched.items() if s in p and c in p}),
        "novelty": lambda: p[[*by_topic, "sent_total"]].diff().add_prefix("delta_"),
    }
    out = made[spec]()
    return out if out.shape[1] else None


SPECS = ["total", "sd", "var", "sd_var", "all_topics", "topic_factors", "total_by_macro", "matched", "novelty"]


def augmented(panel: pd.DataFrame, regressors: Sequence[str], target: str, extra: pd.DataFrame | None, rows: pd.Series | None = None, ahead_by: int = 1) -> dict | None:
    """The target ahead, on the macro factors of the whole panel and the added terms, on the rows of a mask."""
    f = factors(panel, regressors, MACRO_SHARE)
    if f is None:
        return None
    x = f if extra is None else f.join(extra, how="inner")
    if rows is not None:
        x = x[rows.reindex(x.index).fillna(False).astype(bool)]
    return fitted(ahead(panel, target, ahead_by).reindex(x.index), x)


def masks(panel: pd.DataFrame, flags: Sequence[str], target: str) -> dict[str, pd.Series]:
    """Rows of each mask: a flag above its median, above 0, exactly 1 and 0; the target rising or falling (these look ahead)."""
    change = panel[target].diff()
    out = {"target_up_lookahead": change > 0.001, "target_down_lookahead": change < -0.001}
    for c in flags:
        out |= {f"{c}_above_median": panel[c] > panel[c].median(), f"{c}_positive": panel[c] > 0, f"{c}_one": panel[c] == 1, f"{c}_zero": panel[c] == 0}
    return out


def rolling_bands(y: np.ndarray, x: np.ndarray, column: int, rows: int = 20) -> pd.DataFrame:
    """(t, low, coefficient, high): HC3 bands of 95 % of one coefficient, fitted on the rows before each t."""
    out = []
    for t in range(rows, len(y)):
        f = m.ols(y[t - rows : t], x[t - rows : t])
        df = f["n"] - f["k"]
        low, high = 0.0, 50.0
        for _ in range(60):  # the 97.5 % point of t by bisection
            mid = (low + high) / 2
            low, high = (mid, high) if tails.t_p(mid, df) > 0.05 else (low, mid)
        b, se = float(f["beta"][column + 1]), float(f["se"][column + 1])
        out.append((t, b - high * se, b, b + high * se))
    return pd.DataFrame(out, columns=["t", "low", "coefficient", "high"])


def retained(y: np.ndarray, base: np.ndarray, terms: np.ndarray, names: Sequence[str], level: float = 0.10) -> list[tuple[str, float, float, float, bool]]:
    """(name, t, p by HAC, p of the marginal F, kept) of each added term; kept if either is below the level."""
    whole = np.column_stack([base, terms])
    hac = m.ols(y, whole, "HAC")
    out = []
    for i, n in enumerate(names):
        at = 1 + base.shape[1] + i
        _, p_f = m.nested_f(y, np.column_stack([base, np.delete(terms, i, 1)]), whole)
        out.append((n, float(hac["t"][at]), float(hac["p"][at]), float(p_f), bool(hac["p"][at] < level or p_f < level)))
    return out


def residual_tests(y: np.ndarray, base: np.ndarray, text: np.ndarray, unsure: np.ndarray) -> dict[str, float]:
    """F and p of added text terms against the base, as they are and with what uncertainty explains taken out; and the largest R2 of that."""
    residuals, r2 = [], []
    for c in text.T:
        f = m.ols(c, unsure.reshape(-1, 1), "nonrobust")
        residuals.append(f["resid"])
        r2.append(f["r2"])
    raw, left = m.nested_f(y, base, np.column_stack([base, text])), m.nested_f(y, base, np.column_stack([base, *residuals]))
    return {"max_r2": max(r2), "f_raw": raw[0], "p_raw": raw[1], "f_resid": left[0], "p_resid": left[1], "f_lost": raw[0] - left[0]}


def screen(panel: pd.DataFrame, target: str, base: Sequence[str], candidates: Sequence[str], least: int = 20) -> list[tuple[str, int, float, float, str]]:
    """(candidate, n, t, p, stars) of each candidate added to the base by itself, on its own complete rows."""
    out = []
    for c in candidates:
        f = fitted(ahead(panel, target), panel[[*base, c]], "HAC", least)
        if f is not None:
            out.append((c, f["n"], float(f["t"][-1]), float(f["p"][-1]), stars(f["p"][-1])))
    return out


def walk_forward(y: np.ndarray, now: np.ndarray, base: np.ndarray, full: np.ndarray, horizon: int, first: int) -> dict[str, float]:
    """Forecasts of y (the value `horizon` rows ahead) by expanding fits that end `horizon` - 1 rows before, base against full.

    RMSEs in hundredths, Clark-West t and p, share of right directions of the full model where the value moved, its binomial p.
    """
    small, large, seen, at = [], [], [], []
    for t in range(first, len(y)):
        end = t - horizon + 1
        if end <= full.shape[1] + 2:
            continue
        for store, x in ((small, base), (large, full)):
            X = m.with_constant(x)
            store.append(float(X[t] @ np.linalg.lstsq(X[:end], y[:end], rcond=None)[0]))
        seen.append(y[t])
        at.append(now[t])
    if len(seen) < 5:
        return {"n": len(seen)}
    a, s, f, c = map(np.array, (seen, small, large, at))
    rmse = lambda v: 100 * float(np.sqrt(np.mean((a - v) ** 2)))
    cw = m.clark_west(a, s, f, horizon)
    right, active, p = m.directional_accuracy(a - c, f - c)
    gain = rmse(s) - rmse(f)
    return {"n": len(a), "rmse_base": rmse(s), "rmse_full": rmse(f), "cw_t": cw[0], "cw_p": cw[1], "right": right, "active": active, "right_p": p, "tradeable": tradeable(gain, right, p)}


def tradeable(gain: float, right: float, p: float) -> str:
    """yes: at least 5 hundredths better and right in 58 % of moves beyond chance; maybe: one of the two; n/a without moves."""
    if not (math.isfinite(right) and math.isfinite(p)):
        return "n/a"
    better, sure = gain >= 5, right >= 0.58 and p < 0.10
    return "yes" if better and sure else "maybe" if better or sure else "no"


def walk_forward_probit(change: np.ndarray, x: np.ndarray, first: int = 20, every: int = 1, fit: Callable = m.ordered_probit) -> pd.DataFrame:
    """(t, signal, actual, gain): P(up) - P(down) of the next change by an ordered probit of all rows before; gain: the sign of the
    signal times the change. Refitted every `every` rows; rows before `first`, and fits of fewer than three classes, have none."""
    kind, out, known = np.where(change > 0.01, 2, np.where(change < -0.01, 0, 1)), [], None
    cdf = lambda z: 1 - tails.normal_sf(z)
    for i, t in enumerate(range(first, len(change))):
        if i % every == 0:
            sd = x[:t].std(0)
            known = (x[:t].mean(0), np.where(sd > 0, sd, 1)) + tuple(fit(kind[:t], (x[:t] - x[:t].mean(0)) / np.where(sd > 0, sd, 1), steps=12)[:2]) if len(set(kind[:t])) == 3 else None
        if known is None:
            continue
        mean, sd, beta, cuts = known
        z = float((x[t] - mean) / sd @ beta)
        signal = (1 - cdf(cuts[1] - z)) - cdf(cuts[0] - z)
        out.append((t, signal, float(change[t]), float(np.sign(signal) * change[t])))
    return pd.DataFrame(out, columns=["t", "signal", "actual", "gain"])


def adf_p(stat: float) -> float:
    """Approximate p of an augmented Dickey-Fuller statistic with a constant."""
    if stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    c = ADF_SMALL if stat <= ADF_TURN else ADF_LARGE
    return 1 - tails.normal_sf(sum(a * stat**i for i, a in enumerate(c)))


def kpss_auto(y: np.ndarray) -> tuple[float, float]:
    """(statistic, p) around a level, with lags chosen by the data; p is read off the table, within 0.01 and 0.10."""
    e, n = y - y.mean(), len(y)
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = 2 * float(e[i:] @ e[:-i]) / n
        s0, s1 = s0 + c, s1 + i * c
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    var = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))) / n
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / var)
    return stat, float(np.interp(stat, [a for a, _ in KPSS_TABLE], [p for _, p in KPSS_TABLE]))


def correlation_tests(a: np.ndarray, b: np.ndarray, least: int = 10) -> tuple[int, float, float, float, float] | None:
    """(n, Pearson r and p, Spearman r and p with average ranks); None with fewer than `least` pairs."""
    a, b = m.complete(a, b)
    n = len(a)
    if n < least:
        return None
    rank = lambda v: pd.Series(v).rank().to_numpy()
    out = []
    for x, y in ((a, b), (rank(a), rank(b))):
        r = float(np.corrcoef(x, y)[0, 1])
        out += [r, tails.t_p(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2) if abs(r) < 1 else 0.0]
    return (n, *out)
