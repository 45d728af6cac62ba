"""Queries of the regression pipeline: a panel of meetings aggregated in Spark, each specification a group of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.dates import any_date, category_name
from chronotext.functions.gardner import net_words
from chronotext.operators import relational as r
from chronotext.operators import temporal as t
from chronotext.plans.known_vintages import _KNOWN, known_vintages
from chronotext.plans.panel_queries import _DAY, _SEN
from chronotext.plans.scoring_queries import _NET
from chronotext.session import table
from chronotext.stats import favar as fv
from chronotext.stats import models as m

KINDS = ["gdp_real", "cpi_all", "payrolls", "ind_output", "gdp_nominal", "import_prices", "jobless_rate", "capacity_use"]
TARGET, REGRESSORS = "gdp_real", KINDS[:6]
TOPICS = ["monetary_policy", "inflation", "labor_market", "economic_activity", "financial_conditions", "macro"]
MATCHED = {"sent_economic_activity": "gdp_real", "sent_financial_conditions": "import_prices", "sent_labor_market": "payrolls", "sent_monetary_policy": "ind_output", "sent_inflation": "cpi_all", "sent_macro": "gdp_real"}
ENDS = [1.0, 1.5, 2.0, 2.5, 3.0]
TYPES = ["minutes", "statement", "speech", "press_conference_prepared"]


def panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per meeting: the mean log of what was known of each kind of series, and the sentiment of the last day of records up to it."""
    known = known_vintages(table(spark, d, "fomc_calendar"), table(spark, d, "vintage_obs")).filter("event_type = 'meeting_date'")
    known = known.withColumn("kind", F.regexp_replace("series", r"_\d+$", ""))
    macro = known.groupBy("day").pivot("kind", KINDS).agg(F.avg(F.signum("known_number") * F.log1p(F.abs("known_number"))))
    a = table(spark, d, "annotations").select(any_date(F.col("date")).alias("on"), category_name(F.col("doc_type")).alias("type"), r.sentiment(F.col("sen")).alias("s"), r.clean_topics(F.col("top")).alias("tops"), "wid", "ris", (F.size(F.split("sentence", " "))).alias("w"), net_words(F.col("sentence")).alias("net"))
    s = F.col("s")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    days = a.filter("on IS NOT NULL").groupBy("on").agg(
        total(s).alias("sent_total"), F.stddev_samp(s).alias("sent_sd"), F.var_samp(s).alias("sent_var"), *[total(F.when(F.array_contains("tops", k), s)).alias(f"sent_{k}") for k in TOPICS],
        *[total(F.when(F.abs(s) == 2, F.signum(s) * e).otherwise(s)).alias(f"end_{round(10 * e)}") for e in ENDS], total(r.signed_power(s)).alias("agg_power"), total(r.signed_log(s)).alias("agg_log"),
        F.count_if(F.col("wid") == "elevated").alias("flag_elevated"), F.count_if(F.col("ris") == "skewed_downside").alias("flag_down"), *[total(F.when(F.col("type") != k, s)).alias(f"without_{k}") for k in TYPES],
        F.sum("net").alias("net_none"), (F.sum("net") / F.nullif(F.sum("w"), F.lit(0))).alias("net_wordcount"),
    )
    names = [c for c in days.columns if c != "on"]
    meetings = table(spark, d, "fomc_calendar").select(F.col("meeting_date").alias("day")).dropna().distinct()
    both = t.asof(meetings, days, [], "day", "on", names).select("day", *[F.col(f"known_{c}").cast("double").alias(c) for c in names])
    return both.join(macro, "day", "left")


def _each(spark: SparkSession, d: str, specs: list[str], run, schema: str) -> DataFrame:
    """run(panel sorted by day, spec) for each spec, one group each."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        spec = g["spec"].iloc[0]
        return pd.DataFrame(run(g.drop(columns=["spec"]).sort_values("day").reset_index(drop=True), spec))

    named = panel(spark, d).withColumn("spec", F.explode(F.array(*map(F.lit, specs))))
    return named.groupBy("spec").applyInPandas(one, schema)


def _extra(p: pd.DataFrame, spec: str, end: float = 2.0) -> pd.DataFrame | None:
    return fv.added_terms(p, spec, TOPICS, MATCHED, REGRESSORS, end)


def favar_specifications(spark: SparkSession, d: str) -> DataFrame:
    """The baseline, and every set of added terms at every scale of the extremes."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        name, _, end = spec.partition("@")
        return [fv.row(spec, fv.augmented(p, REGRESSORS, TARGET, None if name == "baseline" else _extra(p, name, float(end))))]

    return _each(spark, d, ["baseline", *[f"{s}@{e}" for s in fv.SPECS for e in ENDS]], run, fv.RESULT)


def favar_masks(spark: SparkSession, d: str) -> DataFrame:
    """The model of all topics on the rows of each mask, with the factors of the whole panel; too few rows are skipped."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        return [fv.row(spec, fv.augmented(p, REGRESSORS, TARGET, _extra(p, "all_topics"), fv.masks(p, ["flag_elevated", "flag_down"], TARGET)[spec]), "lookahead" if "lookahead" in spec else "")]

    names = ["target_up_lookahead", "target_down_lookahead", *[f"{c}_{k}" for c in ("flag_elevated", "flag_down") for k in ("above_median", "positive", "one", "zero")]]
    return _each(spark, d, names, run, fv.RESULT)


def favar_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Extremes rescaled before they are summed, sums of powers and logs, and normalised word scores."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        if spec == "net_zscore":
            past = p["net_none"].expanding(3)
            p["net_zscore"] = (p["net_none"] - past.mean().shift(1)) / past.std().shift(1).replace(0, np.nan)
        return [fv.row(spec, fv.augmented(p, REGRESSORS, TARGET, p[[spec]]))]

    return _each(spark, d, [*[f"end_{round(10 * e)}" for e in ENDS], "sent_total", "agg_power", "agg_log", "net_none", "net_wordcount", "net_zscore"], run, fv.RESULT)


def favar_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Another target, each document type left out, and shuffles of the sentiment: n, adjusted R2, and what the check gives."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        if spec.startswith("without_"):
            return [fv.row(spec, fv.augmented(p, REGRESSORS, TARGET, p[[spec]]))]
        if spec == "target_payrolls":
            return [fv.row(spec, fv.augmented(p, REGRESSORS, "payrolls", p[["sent_total"]]))]
        fit = fv.augmented(p, REGRESSORS, TARGET, p[["sent_total"]])
        if fit is None:
            return [fv.row(spec, None)]
        if spec == "placebo":
            return [fv.row(spec, fit, f"p {m.placebo_p(fit['y'], fit['x'], fit['x'].shape[1] - 1, 500):.4f}")]
        bands = fv.rolling_bands(fit["y"], fit["x"], fit["x"].shape[1] - 1)
        return [fv.row(spec, fit, f"{int(((bands['low'] > 0) | (bands['high'] < 0)).sum())} of {len(bands)} windows")]

    return _each(spark, d, ["target_payrolls", *[f"without_{k}" for k in TYPES], "placebo", "rolling"], run, fv.RESULT)


def favar_terms(spark: SparkSession, d: str) -> DataFrame:
    """Matched terms that either test retains, candidates screened one by one, and sentiment with uncertainty taken out."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        base = fv.factors(p, REGRESSORS, fv.MACRO_SHARE)
        if base is None:
            return []
        if spec == "screen":
            cs = [c for c in p if c.startswith(("end_", "agg_", "net_", "flag_"))]
            return [(spec, c, n, s, q, None, w == "*" or len(w) > 1) for c, n, s, q, w in fv.screen(p, TARGET, [x for x in REGRESSORS[:2] if p[x].notna().any()], cs)]
        y = fv.ahead(p, TARGET).reindex(base.index)
        if spec == "retain":
            terms = _extra(p, "matched").reindex(base.index)
            terms = terms[[c for c in terms if terms[c].notna().any()]]
            ok = pd.concat([y, base, terms], axis=1).dropna().index
            return [(spec, n, len(ok), s, a, b, k) for n, s, a, b, k in fv.retained(y[ok].to_numpy(), base.loc[ok].to_numpy(), terms.loc[ok].to_numpy(), list(terms))] if len(ok) >= fv.LEAST_ROWS else []
        both = pd.concat([y, base, p.loc[base.index, ["sent_total", "sent_inflation", "flag_elevated"]]], axis=1).dropna()
        if len(both) < fv.LEAST_ROWS:
            return []
        got = fv.residual_tests(both.iloc[:, 0].to_numpy(), both[base.columns].to_numpy(), both[["sent_total", "sent_inflation"]].to_numpy(), both["flag_elevated"].to_numpy())
        return [(spec, k, len(both), got[f"f_{k}"], got[f"p_{k}"], got["max_r2"], bool(got[f"p_{k}"] < 0.1)) for k in ("raw", "resid")]

    return _each(spark, d, ["screen", "retain", "residual"], run, "spec string, term string, n long, stat double, p double, other double, kept boolean")


def favar_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts one and two meetings ahead from three first sizes, factors against factors with sentiment; and the signal of a probit."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        base = fv.factors(p, REGRESSORS, fv.MACRO_SHARE)
        if base is None:
            return []
        full = base.join(p["sent_total"])
        if spec == "probit":
            both = pd.concat([p[TARGET].shift(-1) - p[TARGET], full.iloc[:, [0, -1]]], axis=1).dropna()
            g = fv.walk_forward_probit(both.iloc[:, 0].to_numpy(), both.iloc[:, 1:].to_numpy(), 20, 12)
            return [(spec, len(g), None, None, None, None, float((np.sign(g["signal"]) == np.sign(g["actual"])).mean()) if len(g) else None, float(g["gain"].sum()), "")]
        h, first = map(int, spec.split("/"))
        both = pd.concat([fv.ahead(p, TARGET, h).reindex(full.index), p[TARGET].reindex(full.index), full], axis=1).dropna()
        got = fv.walk_forward(both.iloc[:, 0].to_numpy(), both.iloc[:, 1].to_numpy(), both[base.columns].to_numpy(), both[full.columns].to_numpy(), h, first)
        return [(spec, got["n"], *[got.get(k) for k in ("rmse_base", "rmse_full", "cw_t", "cw_p", "right")], None, got.get("tradeable", ""))]

    return _each(spark, d, [*[f"{h}/{n}" for h in (1, 2) for n in (20, 30, 40)], "probit"], run, "spec string, n long, rmse_base double, rmse_full double, cw_t double, cw_p double, right double, gain double, tradeable string")


def panel_tests(spark: SparkSession, d: str) -> DataFrame:
    """Unit roots and levels of the sentiment columns, with p and verdict; correlations of each with the word scores."""

    def run(p: pd.DataFrame, spec: str) -> list[tuple]:
        y = p[spec].dropna().to_numpy(float)
        c = fv.correlation_tests(p[spec].to_numpy(float), p["net_none"].to_numpy(float))
        if len(y) < 20 or c is None or y.std() == 0:
            return []
        stat, _ = m.adf(y)
        a, (k, kp) = fv.adf_p(stat), fv.kpss_auto(y)
        verdict = "stationary" if a < 0.05 < kp else "non-stationary" if a >= 0.05 >= kp else "conflicting"
        return [(spec, len(y), stat, a, k, kp, verdict, *c[1:])]

    return _each(spark, d, ["sent_total", "sent_sd", *[f"sent_{k}" for k in TOPICS]], run, "spec string, n long, adf double, adf_p double, kpss double, kpss_p double, verdict string, pearson double, pearson_p double, spearman double, spearman_p double")


def best_specification(spark: SparkSession, d: str) -> DataFrame:
    """The added terms of the highest adjusted R2, first by name of equals."""
    rows = favar_specifications(spark, d).filter("adj_r2 IS NOT NULL")
    return rows.orderBy(F.col("adj_r2").desc(), "spec").limit(1).select("spec", "n", "adj_r2")


SHOWN = ["sent_total", "sent_sd", "sent_inflation", "end_15", "agg_power", "flag_elevated", "without_minutes", "net_none", "gdp_real"]


def analysis_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel of the regressions: sentiment up to each meeting beside the macro series as they were known."""
    return panel(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in SHOWN])


NAMES = [analysis_panel, favar_specifications, favar_masks, favar_scaling, favar_robustness, favar_terms, favar_walk_forward, panel_tests, best_specification]
QUERIES = {f.__name__: f for f in NAMES}
ORACLES = {
    "analysis_panel": f"""{_KNOWN}, mc AS (SELECT day, avg(sign(number) * ln(1 + abs(number))) AS gdp_real FROM best WHERE rn = 1 AND event_type = 'meeting_date' AND regexp_replace(series, '_\\d+$', '') = 'gdp_real' GROUP BY 1),
al AS (SELECT CAST({_DAY} AS DATE) AS on_, regexp_replace(lower(trim(doc_type)), '[\\s-]', '_', 'g') AS type, CAST({_SEN} AS DOUBLE) AS s, list_transform(coalesce(top, []), lambda z: replace(replace(lower(trim(z)), ' ', '_'), '-', '_')) AS tops, wid, {_NET('sentence')} AS net FROM annotations),
dd AS (SELECT on_, sum(s) AS sent_total, stddev_samp(s) AS sent_sd, coalesce(sum(s) FILTER (list_contains(tops, 'inflation')), 0) AS sent_inflation, sum(CASE WHEN abs(s) = 2 THEN sign(s) * 1.5 ELSE s END) AS end_15, sum(sign(s) * pow(abs(s), 1.1)) AS agg_power, count(*) FILTER (wid = 'elevated') AS flag_elevated, coalesce(sum(s) FILTER (type <> 'minutes'), 0) AS without_minutes, sum(net) AS net_none FROM al WHERE on_ IS NOT NULL GROUP BY 1),
mm AS (SELECT DISTINCT meeting_date AS day FROM fomc_calendar WHERE meeting_date IS NOT NULL), last AS (SELECT mm.day, max(on_) AS on_ FROM mm LEFT JOIN dd ON on_ <= mm.day GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, {", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 5) AS {c}" for c in SHOWN)} FROM last LEFT JOIN dd USING (on_) LEFT JOIN mc USING (day)""",
}
