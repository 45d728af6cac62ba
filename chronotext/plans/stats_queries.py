"""Queries of the regression layer: a panel aggregated in Spark, specifications fitted in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.session import table
from chronotext.stats import models as m


def panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per day of shipping: at most as many rows as there are days."""
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"), F.count("*").cast("double").alias("n"))


SPECS = {"a": ["a"], "ab": ["a", "b"], "abc": ["a", "b", "c"], "abcn": ["a", "b", "c", "n"]}


def spec_grid(spark: SparkSession, d: str) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        cols = SPECS[g["spec"].iloc[0]]
        g = g.sort_values("day")
        y, x = m.complete(g["y"].to_numpy(float), g[cols].to_numpy(float))
        hc3, hac = m.ols(y, x, "HC3"), m.ols(y, x, "HAC")
        return pd.DataFrame([(g["spec"].iloc[0], hc3["n"], hc3["r2"], hc3["adj_r2"], hc3["se"][1], hac["se"][1], hc3["f_p"], m.oos_rmse(y, x), float(m.vif(x).max()) if len(cols) > 1 else 1.0)])

    specs = spark.createDataFrame([(k,) for k in SPECS], "spec string").withColumn("one", F.lit(1))
    return m.per_specification(panel(spark, d).withColumn("one", F.lit(1)), specs, ["one"], run, "spec string, n long, r2 double, adj_r2 double, se_hc3 double, se_hac double, f_p double, oos_rmse double, vif double")


def stationarity(spark: SparkSession, d: str) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day")
        y = g[g["spec"].iloc[0]].dropna().to_numpy(float)
        stat, lags = m.adf(y, 5)
        k = m.kpss(y)
        return pd.DataFrame([(g["spec"].iloc[0], stat, lags, k, "stationary" if stat < -2.86 and k < 0.463 else "unit root" if stat >= -2.86 and k >= 0.463 else "unclear")])

    specs = spark.createDataFrame([(k,) for k in "yabc"], "spec string").withColumn("one", F.lit(1))
    return m.per_specification(panel(spark, d).withColumn("one", F.lit(1)), specs, ["one"], run, "spec string, adf double, lags long, kpss double, verdict string")


def residual_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fitted and residual parts of y on a, in SQL aggregates."""
    p = panel(spark, d)
    b = p.agg(F.regr_slope("y", "a").alias("s"), F.regr_intercept("y", "a").alias("i"))
    return p.join(F.broadcast(b)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.col("i") + F.col("s") * F.col("a"), 3).alias("fitted"), F.round(F.col("y") - F.col("i") - F.col("s") * F.col("a"), 3).alias("residual"))


def factors(spark: SparkSession, d: str) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("day")[["a", "b", "c", "n"]].dropna().to_numpy(float)
        _, load, part = m.pca(x, 0.9)
        return pd.DataFrame([(i, float(part[i]), *map(float, np.round(load[i], 6))) for i in range(len(part))])

    return panel(spark, d).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "factor int, share double, a double, b double, c double, n double")


QUERIES = {f.__name__: f for f in (spec_grid, stationarity, residual_fit, factors)}
ORACLES = {
    "residual_fit": "WITH p AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS y, avg(l_quantity) AS a FROM lineitem GROUP BY 1), b AS (SELECT regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM p) SELECT strftime(day, '%Y-%m-%d') AS day, round(i + s * a, 3) AS fitted, round(y - i - s * a, 3) AS residual FROM p, b",
}
