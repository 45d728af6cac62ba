"""Queries of the as-of joins and windows on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators import temporal as t
from chronotext.session import table


def _kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    pick = lambda k: e.filter(F.col("event_type") == k)
    return pick("purchase").select("event_id", "user_id", "ts"), pick("view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))


def _asof(direction: str, **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        left, right = _kinds(spark, d)
        out = t.asof(left, right, ["user_id"], "ts", "view_ts", ["view_id", "v"], direction, tie=["view_id"], **more)
        return out.select("event_id", F.col("known_view_id").alias("view_id"), F.col("known_v").alias("v"))

    return run


_SIDES = "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS view_ts, event_id AS view_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events WHERE event_type = 'view')"


def _asof_sql(op: str, where: str = "") -> str:
    return f"{_SIDES} SELECT l.event_id, r.view_id, r.v FROM l ASOF LEFT JOIN (SELECT * FROM r {where}) r ON l.user_id = r.user_id AND l.ts {op} r.view_ts"


def strictly_before(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    right = orders.select("o_custkey", F.col("o_orderdate").alias("p_date"), F.col("o_orderkey").alias("p_key"))
    out = t.asof(orders, right, ["o_custkey"], "o_orderdate", "p_date", ["p_key"], tie=["p_key"], exact=False)
    return out.select("o_orderkey", F.col("known_p_key").alias("previous_key"))


def bitemporal(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", F.col("l_shipdate").alias("obs"), F.col("o_orderdate").alias("vintage"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("q"))
    v = v.groupBy("l_partkey", "obs", "vintage").agg(F.max("q").alias("q"))
    days = table(spark, d, "lineitem").select("l_partkey", F.date_trunc("year", F.col("l_shipdate")).cast("timestamp_ntz").alias("day")).distinct()
    return t.bitemporal_asof(days, v, ["l_partkey"], "day", "obs", "vintage", "q").select("l_partkey", F.date_format("day", "yyyy").alias("year"), F.col("known_q").alias("q"), F.date_format("known_obs", "yyyy-MM-dd").alias("obs_day"))


def windows_assigned(spark: SparkSession, d: str) -> DataFrame:
    cal = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.min("o_orderdate").alias("meeting")).select("meeting")
    out = t.assign_window(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), cal, "l_shipdate", "meeting")
    return out.groupBy(F.date_format("window_end", "yyyy-MM-dd").alias("window_end")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def blackout_windows(spark: SparkSession, d: str) -> DataFrame:
    """Vintage rows in (previous blackout, blackout]; the first window opens in 1900, rows after the last are unmatched."""
    cal = table(spark, d, "fomc_calendar").select("blackout_date").dropna().distinct()
    out = t.assign_window(table(spark, d, "vintage_obs").select("obs_id", F.col("realtime_start").cast("date").alias("day")), cal, "day", "blackout_date")
    return out.groupBy(F.date_format("window_end", "yyyy-MM-dd").alias("blackout")).agg(F.count("*").alias("n"), F.sum("obs_id").alias("ids"))


def lagged(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select("o_custkey", "o_orderdate").distinct()
    return t.lagged_alignment(days, "o_orderdate", ["o_custkey"]).select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("aligned", "yyyy-MM-dd").alias("aligned"))


def window_family(spark: SparkSession, d: str) -> DataFrame:
    e, by, o = table(spark, d, "events"), ["user_id"], ["ts", "event_id"]
    e = e.withColumn("gap", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    r = lambda c: F.round(c + 1e-7, 4)
    return t.percent_change(e, "gap", by, o, 12).select(
        "event_id", r(t.diff("value", by, o)).alias("diff"), t.lead_target("value", by, o, 2).alias("lead2"), t.forward_fill("gap", by, o).alias("filled"), r(F.col("change")).alias("change"),
        r(t.expanding_z("value", by, o)).alias("z"), r(t.expanding_centered("value", by, o)).alias("centered"), r(t.rolling_variance("value", by, o)).alias("rolling"), r(t.running_sum("value", by, o)).alias("running"), r(t.position_share(by, o)).alias("position"),
    )


def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return t.keep_one(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


def quarters(spark: SparkSession, d: str) -> DataFrame:
    out = t.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", tie=["o_orderkey"])
    return out.select(F.date_format("bucket_start", "yyyy-MM-dd").alias("bucket_start"), F.date_format("bucket_end", "yyyy-MM-dd").alias("bucket_end"), "first", "last", F.round("mean", 2).alias("mean"))


def daily_filled(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    grid = t.daily_grid(o, "day", ["o_orderpriority"]).join(o, ["o_orderpriority", "day"], "left")
    return grid.select("o_orderpriority", F.date_format("day", "yyyy-MM-dd").alias("day"), t.forward_fill("price", ["o_orderpriority"], ["day"]).alias("price"))


def monthly_line(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.date_trunc("quarter", "o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("price"))
    return t.interpolate_monthly(o, "day", "price").select(F.date_format("month_start", "yyyy-MM-dd").alias("month_start"), F.round("interpolated", 2).alias("interpolated"))


def nearest_written(spark: SparkSession, d: str) -> DataFrame:
    cal = table(spark, d, "fomc_calendar").select(F.col("meeting_date").alias("m")).dropna().distinct()
    src = table(spark, d, "vintage_obs").groupBy(F.col("realtime_start").cast("date").alias("day")).agg(F.max("obs_id").alias("obs_id"))
    return t.nearest_assignment(src, cal, "day", "m", "obs_id", 5, "zero").select(F.date_format("m", "yyyy-MM-dd").alias("m"), "assigned")


QUERIES = {
    "asof_backward": _asof("backward"), "asof_value": _asof("backward", skip_null="v"), "asof_forward": _asof("forward"), "asof_nearest_2d": _asof("nearest", tolerance_days=2), "asof_strict": strictly_before,
    "bitemporal_asof": bitemporal, "interval_windows": windows_assigned, "blackout_windows": blackout_windows, "lagged_alignment": lagged, "window_family": window_family, "keep_last": keep_last, "resample_quarter": quarters, "daily_reindex_ffill": daily_filled, "interpolate_monthly": monthly_line, "nearest_assignment": nearest_written,
}
ORACLES = {
    "asof_backward": _asof_sql(">="),
    "asof_value": _asof_sql(">=", "WHERE v IS NOT NULL"),
    "asof_forward": _asof_sql("<="),
    "asof_nearest_2d": _SIDES + """, b AS (SELECT l.event_id, l.ts, r.view_id, r.v, r.view_ts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.view_ts),
f AS (SELECT l.event_id, r.view_id, r.v, r.view_ts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.view_ts),
g AS (SELECT b.event_id, b.view_id AS bi, b.v AS bv, f.view_id AS fi, f.v AS fv, CASE WHEN epoch_us(b.ts) - epoch_us(b.view_ts) <= 172800000000 THEN epoch_us(b.ts) - epoch_us(b.view_ts) END AS bd, CASE WHEN epoch_us(f.view_ts) - epoch_us(b.ts) <= 172800000000 THEN epoch_us(f.view_ts) - epoch_us(b.ts) END AS fd FROM b JOIN f USING (event_id))
SELECT event_id, CASE WHEN bd IS NOT NULL AND (fd IS NULL OR bd <= fd) THEN bi WHEN fd IS NOT NULL THEN fi END AS view_id, CASE WHEN bd IS NOT NULL AND (fd IS NULL OR bd <= fd) THEN bv WHEN fd IS NOT NULL THEN fv END AS v FROM g""",
    "asof_strict": "SELECT a.o_orderkey, max(b.o_orderkey) FILTER (b.o_orderdate = a.pd) AS previous_key FROM (SELECT o.o_orderkey, o.o_custkey, (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS pd FROM orders o) a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate = a.pd GROUP BY a.o_orderkey",
    "bitemporal_asof": """WITH v AS (SELECT l_partkey, l_shipdate AS obs, o_orderdate AS vintage, max(CASE WHEN l_linenumber > 1 THEN l_quantity END) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
days AS (SELECT DISTINCT l_partkey, CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS day FROM lineitem),
k AS (SELECT d.l_partkey, d.day, v.q, v.obs, row_number() OVER (PARTITION BY d.l_partkey, d.day ORDER BY v.obs DESC, v.vintage DESC) AS n FROM days d JOIN v ON v.l_partkey = d.l_partkey AND v.obs <= d.day AND v.vintage <= d.day AND v.q IS NOT NULL)
SELECT d.l_partkey, strftime(d.day, '%Y') AS year, k.q, strftime(k.obs, '%Y-%m-%d') AS obs_day FROM days d LEFT JOIN k ON k.l_partkey = d.l_partkey AND k.day = d.day AND k.n = 1""",
    "interval_windows": "WITH c AS (SELECT min(o_orderdate) AS m FROM orders GROUP BY date_trunc('month', o_orderdate)), w AS (SELECT l_orderkey, (SELECT min(m) FROM c WHERE m >= l_shipdate) AS e FROM lineitem) SELECT strftime(e, '%Y-%m-%d') AS window_end, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM w GROUP BY 1",
    "blackout_windows": "WITH w AS (SELECT obs_id, (SELECT min(blackout_date) FROM fomc_calendar WHERE blackout_date >= CAST(realtime_start AS DATE)) AS e FROM vintage_obs) SELECT strftime(e, '%Y-%m-%d') AS blackout, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS ids FROM w GROUP BY 1",
    "lagged_alignment": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate), '%Y-%m-%d') AS aligned FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)",
    "window_family": """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS gap FROM events),
f AS (SELECT *, last_value(gap IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(value - lag(value) OVER w + 1e-7, 4) AS diff, lead(value, 2) OVER w AS lead2, filled, round(filled / nullif(lag(filled, 12) OVER w, 0) - 1 + 1e-7, 4) AS change,
 round(CASE WHEN count(value) OVER p >= 3 AND stddev_samp(value) OVER p > 0 THEN (value - avg(value) OVER p) / stddev_samp(value) OVER p END + 1e-7, 4) AS z,
 round(CASE WHEN count(value) OVER p >= 10 THEN value - avg(value) OVER p END + 1e-7, 4) AS centered, round(CASE WHEN count(value) OVER r >= 3 THEN var_samp(value) OVER r END + 1e-7, 4) AS rolling,
 round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-7, 4) AS running, round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) + 1e-7, 4) AS position
FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "keep_last": "SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2",
    "resample_quarter": "SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS bucket_start, strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS bucket_end, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2",
    "daily_reindex_ffill": "WITH o AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY 1, 2), g AS (SELECT o_orderpriority, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM o GROUP BY 1) SELECT g.o_orderpriority, strftime(g.day, '%Y-%m-%d') AS day, last_value(price IGNORE NULLS) OVER (PARTITION BY g.o_orderpriority ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM g LEFT JOIN o USING (o_orderpriority, day)",
    "interpolate_monthly": "WITH o AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY 1), s AS (SELECT day, price, lead(day) OVER (ORDER BY day) AS d2, lead(price) OVER (ORDER BY day) AS v2 FROM o), m AS (SELECT *, CAST(unnest(CASE WHEN d2 IS NULL THEN [CAST(day AS TIMESTAMP)] ELSE generate_series(CAST(day AS TIMESTAMP), CAST(d2 AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 MONTH) END) AS DATE) AS ms FROM s) SELECT strftime(ms, '%Y-%m-%d') AS month_start, round(CASE WHEN d2 IS NULL THEN price ELSE price + (v2 - price) * ((ms - day) / (d2 - day)) END, 2) AS interpolated FROM m",
    "nearest_assignment": """WITH c AS (SELECT DISTINCT meeting_date AS m FROM fomc_calendar WHERE meeting_date IS NOT NULL), s AS (SELECT CAST(realtime_start AS DATE) AS day, max(obs_id) AS obs_id FROM vintage_obs GROUP BY 1),
n AS (SELECT s.*, (SELECT m FROM c WHERE abs(m - s.day) <= 5 ORDER BY abs(m - s.day), m LIMIT 1) AS m FROM s), w AS (SELECT m, arg_max(obs_id, day) AS o FROM n WHERE m IS NOT NULL GROUP BY 1)
SELECT strftime(c.m, '%Y-%m-%d') AS m, coalesce(w.o, 0) AS assigned FROM c LEFT JOIN w USING (m)""",
}
