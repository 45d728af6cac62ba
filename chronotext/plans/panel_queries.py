"""Samples by stratum and the panel that brings document scores to meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.dates import any_date, category_name
from chronotext.operators import relational as r
from chronotext.operators import sampling as s
from chronotext.operators import temporal as t
from chronotext.session import table

TYPES = ["minutes", "statement", "speech"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """One score per day and type, from every annotation with a readable date, however its date and type are written."""
    a = table(spark, d, "annotations").select(category_name(F.col("doc_type")).alias("doc_type"), any_date(F.col("date")).alias("day"), r.sentiment(F.col("sen")).alias("s"))
    return a.filter(F.col("day").isNotNull() & F.col("doc_type").isin(TYPES)).groupBy("doc_type", "day").agg(F.sum("s").alias("score"), F.count("*").alias("n"), F.stddev_samp("s").alias("sd"), F.var_samp("s").alias("var"))


def meeting_panel(spark: SparkSession, d: str) -> DataFrame:
    """Each meeting with the last score of each document type on or before it, and of all types together (one as-of per type, one pivot)."""
    scores = _scores(spark, d).select("doc_type", "day", "score")
    scores = scores.unionByName(scores.groupBy("day").agg(F.sum("score").alias("score")).withColumn("doc_type", F.lit("pooled")))
    meetings = table(spark, d, "fomc_calendar").select(F.col("meeting_date").alias("m")).dropna().distinct()
    asked = meetings.select("m", F.explode(F.array(*map(F.lit, [*TYPES, "pooled"]))).alias("doc_type"))
    known = t.asof(asked, scores, ["doc_type"], "m", "day", ["score"])
    return known.groupBy(F.date_format("m", "yyyy-MM-dd").alias("m")).pivot("doc_type", [*TYPES, "pooled"]).agg(F.first("known_score"))


def window_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Speech scores over the window that ends at each meeting: sums of scores and counts, means of deviations and variances."""
    meetings = table(spark, d, "fomc_calendar").select(F.col("meeting_date").alias("m")).dropna().distinct()
    placed = t.assign_window(_scores(spark, d).filter("doc_type = 'speech'"), meetings, "day", "m")
    mean = lambda c: F.round(F.avg(c) + 1e-9, 5).alias(c)
    return placed.groupBy(F.date_format("window_end", "yyyy-MM-dd").alias("m")).agg(F.sum("score").alias("score"), F.sum("n").alias("n"), mean("sd"), mean("var"))


def stratified_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = s.stratified_split(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", [("train", 0.7), ("validation", 0.15), ("test", 0.15)])
    return out.groupBy("o_orderpriority", "split").agg(F.count("*").alias("n"))


def group_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Samples of 150 of each priority, drawn twice from differently placed rows: how many there are and how many agree."""
    o = table(spark, d, "orders")
    a, b = (r.sample_per_group(x, ["o_orderpriority"], "o_orderkey", 150) for x in (o, o.repartition(5, "o_custkey")))
    return a.join(b.select("o_orderkey", F.lit(1).alias("same")), "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("same").alias("n_same"))


def proportional_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many of 100 events each type gets."""
    return s.proportional(table(spark, d, "events"), "event_type", "event_id", 100).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_keys"))


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    out = s.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", F.round("spearman", 6).alias("spearman"), "n")


def union_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two tables with partly different columns, one below the other, then full outer by day."""
    a = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n_items"))
    return a.join(b, "day", "full_outer").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_orders", "n_items")


QUERIES = {f.__name__: f for f in (meeting_panel, window_rollup, stratified_sizes, group_sample_sizes, proportional_sizes, rank_correlation, union_columns)}
_SEN = "CASE lower(trim(sen)) WHEN 'strongly_dovish' THEN -2 WHEN 'very dovish' THEN -2 WHEN 'dovish' THEN -1 WHEN 'hawkish' THEN 1 WHEN 'strongly_hawkish' THEN 2 WHEN 'very hawkish' THEN 2 ELSE 0 END"
_DAY = "CASE WHEN regexp_full_match(trim(date), '\\d{8}') THEN try_strptime(trim(date), '%Y%m%d') WHEN regexp_matches(trim(date), '^\\d{4}-\\d\\d-\\d\\d') THEN try_strptime(left(trim(date), 10), '%Y-%m-%d') ELSE try_strptime(trim(date), '%B %d, %Y') END"
_ALL = f"al AS (SELECT regexp_replace(lower(trim(doc_type)), '[\\s-]', '_', 'g') AS doc_type, CAST({_DAY} AS DATE) AS day, {_SEN} AS s FROM annotations)"
_SCORES = f"WITH {_ALL}, sc AS (SELECT doc_type, day, CAST(sum(s) AS DOUBLE) AS score, count(*) AS n, stddev_samp(s) AS sd, var_samp(s) AS var FROM al WHERE day IS NOT NULL AND doc_type IN ('minutes', 'statement', 'speech') GROUP BY 1, 2), po AS (SELECT day, sum(score) AS score FROM sc GROUP BY 1), m AS (SELECT DISTINCT meeting_date AS m FROM fomc_calendar WHERE meeting_date IS NOT NULL)"
ORACLES = {
    "meeting_panel": _SCORES + " SELECT strftime(m, '%Y-%m-%d') AS m, " + ", ".join(f"(SELECT arg_max(score, day) FROM sc WHERE doc_type = '{k}' AND day <= m) AS {k}" for k in TYPES) + ", (SELECT arg_max(score, day) FROM po WHERE day <= m) AS pooled FROM m",
    "window_rollup": _SCORES + ", w AS (SELECT *, (SELECT min(m) FROM m WHERE m >= day) AS e FROM sc WHERE doc_type = 'speech' AND day IS NOT NULL) SELECT strftime(e, '%Y-%m-%d') AS m, sum(score) AS score, CAST(sum(n) AS BIGINT) AS n, round(avg(sd) + 1e-9, 5) AS sd, round(avg(var) + 1e-9, 5) AS var FROM w GROUP BY 1",
    "stratified_sizes": "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, 'train' AS split, CAST(round(n * 0.7) AS BIGINT) AS n FROM c UNION ALL SELECT o_orderpriority, 'validation', CAST(round(n * 0.85) - round(n * 0.7) AS BIGINT) FROM c UNION ALL SELECT o_orderpriority, 'test', CAST(n - round(n * 0.85) AS BIGINT) FROM c",
    "group_sample_sizes": "SELECT o_orderpriority, least(150, count(*)) AS n, least(150, count(*)) AS n_same FROM orders GROUP BY 1",
    "proportional_sizes": "WITH c AS (SELECT event_type, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM events WHERE event_type IS NOT NULL) AS x FROM events WHERE event_type IS NOT NULL GROUP BY 1), b AS (SELECT *, least(n, greatest(1, floor(x))) AS f FROM c), o AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, event_type) AS r FROM b) SELECT event_type, CAST(f + CASE WHEN r <= 100 - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(f + CASE WHEN r <= 100 - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS n_keys FROM o",
    "rank_correlation": "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL) SELECT l_returnflag, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY 1",
    "union_columns": "SELECT strftime(day, '%Y-%m-%d') AS day, n_orders, n_items FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_items FROM lineitem GROUP BY 1) b USING (day)",
}
