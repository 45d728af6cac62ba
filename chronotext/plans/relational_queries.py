"""Queries of projections, aggregates, label metrics and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.text import normalized
from chronotext.operators import relational as r
from chronotext.session import table
from chronotext.sources.writers import numbered

TOPICS = ["inflation", "labor_market", "economic_activity", "financial_conditions", "monetary_policy"]


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-7, 4) for n in names})


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").withColumn("score", r.sentiment(F.col("sen"))).withColumn("topics", r.clean_topics(F.col("top")))


def value_map(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("sen").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def document_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = r.document_aggregate(scored(spark, d).filter(r.topical(F.col("topics"))), ["board", "doc_type"], "score", "topics", TOPICS)
    return _round(out, "sent_sd", "sent_var")


def transforms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") - 40
    out = table(spark, d, "events").select("event_id", r.decision(v).alias("decision"), r.cut3(v).alias("cut"), r.signed_power(v).alias("power"), r.signed_log(v).alias("log"), r.rescaled_ends(F.col("event_id") % 5 - 2, 3.0).alias("ends"), r.effective_rate(F.col("value") / 100, F.when(F.col("event_id") % 2 == 0, -1.0)).alias("rate"), (F.col("value") * F.col("user_id")).alias("inter"))
    return _round(out, "power", "log", "rate", "inter")


def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _round(r.order_statistics(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), "p25", "median", "p75", "p99", "iqr", "full_spread", "bowley", "tail_asymmetry")


def unpivot_events(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "fomc_calendar").select("meeting_date", "minutes_date", "blackout_date").unpivot([], ["meeting_date", "minutes_date", "blackout_date"], "event_type", "day").dropna()
    return c.groupBy("event_type", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.min_by("value", F.struct("ts", "event_id")))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """A rule's prediction beside the label: the sign of the stated sentiment against the risk tilt."""
    a = table(spark, d, "annotations").filter((F.col("sen") != "") & (F.col("ris") != ""))
    truth = F.when(r.sentiment(F.col("sen")) > 0, "up").when(r.sentiment(F.col("sen")) < 0, "down").otherwise("none")
    return a.select("id", "board", truth.alias("truth"), F.when(F.col("ris") == "skewed_upside", "up").when(F.col("ris") == "skewed_downside", "down").when(F.col("ris") == "symmetric", "none").otherwise("na").alias("predicted"))


def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(r.label_metrics(_labels(spark, d), "truth", "predicted"), "precision", "recall", "f1")


def summary_score(spark: SparkSession, d: str) -> DataFrame:
    m = r.label_metrics(_labels(spark, d), "truth", "predicted")
    return _round(m.agg(F.sum("tp").alias("n_right"), F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.avg("f1").alias("macro_f1")), "macro_p", "macro_r", "macro_f1")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    names = ["up", "down", "none", "na"]
    return _labels(spark, d).groupBy("truth").pivot("predicted", names).count().na.fill(0)


def multilabel(spark: SparkSession, d: str) -> DataFrame:
    """Topic sets of repeated deliveries of a record: first against last by time of labelling."""
    a = scored(spark, d).filter(F.col("labelled_at").isNotNull()).groupBy("id").agg(F.min_by("topics", F.struct("labelled_at", "topics")).alias("a"), F.max_by("topics", F.struct("labelled_at", "topics")).alias("b"), F.count("*").alias("n")).filter("n > 1")
    s = r.set_scores(F.col("a"), F.col("b"))
    return a.select("id", s["exact"].alias("exact"), F.round(s["jaccard"] + 1e-7, 4).alias("jaccard"))


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(F.explode("topics").alias("topic"), "score").groupBy("topic").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.count_if(F.col("score") > 0).alias("n_up"))


def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).filter("truth <> predicted").groupBy("truth", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "predicted").limit(10)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations")
    return a.groupBy("split_name").agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("sentence", "source", "date", "hor", "top")])


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Groups of records with one normalised text (lower case, without punctuation, single blanks): pre-aggregated, no pairs."""
    norm = normalized(F.translate("sentence", "\x0b", "\t"))
    return table(spark, d, "annotations").filter("sentence is not null").groupBy(norm.alias("text")).agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id")).filter("n_ids > 1")


def pool_minus_seeds(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations").select("id", "split_name")
    return a.filter("split_name = 'train'").select("id").distinct().join(table(spark, d, "annotations").filter("sen <> ''").select("id"), "id", "left_anti")


def seeds_in_pool(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations")
    return a.filter("split_name in ('validation', 'test')").select("id", "board").distinct().join(a.filter("sen <> ''").select("id"), "id", "left_semi")


def top_uncertain(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most uncertain vectors by the entropy of their squared, normalised entries (a top-k report)."""
    e = table(spark, d, "embeddings").withColumn("q", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")))
    e = e.withColumn("s", F.aggregate("q", F.lit(0.0), lambda a, x: a + x)).filter("s > 0").withColumn("p", F.transform("q", lambda x: x / F.col("s")))
    return e.select("vec_id", F.round(r.entropy(F.col("p")), 4).alias("entropy")).orderBy(F.desc("entropy"), "vec_id").limit(20)


def reliability(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") % 100 / 100).alias("p"), (F.col("value") > 30).alias("hit"))
    return _round(r.reliability(e, "p", "hit"), "confidence", "accuracy")


def strategy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Annualised Sharpe ratio (8 periods), hit rate, summed profit and RMSE per user, of value against its mean."""
    e = table(spark, d, "events").select("user_id", (F.col("value") - 40).alias("pnl"))
    out = e.groupBy("user_id").agg(F.try_divide(F.avg("pnl"), F.nullif(F.stddev_samp("pnl"), F.lit(0.0))).alias("s"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.sum("pnl").alias("total"), F.sqrt(F.avg(F.col("pnl") * F.col("pnl"))).alias("rmse"))
    return _round(out.select("user_id", (F.col("s") * F.sqrt(F.lit(8.0))).alias("sharpe"), "hit_rate", "total", "rmse"), "sharpe", "hit_rate", "total", "rmse")


def speaker_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_suppkey").alias("n_supp"))


def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def regression(spark: SparkSession, d: str) -> DataFrame:
    """Slope, intercept, R2 and correlation of price on quantity per flag, in SQL aggregates."""
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_r2("l_extendedprice", "l_quantity").alias("r2"), F.corr("l_extendedprice", "l_quantity").alias("corr"))
    return out.select("l_returnflag", F.round("slope", 3).alias("slope"), F.round("r2", 6).alias("r2"), F.round("corr", 6).alias("corr"))


def rate_path(spark: SparkSession, d: str) -> DataFrame:
    """Implied post-meeting rate from a month's contract price; late meetings use the next contract."""
    from chronotext.functions.macro import implied_rate

    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (100 - F.col("o_totalprice") / 100000).alias("price"), (100 - F.col("o_totalprice") / 90000).alias("next_price"), F.lit(2.0).alias("rate"))
    return _round(o.select("o_orderkey", implied_rate(F.col("day"), F.col("price"), F.col("next_price"), F.col("rate")).alias("implied")), "implied")


def batches(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "events"), "user_id", "event_id", 15).select("event_id", "user_id", "batch")


NAMES = [value_map, document_aggregate, transforms, order_statistics, unpivot_events, pivot_first, label_metrics, summary_score, confusion, multilabel, topic_counts, error_patterns, coverage, duplicate_texts, pool_minus_seeds, seeds_in_pool, top_uncertain, reliability, strategy_metrics, speaker_sets, json_field, regression, rate_path, batches]
QUERIES = {f.__name__: f for f in NAMES}

_SEN = "CASE lower(trim(sen)) WHEN 'strongly_dovish' THEN -2.0 WHEN 'very dovish' THEN -2.0 WHEN 'dovish' THEN -1.0 WHEN 'neutral' THEN 0.0 WHEN 'hawkish' THEN 1.0 WHEN 'strongly_hawkish' THEN 2.0 WHEN 'very hawkish' THEN 2.0 ELSE 0.0 END"
_SCORED = f"WITH sc AS (SELECT *, CAST({_SEN} AS DOUBLE) AS score, list_sort(list_distinct(list_filter(list_transform(coalesce(top, []), lambda x: replace(replace(lower(trim(x)), ' ', '_'), '-', '_')), lambda x: x <> ''))) AS topics FROM annotations)"
_LAB = _SCORED + ", lab AS (SELECT id, CASE WHEN score > 0 THEN 'up' WHEN score < 0 THEN 'down' ELSE 'none' END AS truth, CASE ris WHEN 'skewed_upside' THEN 'up' WHEN 'skewed_downside' THEN 'down' WHEN 'symmetric' THEN 'none' ELSE 'na' END AS predicted FROM sc WHERE sen <> '' AND ris <> '')"
_MET = _LAB + ", u AS (SELECT truth AS label FROM lab UNION SELECT predicted FROM lab), m AS (SELECT label, (SELECT count(*) FROM lab WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM lab WHERE truth <> label AND predicted = label) AS fp, (SELECT count(*) FROM lab WHERE truth = label AND predicted <> label) AS fn FROM u), mm AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM m), me AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM mm)"
_TOP_SUMS = ", ".join(f"coalesce(sum(score) FILTER (list_contains(topics, '{t}')), 0.0) AS sent_{t}" for t in TOPICS)
ORACLES = {
    "value_map": _SCORED + " SELECT sen, count(*) AS n, max(score) AS score FROM sc GROUP BY 1",
    "document_aggregate": _SCORED + f" SELECT board, doc_type, count(*) AS n_sentences, sum(score) AS sent_total, {_TOP_SUMS}, round(stddev_samp(score) + 1e-7, 4) AS sent_sd, round(var_samp(score) + 1e-7, 4) AS sent_var, count(*) FILTER (score > 0) AS n_hawkish, count(*) FILTER (score < 0) AS n_dovish, bool_or(abs(score) = 2) AS flag_extreme FROM sc WHERE len(list_filter(topics, lambda x: x NOT IN ('no_topic', 'boilerplate'))) > 0 GROUP BY 1, 2",
    "transforms": "SELECT event_id, CASE WHEN v > 0.01 THEN 1 WHEN v < -0.01 THEN -1 ELSE 0 END AS decision, CASE WHEN v <= -0.001 THEN 'Down' WHEN v <= 0.001 THEN 'Flat' ELSE 'Up' END AS cut, round(sign(v) * pow(abs(v), 1.1) + 1e-7, 4) AS power, round(sign(v) * ln(1 + abs(v)) + 1e-7, 4) AS log, CAST(CASE WHEN abs(event_id % 5 - 2) = 2 THEN sign(event_id % 5 - 2) * 3.0 ELSE event_id % 5 - 2 END AS DOUBLE) AS ends, round(CASE WHEN value / 100 <= 0.25 AND event_id % 2 = 0 THEN -1.0 ELSE value / 100 END + 1e-7, 4) AS rate, round(value * user_id + 1e-7, 4) AS inter FROM (SELECT *, value - 40 AS v FROM events)",
    "order_statistics": "WITH q AS (SELECT o_orderpriority, min(o_totalprice) AS low, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS p75, max(o_totalprice) AS high, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1) SELECT o_orderpriority, low, high, round(p25 + 1e-7, 4) AS p25, round(median + 1e-7, 4) AS median, round(p75 + 1e-7, 4) AS p75, round(p99 + 1e-7, 4) AS p99, round(p75 - p25 + 1e-7, 4) AS iqr, round(high - low + 1e-7, 4) AS full_spread, round((p75 + p25 - 2 * median) / (p75 - p25) + 1e-7, 4) AS bowley, round((high - median) - (median - low) + 1e-7, 4) AS tail_asymmetry FROM q",
    "unpivot_events": "SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT 'meeting_date' AS event_type, meeting_date AS day FROM fomc_calendar UNION ALL SELECT 'minutes_date', minutes_date FROM fomc_calendar UNION ALL SELECT 'blackout_date', blackout_date FROM fomc_calendar) WHERE day IS NOT NULL GROUP BY 1, 2",
    "pivot_first": "SELECT user_id, " + ", ".join(f"arg_min(value, (ts, event_id)) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "label_metrics": _MET + " SELECT label, tp, fp, fn, round(precision + 1e-7, 4) AS precision, round(recall + 1e-7, 4) AS recall, round(f1 + 1e-7, 4) AS f1 FROM me",
    "summary_score": _MET + " SELECT CAST(sum(tp) AS BIGINT) AS n_right, round(avg(precision) + 1e-7, 4) AS macro_p, round(avg(recall) + 1e-7, 4) AS macro_r, round(avg(f1) + 1e-7, 4) AS macro_f1 FROM me",
    "confusion": _LAB + " SELECT truth, " + ", ".join(f"count(*) FILTER (predicted = '{k}') AS \"{k}\"" for k in ("up", "down", "none", "na")) + " FROM lab GROUP BY 1",
    "multilabel": _SCORED + ", g AS (SELECT id, arg_min(topics, (labelled_at, topics)) AS a, arg_max(topics, (labelled_at, topics)) AS b FROM sc WHERE labelled_at IS NOT NULL GROUP BY id HAVING count(*) > 1) SELECT id, CAST(a = b AS INT) AS exact, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END + 1e-7, 4) AS jaccard FROM g",
    "topic_counts": _SCORED + " SELECT topic, count(*) AS n, sum(score) AS total, count(*) FILTER (score > 0) AS n_up FROM (SELECT unnest(topics) AS topic, score FROM sc) GROUP BY 1",
    "error_patterns": _LAB + " SELECT truth, predicted, count(*) AS n FROM lab WHERE truth <> predicted GROUP BY 1, 2 ORDER BY n DESC, truth, predicted LIMIT 10",
    "coverage": "SELECT split_name, count(*) AS n, count(sentence) AS n_sentence, count(source) AS n_source, count(date) AS n_date, count(hor) AS n_hor, count(top) AS n_top FROM annotations GROUP BY 1",
    "duplicate_texts": r"SELECT regexp_replace(regexp_replace(regexp_replace(lower(replace(sentence, chr(11), chr(9))), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS text, count(DISTINCT id) AS n_ids, min(id) AS first_id FROM annotations WHERE sentence IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 1",
    "pool_minus_seeds": "SELECT DISTINCT id FROM annotations WHERE split_name = 'train' AND id NOT IN (SELECT id FROM annotations WHERE sen <> '')",
    "seeds_in_pool": "SELECT DISTINCT id, board FROM annotations WHERE split_name IN ('validation', 'test') AND id IN (SELECT id FROM annotations WHERE sen <> '')",
    "top_uncertain": "WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS q FROM embeddings), p AS (SELECT vec_id, unnest(q) / list_sum(q) AS p FROM q) SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) END), 4) AS entropy FROM p GROUP BY 1 ORDER BY entropy DESC, vec_id LIMIT 20",
    "reliability": "SELECT CAST(floor(event_id % 100 / 100 * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(event_id % 100 / 100) + 1e-7, 4) AS confidence, round(avg(CAST(value > 30 AS DOUBLE)) + 1e-7, 4) AS accuracy FROM events GROUP BY 1",
    "strategy_metrics": "SELECT user_id, round(avg(value - 40) / nullif(stddev_samp(value - 40), 0) * sqrt(8) + 1e-7, 4) AS sharpe, round(avg(CAST(value - 40 > 0 AS DOUBLE)) + 1e-7, 4) AS hit_rate, round(sum(value - 40) + 1e-7, 4) AS total, round(sqrt(avg((value - 40) * (value - 40))) + 1e-7, 4) AS rmse FROM events GROUP BY 1",
    "speaker_sets": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY 1",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "regression": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem GROUP BY 1",
    "rate_path": "WITH o AS (SELECT o_orderkey, day(o_orderdate) AS d, day(last_day(o_orderdate)) AS n, o_totalprice / 100000 AS f, o_totalprice / 90000 AS g FROM orders) SELECT o_orderkey, round(CASE WHEN n - d <= 7 THEN g ELSE (n * f - d * 2.0) / (n - d) END + 1e-7, 4) AS implied FROM o",
    "batches": "SELECT event_id, user_id, CAST(ceil(row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 15) AS BIGINT) AS batch FROM events",
}
