"""Queries of unions, guards, key joins, cuts, masks, correlations, vintages and the fixed-size samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import macro
from chronotext.functions.dates import any_year
from chronotext.operators import frames as f
from chronotext.operators import relational as r
from chronotext.operators import temporal as t
from chronotext.operators import vintages as vt
from chronotext.plans.known_vintages import plain_number
from chronotext.session import table

ERAS = [("volcker", 1979, 1987), ("greenspan", 1987, 2006), ("bernanke", 2006, 2014), ("yellen", 2014, 2018), ("powell", 2018, 2030)]
REGIMES = {"hiking": ["increase", "raise", "tighten", "higher", "hike"], "cutting": ["reduce", "lower", "ease", "cut", "decrease"], "hold": ["maintain", "unchanged", "steady", "current level"], "crisis": ["extraordinary", "unprecedented", "severe", "emergency", "pandemic", "financial crisis"]}


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers below each other, columns by name, what one side lacks as null."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return f.union_named(c, s)


def key_guard(spark: SparkSession, d: str) -> DataFrame:
    """Days on which only orders or only shipments happen."""
    a = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    b = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return f.key_differences(a, b, "day")


def common_keys(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, and those without, as set operations."""
    every, some = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return every.intersect(some).withColumn("has", F.lit(True)).unionByName(every.exceptAll(some.distinct()).withColumn("has", F.lit(False)))


def monthly_join(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the last shipping day's mean quantity of its month."""
    days = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"))
    return f.join_by_month(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), days, "o_orderdate", "day", ["quantity"]).select("o_orderkey", "quantity")


def index_join(spark: SparkSession, d: str) -> DataFrame:
    """Totals of lines by order beside the order; clashing names kept apart."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return f.join_by_index(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("n")), lines, "k")


def outer_of_three(spark: SparkSession, d: str) -> DataFrame:
    n = lambda name, key, out: table(spark, d, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias(out), F.max(key).alias("largest"))
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return f.outer_all([n("customer", "c_nationkey", "customers"), n("supplier", "s_nationkey", "suppliers"), regions], "nation")


def direction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled counts of days whose mean tax rose, stood or fell against the one before."""
    days = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_tax").alias("x"))
    return f.cut_counts(days.withColumn("change", t.diff("x", [], ["day"])), "change")


def regime_masks(spark: SparkSession, d: str) -> DataFrame:
    return f.masked_counts(table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return f.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


def largest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The order of the highest price of each priority."""
    return f.argmax_row(table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey"), "o_totalprice", ["o_orderpriority"])


def panel_columns(spark: SparkSession, d: str) -> DataFrame:
    """Scaled, rescaled, multiplied and first-known columns of a table, over complete rows of a span of days."""
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.col("value").alias("gdp_value"), (F.col("event_id") % 5 - 2).cast("double").alias("sent_total"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("maybe"))
    made = f.products(f.rescaled(f.scaled(f.between_days(f.complete_rows(e, ["gdp_value"]), "day", "2024-01-05", "2024-01-25"), "GDP", 1e3), "sent_", 3.0), [("sent_total", "gdp_value"), ("sent_total", "none")])
    made = made.select("event_id", F.col("gdp_value"), "sent_total", F.col("inter_sent_total_x_gdp_value").alias("inter"), f.first_known(F.col("maybe"), F.lit(-1.0)).alias("known"), f.guidance_spread(F.col("sent_total"), F.col("gdp_value")).alias("spread"))
    return made.select("event_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("gdp_value", "sent_total", "inter", "known", "spread")])


def encoded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the priorities that have one, and of all with -1 for the rest."""
    codes = {"1-URGENT": 0, "2-HIGH": 1}
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    few = f.encoded(o, "o_orderpriority", codes).groupBy("label").agg(F.count("*").alias("n"))
    return few.unionByName(f.encoded(o, "o_orderpriority", codes, -1).groupBy("label").agg((-F.count("*")).alias("n")))


def eras(spark: SparkSession, d: str) -> DataFrame:
    """Chair and policy regime of every annotation by its year and words."""
    y = any_year(F.col("date"))
    era = F.lit("unknown")
    for name, a, b in reversed(ERAS):
        era = F.when((y >= a) & (y < b), name).otherwise(era)
    s = F.lower(F.coalesce("sentence", F.lit("")))
    counts = [F.struct(sum((F.contains(s, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(REGIMES.items())]
    best = F.array_max(F.array(*counts))
    a = table(spark, d, "annotations").select(F.coalesce(era, F.lit("unknown")).alias("era"), F.when(best["n"] > 0, best["k"]).otherwise("ambiguous").alias("regime"))
    return a.groupBy("era", "regime").agg(F.count("*").alias("n"))


def excluded_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Records by split without those whose id begins with one of some digits."""
    a = f.without_prefixes(table(spark, d, "annotations"), "id", ["0", "a", "f"], 1)
    return a.groupBy("split_name").agg(F.count("*").alias("n"))


def subset_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A fixed-size subset twice (the same both times), and a stratified seed of at least two of each stratum."""
    o = table(spark, d, "orders")
    a, b = f.fixed_sample(o, "o_orderkey", 120), f.fixed_sample(o.repartition(7), "o_orderkey", 120)
    s = f.stratified_seed(o.withColumn("s", F.concat_ws("|", "o_orderpriority", "o_orderstatus")), "s", "o_orderkey", 300)
    return a.join(b.select("o_orderkey"), "o_orderkey").agg(F.count("*").alias("n_same")).crossJoin(s.agg((F.count("*") <= 300).alias("within"), F.count_distinct("s").alias("n_strata")))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vintage_obs").select("series", "obs_id", "obs_date", F.to_date("realtime_start").alias("vintage"), plain_number(F.col("value")).cast("double").alias("x")).dropna()


def needed_vintages(spark: SparkSession, d: str) -> DataFrame:
    """The vintages a calendar needs: for each blackout day the nearest at or before, and the next after."""
    days = table(spark, d, "fomc_calendar").select(F.col("blackout_date").alias("day")).dropna().distinct()
    return vt.needed(days, _obs(spark, d), "day", ["series"], "vintage").select("series", F.date_format("vintage", "yyyy-MM-dd").alias("vintage"), "n_days")


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """First against last published value of each period."""
    r = vt.revisions(_obs(spark, d), ["series", "obs_date"], "vintage", "x", tie="obs_id")
    return r.groupBy("series").agg(F.count("*").alias("n"), F.count_if("revised").alias("n_revised"), F.round(F.max(F.abs(F.col("last") - F.col("first"))), 6).alias("largest"))


def vintage_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The latest 24 periods of each series as they were known on a day."""
    s = vt.snapshot(_obs(spark, d), ["series"], "obs_date", "vintage", "x", "2015-06-30", 24, tie="obs_id")
    return s.select("series", F.date_format("obs_date", "yyyy-MM-dd").alias("period"), "x")


def quarter_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders and shipments of each quarter by its key."""
    n = lambda name, c, out: table(spark, d, name).groupBy(macro.quarter_key(F.to_date(c)).alias("quarter")).agg(F.count("*").alias(out))
    both = n("orders", "o_orderdate", "orders").join(n("lineitem", "l_shipdate", "items"), "quarter")
    return both.select("quarter", "orders", "items", F.date_format(macro.quarter_end(F.col("quarter")), "yyyy-MM-dd").alias("ends"))


def calendar_math(spark: SparkSession, d: str) -> DataFrame:
    """Months apart, contracts by months ahead, the next date of the customer, stars and a search by part of a name."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("meeting", F.date_add("day", (F.col("o_orderkey") % 90).cast("int")))
    p = F.array(*[F.lit(95.0) + i for i in range(3)])
    made = o.withColumns({
        "months": macro.months_apart(F.col("day"), F.col("meeting")), "price": macro.contract_price(F.col("day"), F.col("meeting"), p), "next": t.next_date("day", ["o_custkey"], ["day", "o_orderkey"]),
        "mark": macro.stars((F.col("o_orderkey") % 20) / 100), "urgent": r.contains_text(F.col("o_orderpriority"), "Urgent"), "gap": macro.gap(F.when(F.col("o_orderkey") % 3 > 0, 4.5), 2.0),
    })
    made = made.withColumn("rate", macro.simple_implied_rate(F.col("price"), F.lit(97.5)))
    return made.select("o_orderkey", *r.columns_with(made, ["months", "mark", "urgent", "gap", "rate"]), F.date_format("next", "yyyy-MM-dd").alias("next"))


def long_names(spark: SparkSession, d: str) -> DataFrame:
    """Label counts under the long field names."""
    a = table(spark, d, "annotations").select("ten", "com", "hor").withColumnsRenamed(r.LONG_NAMES)
    return a.groupBy("tense", "commitment", "horizon").agg(F.count("*").alias("n"))


NAMES = [calendar_math, long_names, union_by_name, key_guard, common_keys, monthly_join, index_join, outer_of_three, direction_counts, regime_masks, correlation_matrix, largest_rows, panel_columns, encoded_labels, eras, excluded_prefixes, subset_sizes, needed_vintages, revisions, vintage_snapshot, quarter_join]
QUERIES = {q.__name__: q for q in NAMES}
_OBS = r"ob AS (SELECT series, obs_id, obs_date, CAST(realtime_start AS DATE) AS vintage, CAST(regexp_replace(value, '^\s+|\s+$', '', 'g') AS DOUBLE) AS x FROM vintage_obs WHERE regexp_full_match(regexp_replace(value, '^\s+|\s+$', '', 'g'), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') AND series IS NOT NULL AND obs_date IS NOT NULL AND realtime_start IS NOT NULL)"
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MASK = {"flag_above_median": "{c} > (SELECT median({c}) FROM lineitem)", "flag_positive": "{c} > 0", "flag_one": "{c} = 1", "flag_zero": "{c} = 0", "rising": "{c} > 0.001", "falling": "{c} < -0.001"}
_YEAR = r"coalesce(CASE WHEN regexp_matches(trim(date), '^\d{4}-\d{1,2}-\d{1,2}') THEN CAST(left(trim(date), 4) AS INT) WHEN regexp_full_match(trim(date), '\d{8}') THEN year(try_strptime(trim(date), '%Y%m%d')) WHEN regexp_full_match(trim(date), '\d{4}') THEN CAST(trim(date) AS INT) END, TRY_CAST(nullif(regexp_extract(trim(date), '\b((?:19|20)\d{2})\b', 1), '') AS INT))"
_REG = ", ".join(f"row({' + '.join(f'CAST(contains(s, {w!r}) AS INT)' for w in ws)}, {-i}, {k!r})" for i, (k, ws) in enumerate(REGIMES.items()))
ORACLES = {
    "calendar_math": "WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS meeting FROM orders), m AS (SELECT *, CAST((year(meeting) - year(day)) * 12 + month(meeting) - month(day) AS INT) AS months FROM o) SELECT o_orderkey, months, CASE WHEN o_orderkey % 20 < 1 THEN '***' WHEN o_orderkey % 20 < 5 THEN '**' WHEN o_orderkey % 20 < 10 THEN '*' ELSE '' END AS mark, o_orderpriority ILIKE '%urgent%' AS urgent, CASE WHEN o_orderkey % 3 > 0 THEN CAST(2.5 AS DOUBLE) END AS gap, CAST(100 - coalesce(CASE WHEN months < 3 THEN 95 + months END, 97.5) AS DOUBLE) AS rate, strftime(coalesce(lead(day) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey), day + 45), '%Y-%m-%d') AS next FROM m",
    "long_names": "SELECT ten AS tense, com AS commitment, hor AS horizon, count(*) AS n FROM annotations GROUP BY 1, 2, 3",
    "union_by_name": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier",
    "key_guard": "WITH a AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), b AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem) SELECT day, 'left' AS side FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT day, 'right' FROM b WHERE day NOT IN (SELECT day FROM a)",
    "common_keys": "SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer",
    "monthly_join": "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1), m AS (SELECT date_trunc('month', day) AS m, arg_max(q, day) AS q FROM d GROUP BY 1) SELECT o_orderkey, q AS quantity FROM orders LEFT JOIN m ON m.m = date_trunc('month', o_orderdate)",
    "index_join": "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS n, r.n AS n_right FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) r ON l_orderkey = o_orderkey",
    "outer_of_three": "SELECT nation, customers, c.largest, suppliers, region FROM (SELECT c_nationkey AS nation, count(*) AS customers, max(c_nationkey) AS largest FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) s USING (nation) FULL JOIN (SELECT n_nationkey AS nation, n_regionkey AS region FROM nation) r USING (nation)",
    "direction_counts": "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_tax) AS x FROM lineitem GROUP BY 1), c AS (SELECT x - lag(x) OVER (ORDER BY day) AS z FROM d) SELECT direction, count(z) FILTER (CASE direction WHEN 'Down' THEN z <= -0.001 WHEN 'Flat' THEN z > -0.001 AND z <= 0.001 ELSE z > 0.001 END) AS n FROM (SELECT unnest(['Down', 'Flat', 'Up']) AS direction), c GROUP BY 1",
    "regime_masks": " UNION ALL ".join(f'SELECT \'{c}\' AS "column", \'{m}\' AS mask, count(*) AS n FROM lineitem WHERE {e.format(c=c)}' for c in ("l_discount", "l_tax", "l_quantity") for m, e in _MASK.items()),
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(_COLS) for b in _COLS[i:]),
    "largest_rows": "SELECT o_orderpriority, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "panel_columns": "WITH e AS (SELECT event_id, value / 1e3 AS g, CAST(event_id % 5 - 2 AS DOUBLE) * 1.5 AS s, CASE WHEN event_id % 3 = 0 THEN value END AS m FROM events WHERE value IS NOT NULL AND CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-25') SELECT event_id, round(g + 1e-9, 6) AS gdp_value, round(s + 1e-9, 6) AS sent_total, round(s * g + 1e-9, 6) AS inter, round(coalesce(m, -1) + 1e-9, 6) AS known, round(s - g + 1e-9, 6) AS spread FROM e",
    "encoded_labels": "WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 END AS l FROM orders) SELECT l AS label, count(*) AS n FROM c WHERE l IS NOT NULL GROUP BY 1 UNION ALL SELECT coalesce(l, -1), -count(*) FROM c GROUP BY 1",
    "eras": f"WITH y AS (SELECT CASE WHEN lower(trim(date)) <> 'unknown' THEN {_YEAR} END AS y, lower(coalesce(sentence, '')) AS s FROM annotations) SELECT CASE {' '.join(f'WHEN y >= {a} AND y < {b} THEN {k!r}' for k, a, b in ERAS)} ELSE 'unknown' END AS era, (SELECT CASE WHEN h[1] > 0 THEN h[3] ELSE 'ambiguous' END FROM (SELECT unnest([{_REG}]) AS h) ORDER BY h[1] DESC, h[2] DESC LIMIT 1) AS regime, count(*) AS n FROM y GROUP BY 1, 2",
    "excluded_prefixes": "SELECT split_name, count(*) AS n FROM annotations WHERE id IS NULL OR left(id, 1) NOT IN ('0', 'a', 'f') GROUP BY 1",
    "subset_sizes": "SELECT least(120, count(*)) AS n_same, true AS within, count(DISTINCT (o_orderpriority, o_orderstatus)) AS n_strata FROM orders",
    "needed_vintages": f"WITH {_OBS}, d AS (SELECT DISTINCT blackout_date AS day FROM fomc_calendar WHERE blackout_date IS NOT NULL), v AS (SELECT DISTINCT series, vintage FROM ob), n AS (SELECT series, day, max(vintage) FILTER (vintage <= day) AS a, min(vintage) FILTER (vintage > day) AS b FROM v, d GROUP BY 1, 2), u AS (SELECT series, a AS v FROM n WHERE a IS NOT NULL UNION ALL SELECT series, b FROM n WHERE b IS NOT NULL) SELECT series, strftime(v, '%Y-%m-%d') AS vintage, count(*) AS n_days FROM u GROUP BY 1, 2",
    "revisions": f"WITH {_OBS}, r AS (SELECT series, obs_date, arg_min(x, (vintage, obs_id)) AS f, arg_max(x, (vintage, obs_id)) AS l FROM ob GROUP BY 1, 2) SELECT series, count(*) AS n, count(*) FILTER (f <> l) AS n_revised, round(max(abs(l - f)), 6) AS largest FROM r GROUP BY 1",
    "vintage_snapshot": f"WITH {_OBS}, k AS (SELECT series, obs_date, arg_max(x, (vintage, obs_id)) AS x FROM ob WHERE vintage <= '2015-06-30' AND obs_date <= '2015-06-30' GROUP BY 1, 2) SELECT series, strftime(obs_date, '%Y-%m-%d') AS period, x FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY obs_date DESC) AS rn FROM k) WHERE rn <= 24",
    "quarter_join": "WITH q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, count(*) AS items, strftime(max(date_trunc('quarter', l_shipdate)) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS ends FROM lineitem GROUP BY 1) SELECT quarter, orders, items, ends FROM q JOIN l USING (quarter)",
}
