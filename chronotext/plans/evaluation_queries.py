"""Queries of the evaluation layer: the labelled annotations against a stand-in model that is wrong by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.macro import number_range
from chronotext.operators import evaluation as e
from chronotext.operators import relational as r
from chronotext.operators.sampling import uncertain_round
from chronotext.session import table

SCALE = list(r.SCALE)
TOPICS = ["inflation", "labor_market", "economic_activity", "macro", "financial_conditions", "monetary_policy", "boilerplate", "no_topic"]


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Per id the largest labels of its rows: one record an id, whatever was delivered again."""
    a = table(spark, d, "annotations").filter((F.col("sen") != "") & F.col("id").isNotNull())
    return a.groupBy("id").agg(F.max("sen").alias("sen"), F.max("ris").alias("ris"), F.max("wid").alias("wid"), F.max("top").alias("top"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Truth and prediction by id; the stand-in calls every third id (by its first digit) neutral and drops topics of every fourth."""
    t = _truth(spark, d).select("id", e.label(F.col("sen")).alias("sen"), e.label(F.col("ris")).alias("ris"), e.label(F.col("wid")).alias("wid"), e.label_list(F.col("top")).alias("top"))
    k = F.conv(F.substring("id", 1, 2), 16, 10).cast("int")
    p = t.select("id", F.when(k % 3 == 0, "neutral").otherwise(F.col("sen")).alias("sen"), F.when(k % 5 == 0, "na").otherwise(F.col("ris")).alias("ris"), F.when(k % 7 == 0, "none").otherwise(F.col("wid")).alias("wid"), F.when(k % 4 == 0, F.array(F.lit("macro"))).otherwise(F.col("top")).alias("top"))
    return e.joined(p.filter(k % 11 != 0), t)


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def single_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = [_r(e.single_label(_pairs(spark, d), f"{f}_t", f"{f}_p"), "accuracy", "precision", "recall", "f1", "f1_weighted").withColumn("field", F.lit(f)) for f in ("sen", "ris", "wid")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def multi_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The three definitions in use: Jaccard, F1 over observed labels, F1 over the fixed eight."""
    pairs = _pairs(spark, d)
    seen, fixed = e.multi_label(pairs, "top_t", "top_p"), e.multi_label(pairs, "top_t", "top_p", TOPICS)
    return _r(seen.crossJoin(fixed.select(F.col("f1").alias("f1_fixed"))), "exact", "jaccard", "precision", "recall", "f1", "f1_fixed")


def summary_of_fields(spark: SparkSession, d: str) -> DataFrame:
    """The plain mean of the four primary fields, the topic by its Jaccard and by its F1."""
    pairs = _pairs(spark, d)
    fields = pairs.sparkSession.range(1)
    for f in ("sen", "ris", "wid"):
        fields = fields.crossJoin(e.single_label(pairs, f"{f}_t", f"{f}_p").select(F.col("f1").alias(f)))
    fields = fields.crossJoin(e.multi_label(pairs, "top_t", "top_p").select("jaccard", "f1"))
    mean = lambda top: F.round((F.col("sen") + F.col("ris") + F.col("wid") + F.col(top)) / 4 + 1e-9, 6)
    return fields.select(mean("jaccard").alias("by_jaccard"), mean("f1").alias("by_f1"))


def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    return _r(e.confusion(_pairs(spark, d), "sen_t", "sen_p", SCALE), "share")


def error_directions(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select(r.sentiment(F.col("sen_t")).alias("t"), r.sentiment(F.col("sen_p")).alias("p"))
    return e.directions(p, "t", "p")


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in against a model that always says neutral."""
    return e.two_models(_pairs(spark, d).withColumn("base", F.lit("neutral")), "sen_t", "sen_p", "base")


def topic_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _r(e.accuracy_by(_pairs(spark, d), "top_t", "sen_t", "sen_p"), "accuracy")


def _probable(spark: SparkSession, d: str) -> DataFrame:
    """A distribution over the scale for each record: 0.6 on the prediction, 0.1 on each other label."""
    p = _pairs(spark, d).filter(F.col("sen_t").isin(SCALE) & F.col("sen_p").isin(SCALE))
    return p.withColumn("probs", F.map_from_arrays(F.array(*map(F.lit, SCALE)), F.array(*[F.when(F.col("sen_p") == k, 0.6).otherwise(0.1) for k in SCALE])))


def log_losses(spark: SparkSession, d: str) -> DataFrame:
    return _r(e.log_loss(_probable(spark, d), "probs", "sen_t"), "log_loss")


def statement_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per first digit of the id: mean, median and deviation of the expected scores, as inputs of a policy rule."""
    s = e.rollup(_probable(spark, d).withColumn("g", F.substring("id", 1, 1)), ["g"], "probs", e.ORDINAL["sen"])
    none = s.limit(0)
    out = e.rule_inputs(s, none, none, ["g"]).join(s.select("g", "median_score", "mean_confidence", "share_neutral"), "g")
    return _r(out, "sentiment_score", "sentiment_entropy", "dispersion", "median_score", "mean_confidence", "share_neutral")


def parse_rates(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stand-in model, read back: how many cannot be read."""
    k = F.conv(F.substring("id", 1, 2), 16, 10).cast("int")
    answer = F.when(k % 5 == 0, F.lit("I cannot say.")).when(k % 5 == 1, F.concat(F.lit('Thinking {"topic": "x"} ANSWER: {"sentiment": "'), "sen", F.lit('", "more": {"a": 1}}'))).otherwise(F.concat(F.lit('{"note": 1} so {"sentiment": "'), "sen", F.lit('"}.')))
    read = _truth(spark, d).withColumn("parsed", e.answer_object(answer, ["topic", "tense", "sentiment"]))
    same = read.select((F.get_json_object("parsed", "$.sentiment") == F.col("sen")).alias("ok"), "parsed")
    return _r(e.parse_failures(same, "parsed"), "rate").crossJoin(same.agg(F.count_if("ok").alias("n_right")))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "annotations").filter("sentence IS NOT NULL").select("id", e.prompt('Label this.\nSentence: "{sentence}"', F.col("sentence"), F.col("context_question")).alias("p"))
    return made.select("id", F.length("p").cast("bigint").alias("n_chars"), F.md5("p").alias("prompt"))


def target_records(spark: SparkSession, d: str) -> DataFrame:
    """Label records as JSON with long names, read back field by field."""
    made = table(spark, d, "annotations").select("id", e.target_json().alias("j"))
    return made.select("id", F.get_json_object("j", "$.sentiment").alias("sentiment"), F.get_json_object("j", "$.horizon").alias("horizon"), F.get_json_object("j", "$.topic[0]").alias("first_topic"))


def purest_records(spark: SparkSession, d: str) -> DataFrame:
    """How pure the records of a label are: counts by purity, and how many of the 15 purest of each risk label it takes."""
    a = table(spark, d, "annotations").filter("sen <> ''")
    return a.groupBy("ris", e.purity({f: F.col(f) for f in ("ten", "sen", "hor", "com", "ris", "wid")}, F.col("top")).cast("bigint").alias("purity")).agg(F.count("*").alias("n"))


def uncertain_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    """A round of 40 records by the entropy of a stand-in model, at most ten of them on financial conditions; test records count as labelled."""
    a = _probable(spark, d).withColumn("k", F.conv(F.substring("id", 1, 6), 16, 10).cast("double"))
    pool = a.select("id", F.round(r.entropy(F.array((F.col("k") + 1) / 33554434, 1 - (F.col("k") + 1) / 33554434)), 9).alias("u"), F.array_contains("top_t", "financial_conditions").alias("crisis"))
    labelled = table(spark, d, "annotations").filter("split_name = 'test'")
    return uncertain_round(pool, labelled, "id", "u", "crisis", 40).select("id", "crisis")


def ranges_read(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "part").select("p_partkey", number_range(F.concat_ws(" to ", F.col("p_size").cast("string"), (F.col("p_size") + 3).cast("string"))).alias("middle"))
    return made


NAMES = [single_label_metrics, multi_label_metrics, summary_of_fields, confusion_shares, error_directions, model_comparison, topic_accuracy, log_losses, statement_rollup, parse_rates, prompts, target_records, purest_records, uncertain_by_stratum, ranges_read]
QUERIES = {f.__name__: f for f in NAMES}

_LAB = lambda c: f"coalesce(nullif(lower(trim({c})), ''), 'na')"
_T = f"""tr AS (SELECT id, max(sen) AS sen, max(ris) AS ris, max(wid) AS wid, max(top) AS top FROM annotations WHERE sen <> '' AND id IS NOT NULL GROUP BY 1),
tn AS (SELECT id, CAST('0x' || left(id, 2) AS INT) AS k, {_LAB('sen')} AS sen_t, {_LAB('ris')} AS ris_t, {_LAB('wid')} AS wid_t, CASE WHEN len(top) > 0 THEN list_transform(top, lambda z: {_LAB('z')}) ELSE ['na'] END AS top_t FROM tr),
pr AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'neutral' ELSE sen_t END AS sen_p, CASE WHEN k % 5 = 0 THEN 'na' ELSE ris_t END AS ris_p, CASE WHEN k % 7 = 0 THEN 'none' ELSE wid_t END AS wid_p, CASE WHEN k % 4 = 0 THEN ['macro'] ELSE top_t END AS top_p FROM tn WHERE k % 11 <> 0)"""


def _single(f: str) -> str:
    return f"""l_{f} AS (SELECT l, count(*) FILTER ({f}_t = l AND {f}_p = l) AS tp, count(*) FILTER ({f}_t <> l AND {f}_p = l) AS fp, count(*) FILTER ({f}_t = l AND {f}_p <> l) AS fn FROM pr, (SELECT DISTINCT {f}_t AS l FROM pr UNION SELECT DISTINCT {f}_p FROM pr) GROUP BY 1),
m_{f} AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM l_{f}),
s_{f} AS (SELECT CAST(sum(tp + fn) AS BIGINT) AS n, sum(tp) / sum(tp + fn) AS accuracy, avg(p) AS precision, avg(r) AS recall, avg(f) AS f1, sum(f * (tp + fn)) / sum(tp + fn) AS f1_weighted FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m_{f}))"""


_R = lambda c, n="": f"round({c} + 1e-9, 6) AS {n or c}"
_FIELDS = ", ".join(_single(f) for f in ("sen", "ris", "wid"))
_MULTI = f"""x AS (SELECT list_distinct(top_t) AS t, list_distinct(top_p) AS p FROM pr), w AS (SELECT count(*) AS n, avg(CASE WHEN list_sort(t) = list_sort(p) THEN 1.0 ELSE 0 END) AS exact, avg(len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p)))) AS jaccard FROM x),
ml AS (SELECT l, count(*) FILTER (list_contains(t, l) AND list_contains(p, l)) AS tp, count(*) FILTER (NOT list_contains(t, l) AND list_contains(p, l)) AS fp, count(*) FILTER (list_contains(t, l) AND NOT list_contains(p, l)) AS fn FROM x, (SELECT DISTINCT unnest(list_concat(t, p)) AS l FROM x) GROUP BY 1),
mm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM ml), mf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM mm)"""
_PROBS = f"{_T}, sc AS (SELECT * FROM pr WHERE sen_t IN ({', '.join(map(repr, SCALE))}) AND sen_p IN ({', '.join(map(repr, SCALE))})), ex AS (SELECT *, CASE sen_p {' '.join(f'WHEN {k!r} THEN {0.5 * v}' for k, v in r.SCALE.items())} END AS score FROM sc)"
ORACLES = {
    "single_label_metrics": f"WITH {_T}, {_FIELDS} " + " UNION ALL ".join(f"SELECT n, {', '.join(_R(c) for c in ('accuracy', 'precision', 'recall', 'f1', 'f1_weighted'))}, '{f}' AS field FROM s_{f}" for f in ("sen", "ris", "wid")),
    "multi_label_metrics": f"WITH {_T}, {_MULTI} SELECT n, {_R('exact')}, {_R('jaccard')}, (SELECT round(avg(p) + 1e-9, 6) FROM mf) AS precision, (SELECT round(avg(r) + 1e-9, 6) FROM mf) AS recall, (SELECT round(avg(f) + 1e-9, 6) FROM mf) AS f1, (SELECT round(coalesce(sum(f), 0) / {len(TOPICS)} + 1e-9, 6) FROM mf WHERE l IN ({', '.join(map(repr, TOPICS))})) AS f1_fixed FROM w",
    "summary_of_fields": f"WITH {_T}, {_FIELDS}, {_MULTI} SELECT round((s_sen.f1 + s_ris.f1 + s_wid.f1 + w.jaccard) / 4 + 1e-9, 6) AS by_jaccard, round((s_sen.f1 + s_ris.f1 + s_wid.f1 + (SELECT avg(f) FROM mf)) / 4 + 1e-9, 6) AS by_f1 FROM s_sen, s_ris, s_wid, w",
    "confusion_shares": f"WITH {_T}, c AS (SELECT a.l AS truth, b.l AS predicted, (SELECT count(*) FROM pr WHERE sen_t = a.l AND sen_p = b.l) AS n FROM (SELECT unnest([{', '.join(map(repr, SCALE))}]) AS l) a, (SELECT unnest([{', '.join(map(repr, SCALE))}]) AS l) b) SELECT truth, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0) + 1e-9, 6) AS share FROM c",
    "error_directions": f"WITH {_T}, z AS (SELECT CASE sen_t {' '.join(f'WHEN {k!r} THEN {v}' for k, v in {**r.SCALE, **r.SCALE_ALIASES}.items())} ELSE 0 END AS t, CASE sen_p {' '.join(f'WHEN {k!r} THEN {v}' for k, v in {**r.SCALE, **r.SCALE_ALIASES}.items())} ELSE 0 END AS p FROM pr) SELECT CASE WHEN p > t THEN 'above' WHEN p < t THEN 'below' ELSE 'right' END AS direction, count(*) AS n FROM z GROUP BY 1",
    "model_comparison": f"WITH {_T}, z AS (SELECT sen_p = sen_t AS a, sen_t = 'neutral' AS b FROM pr) SELECT count(*) FILTER (a AND b) AS both_right, count(*) FILTER (NOT a AND NOT b) AS both_wrong, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only, count(*) FILTER (a AND NOT b) - count(*) FILTER (NOT a AND b) AS advantage FROM z",
    "topic_accuracy": f"WITH {_T}, z AS (SELECT unnest(top_t) AS topic, sen_t = sen_p AS ok FROM pr) SELECT topic, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END) + 1e-9, 6) AS accuracy FROM z GROUP BY 1",
    "log_losses": f"WITH {_PROBS} SELECT count(*) AS n, round(avg(-ln(CASE WHEN sen_t = sen_p THEN 0.6 ELSE 0.1 END)) + 1e-9, 6) AS log_loss FROM ex",
    "statement_rollup": f"WITH {_PROBS} SELECT left(id, 1) AS g, round(avg(score) + 1e-9, 6) AS sentiment_score, round(-(0.6 * ln(0.6) + 0.4 * ln(0.1)) + 1e-9, 6) AS sentiment_entropy, round(stddev_pop(score) + 1e-9, 6) AS dispersion, CAST(0 AS DOUBLE) AS risk_balance, CAST(0 AS DOUBLE) AS uncertainty_width, round(median(score) + 1e-9, 6) AS median_score, round(0.6 + 1e-9, 6) AS mean_confidence, round(avg(CASE WHEN sen_p = 'neutral' THEN 1.0 ELSE 0 END) + 1e-9, 6) AS share_neutral FROM ex GROUP BY 1",
    "parse_rates": f"WITH {_T} SELECT count(*) AS n, count(*) FILTER (k % 5 = 0) AS failed, round(avg(CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0 END) + 1e-9, 6) AS rate, count(*) FILTER (k % 5 <> 0) AS n_right FROM tn",
    "prompts": """WITH f AS (SELECT id, sentence, context_question AS c, 'Label this.' || chr(10) || 'Sentence: "' || sentence || '"' AS p FROM annotations WHERE sentence IS NOT NULL), g AS (SELECT id, CASE WHEN coalesce(c, '') <> '' THEN replace(p, 'Sentence: "' || sentence || '"', chr(10) || 'Context (question being answered): "' || c || '"' || chr(10) || 'Sentence: "' || sentence || '"') ELSE p END AS p FROM f) SELECT id, CAST(length(p) AS BIGINT) AS n_chars, md5(p) AS prompt FROM g""",
    "target_records": "SELECT id, sen AS sentiment, CASE WHEN hor THEN 'true' WHEN NOT hor THEN 'false' END AS horizon, top[1] AS first_topic FROM annotations",
    "purest_records": f"SELECT ris, CAST({' + '.join(f'(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ({str(e.TRIVIAL)[1:-1]}) THEN 1 ELSE 0 END)' for c in ('ten', 'sen', chr(40) + 'CASE WHEN hor THEN ' + repr('True') + ' WHEN NOT hor THEN ' + repr('False') + ' END' + chr(41), 'com', 'ris', 'wid'))} + coalesce(len(list_filter(top, lambda z: z NOT IN ({str(e.TRIVIAL)[1:-1]}))), 0) + greatest(coalesce(len(top), 0) - 1, 0) AS BIGINT) AS purity, count(*) AS n FROM annotations WHERE sen <> '' GROUP BY 1, 2",
    "uncertain_by_stratum": f"WITH {_PROBS}, p AS (SELECT id, (CAST('0x' || left(id, 6) AS INT) + 1) / 33554434 AS p, list_contains(top_t, 'financial_conditions') AS crisis FROM ex WHERE id NOT IN (SELECT id FROM annotations WHERE split_name = 'test' AND id IS NOT NULL)), u AS (SELECT id, crisis, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 9) AS u FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY crisis ORDER BY u DESC, id) AS o FROM u) SELECT id, crisis FROM n WHERE crisis AND o <= 10 OR NOT crisis AND o <= 40 - (SELECT count(*) FROM n WHERE crisis AND o <= 10)",
    "ranges_read": "SELECT p_partkey, CAST(p_size + 1.5 AS DOUBLE) AS middle FROM part",
}
