"""Predictions against true labels: normal forms, joins, metrics of single and multiple labels, summaries, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators.relational import LONG_NAMES

PRIMARY = ["topic", "sentiment", "risk", "width"]
#: Weights of the ordinal fields' labels.
ORDINAL = {"sen": {"strongly_dovish": -2.0, "dovish": -1.0, "neutral": 0.0, "hawkish": 1.0, "strongly_hawkish": 2.0}, "ris": {"skewed_downside": -1.0, "symmetric": 0.0, "skewed_upside": 1.0}, "wid": {"none": 0.0, "contested": 1.0, "elevated": 2.0}}
TRIVIAL = ["na", "none", "False", "no_topic", "0"]


def label(value: Column) -> Column:
    """Trimmed and in lower case; null and blank are na."""
    return F.coalesce(F.nullif(F.lower(F.trim(value.cast("string"))), F.lit("")), F.lit("na"))


def label_list(values: Column) -> Column:
    """The labels of a list, each in normal form; a null or empty list is [na]."""
    return F.when(F.size(values) > 0, F.transform(values, label)).otherwise(F.array(F.lit("na")))


def label_of_text(text: Column) -> Column:
    """A list of labels from a JSON list, a bare word or nothing."""
    return F.when(F.trim(text).startswith("["), label_list(F.from_json(text, "array<string>"))).otherwise(F.array(label(text)))


def joined(predictions: DataFrame, truth: DataFrame, id_: str = "id") -> DataFrame:
    """Pairs by id with the endings _p and _t; predictions without a truth are left out."""
    side = lambda df, s: df.select(id_, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != id_])
    return side(predictions, "p").join(side(truth, "t"), id_)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def by_label(cells: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) from rows (t, p, n) of counts; null t and p are no label."""
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    part = lambda c, tp, fp, fn: F.struct(F.col(c).alias("label"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    zero = F.lit(0)
    rows = cells.select(F.explode(F.array(part("t", hit, zero, F.col("n") - hit), part("p", zero, F.col("n") - hit, zero))).alias("x")).select("x.*").filter("label IS NOT NULL")
    m = rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("support", F.col("tp") + F.col("fn"))
    m = m.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return m.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def single_label(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (n, accuracy, precision, recall, f1, f1_weighted): macro means over the labels of either side. Blank truths are left out."""
    cells = pairs.filter(F.col(truth).isNotNull() & (F.col(truth) != "")).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    n = F.sum("support")
    return by_label(cells).agg(n.alias("n"), _ratio(F.sum("tp"), n).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), _ratio(F.sum(F.col("f1") * F.col("support")), n).alias("f1_weighted"))


def multi_label(pairs: DataFrame, truth: str, predicted: str, labels: Sequence[str] | None = None) -> DataFrame:
    """One row (n, exact, jaccard, precision, recall, f1): f1 is the macro mean over the observed labels, or over `labels`."""
    t, p = F.array_distinct(truth), F.array_distinct(predicted)
    both, either = F.array_intersect(t, p), F.array_union(t, p)
    whole = pairs.agg(F.count("*").alias("n"), F.avg((F.size(both) == F.size(either)).cast("double")).alias("exact"), F.avg(F.when(F.size(either) == 0, 1.0).otherwise(F.size(both) / F.size(either))).alias("jaccard"))
    each = F.transform(either, lambda x: F.struct(F.when(F.array_contains(t, x), x).alias("t"), F.when(F.array_contains(p, x), x).alias("p")))
    cells = pairs.select(F.explode(each).alias("x")).select("x.*").groupBy("t", "p").agg(F.count("*").alias("n"))
    m = by_label(cells)
    if labels is not None:
        named = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        m = named.join(m, "label", "left").fillna(0.0, ["precision", "recall", "f1"])
    return whole.crossJoin(m.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]))


def confusion(pairs: DataFrame, truth: str, predicted: str, order: Sequence[str]) -> DataFrame:
    """(truth, predicted, n, share) of every pair of labels of the order, 0 where there is none; share: of the truth's row."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted")) for a in order for b in order]))
    counts = pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    full = pairs.sparkSession.range(1).select(grid.alias("x")).select("x.*").join(counts, ["truth", "predicted"], "left").fillna(0, ["n"])
    rows = full.groupBy("truth").agg(F.sum("n").alias("__whole"))
    return full.join(rows, "truth").select("truth", "predicted", "n", _ratio(F.col("n"), F.col("__whole")).alias("share"))


def directions(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(direction, n) of predictions above, below and at the truth, for numbers."""
    d = F.col(predicted) - F.col(truth)
    return pairs.groupBy(F.when(d > 0, "above").when(d < 0, "below").when(d == 0, "right").alias("direction")).agg(F.count("*").alias("n"))


def two_models(pairs: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """One row: both right, both wrong, only the first, only the second right, and the first's net advantage."""
    a, b = F.col(first).eqNullSafe(F.col(truth)), F.col(second).eqNullSafe(F.col(truth))
    out = pairs.agg(F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"))
    return out.withColumn("advantage", F.col("first_only") - F.col("second_only"))


def accuracy_by(pairs: DataFrame, topics: str, truth: str, predicted: str) -> DataFrame:
    """(topic, n, accuracy): a pair counts for each of its topics."""
    return pairs.select(F.explode(topics).alias("topic"), F.col(truth).eqNullSafe(F.col(predicted)).alias("ok")).groupBy("topic").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


def log_loss(pairs: DataFrame, probabilities: str, truth: str, least: float = 1e-15) -> DataFrame:
    """One row (n, log_loss): mean of -ln p of the true label; probabilities: map of label to p, a missing label has `least`."""
    p = F.coalesce(F.try_element_at(F.col(probabilities), F.col(truth)), F.lit(0.0))
    return pairs.agg(F.count("*").alias("n"), F.avg(-F.log(F.least(F.greatest(p, F.lit(least)), F.lit(1 - least)))).alias("log_loss"))


def expected_score(probabilities: Column, weights: Mapping[str, float]) -> Column:
    """Sum of p times weight; labels without a weight count nothing."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(w, e["key"]), F.lit(0.0)))


def rollup(sentences: DataFrame, by: Sequence[str], probabilities: str, weights: Mapping[str, float]) -> DataFrame:
    """Per statement: mean entropy and confidence, mean, median and population deviation of the expected scores, share of each label."""
    p = F.map_values(probabilities)
    best = F.array_max(F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    nats = -F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log(x))
    s = sentences.withColumns({"__score": expected_score(F.col(probabilities), weights), "__entropy": nats, "__best": best["k"], "__conf": best["v"]})
    shares = [F.avg((F.col("__best") == k).cast("double")).alias(f"share_{k}") for k in weights]
    return s.groupBy(*by).agg(F.avg("__entropy").alias("mean_entropy"), F.avg("__conf").alias("mean_confidence"), F.avg("__score").alias("mean_score"), F.median("__score").alias("median_score"), F.stddev_pop("__score").alias("std_score"), *shares)


def rule_inputs(sen: DataFrame, ris: DataFrame, wid: DataFrame, by: Sequence[str]) -> DataFrame:
    """The five inputs of a policy rule from the rollups of three fields; what is missing is 0."""
    side = lambda df, names: df.select(*by, *[F.col(a).alias(b) for a, b in names.items()])
    out = side(sen, {"mean_score": "sentiment_score", "mean_entropy": "sentiment_entropy", "std_score": "dispersion"}).join(side(ris, {"mean_score": "risk_balance"}), list(by), "left").join(side(wid, {"mean_score": "uncertainty_width"}), list(by), "left")
    return out.fillna(0.0, ["sentiment_score", "sentiment_entropy", "dispersion", "risk_balance", "uncertainty_width"])


def summary(fields: Mapping[str, float | None], primary: Sequence[str] = tuple(PRIMARY)) -> float:
    """The plain mean of the F1 of the primary fields that have one; 0 without any."""
    known = [fields[f] for f in primary if fields.get(f) is not None]
    return sum(known) / len(known) if known else 0.0


def parse_failures(df: DataFrame, parsed: str) -> DataFrame:
    """One row (n, failed, rate): answers of which nothing was read."""
    empty = F.col(parsed).isNull() | F.trim(F.col(parsed)).isin("", "{}")
    return df.agg(F.count("*").alias("n"), F.count_if(empty).alias("failed"), F.avg(empty.cast("double")).alias("rate"))


def answer_object(response: Column, keys: Sequence[str]) -> Column:
    """The JSON object of a model's answer, as text: the one after ANSWER: if it can be read, else the last one (one object may
    lie within it) that names a known field, else the whole answer if it can be read."""
    known = '"(?:' + "|".join(keys) + r')"\s*:'
    read = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    after = read(F.nullif(F.regexp_extract(response, r"(?s)ANSWER:\s*(\{.*\})", 1), F.lit("")))
    some = F.filter(F.regexp_extract_all(response, F.lit(r"(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"), F.lit(1)), lambda o: o.rlike(known) & F.try_parse_json(o).isNotNull())
    return F.coalesce(after, F.try_element_at(some, F.lit(-1)), F.when(F.trim(response).rlike(r"(?s)^\{.*\}$"), read(response)))


def prompt(template: str, sentence: Column, question: Column) -> Column:
    """The template with the sentence; a question, if there is one, stands before the quoted sentence."""
    filled = F.replace(F.lit(template), F.lit("{sentence}"), sentence)
    quoted = F.concat(F.lit('Sentence: "'), sentence, F.lit('"'))
    asked = F.concat(F.lit('\nContext (question being answered): "'), question, F.lit('"\n'), quoted)
    return F.when(F.coalesce(question, F.lit("")) != "", F.replace(filled, quoted, asked)).otherwise(filled)


def target_json(columns: Mapping[str, str] = LONG_NAMES) -> Column:
    """A label record as JSON with the long field names; nulls are kept."""
    return F.to_json(F.struct(*[F.col(a).alias(b) for a, b in columns.items()]), {"ignoreNullFields": "false"})


def purity(single: Mapping[str, Column], topics: Column) -> Column:
    """How many label fields say something; more topics than one count again. Fewer is purer."""
    says = lambda c: (c.isNotNull() & ~c.isin(*TRIVIAL)).cast("int")
    n = sum((says(F.initcap(c.cast("string")) if f == "hor" else c.cast("string")) for f, c in single.items()), F.lit(0))
    tops = F.coalesce(F.size(F.filter(topics, lambda x: ~x.isin(*TRIVIAL))), F.lit(0))
    return n + tops + F.greatest(F.coalesce(F.size(topics), F.lit(0)) - 1, F.lit(0))
