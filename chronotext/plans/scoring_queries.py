"""Queries of the published scorers and of the labels by rule, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import fixed_values as v
from chronotext.functions import gardner as g
from chronotext.functions import rule_labels as rl
from chronotext.functions import text as x
from chronotext.session import table


def gardner_documents(spark: SparkSession, d: str) -> DataFrame:
    """Six sub-indices of every document."""
    out = g.with_gardner(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "n_sentences", "n_words", *[F.round(F.col(f"gardner_{c}") + 1e-9, 6).alias(f"gardner_{c}") for c in (*g.CATEGORIES, "mp", "total")])


def gardner_rules(spark: SparkSession, d: str) -> DataFrame:
    """What rules alone give: informative sentences, their words, the policy score and the long phrases of each category."""
    low = table(spark, d, "documents").select("doc_id", F.transform(g.light_sentences(F.col("text")), F.lower).alias("low"))
    kept = low.select("doc_id", F.filter("low", lambda s: ~g.uninformative(s, lowered=True)).alias("kept")).withColumn("clean", F.transform("kept", g.bare))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, y: a + y).cast("bigint")
    phrases = lambda c: total(F.transform("clean", lambda s: F.coalesce(g.override(s, c), F.lit(0))))
    return kept.select(
        "doc_id", F.size("kept").cast("bigint").alias("n_sentences"), total(F.transform("kept", g.words_in)).alias("n_words"), total(F.transform("kept", lambda s: g.first_rule(s, v.POLICY, lowered=True))).alias("policy"),
        *[phrases(c).alias(f"phrases_{c}") for c in g.CATEGORIES],
    )


def sharpe_documents(spark: SparkSession, d: str) -> DataFrame:
    out = g.with_sharpe(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", *[F.col(f"sharpe_{c}").cast("bigint").alias(f"sharpe_{c}") for c in ("positive", "negative", "net")])


def sentence_spread(spark: SparkSession, d: str) -> DataFrame:
    """Sum and deviation, over the sentences of a document, of the net count of listed words."""
    got = table(spark, d, "documents").select("doc_id", g.by_sentence(F.filter(x.plain_sentences(F.col("text")), lambda t: t.isNotNull()), g.net_words).alias("x"))
    return got.select("doc_id", F.coalesce(F.col("x.n"), F.lit(0)).cast("bigint").alias("n"), F.round(F.coalesce("x.sum", F.lit(0.0)), 6).alias("total"), F.round(F.coalesce("x.std", F.lit(0.0)) + 1e-9, 5).alias("deviation"))


def normalised_scores(spark: SparkSession, d: str) -> DataFrame:
    """Net word scores by length, then against the documents of the same source and type before it."""
    s = table(spark, d, "documents").select("doc_id", "source", "doc_type", g.words_in(F.col("text")).alias("word_count"), g.net_words(F.col("text")).alias("net"))
    out = g.normalised(s, ["net"], "wordcount_zscore", by=["source", "doc_type"], order=["doc_id"])
    return out.select("doc_id", F.round(F.col("net") + 1e-9, 5).alias("net"))


def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """Topic, tense, stance, horizon, commitment, conditions, risk, width and stratum of every sentence."""
    c = F.col("sentence")
    return table(spark, d, "annotations").select(
        "id", F.array_join(rl.topics(c), ",").alias("top"), rl.tense(c).alias("tense"), rl.stance(c).alias("stance"), rl.horizon(c).alias("horizon"), rl.commitment(c).alias("com"),
        F.array_join(rl.conditions(c), ",").alias("conditions"), rl.risk(c).alias("ris"), rl.width(c).alias("wid"), rl.stratum(c).alias("stratum"),
    )


def rule_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment label of every sentence: the stance or the score of the economy, whichever is stronger."""
    scored = g.with_gardner(table(spark, d, "annotations").select("id", "sentence"), "sentence")
    return scored.select("id", rl.sentiment(F.col("sentence"), F.col("gardner_total")).alias("sen"))


def mandate_tension(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by the signs of their sub-indices of prices and of work."""
    s = g.with_gardner(table(spark, d, "annotations").select("sentence"), "sentence")
    i, w = F.signum("gardner_inf"), F.signum("gardner_labor")
    kind = F.when((i > 0) & (w < 0), "hawk_inf_dove_labor").when((i < 0) & (w > 0), "dove_inf_hawk_labor").when((i > 0) & (w > 0), "both_hawkish").when((i < 0) & (w < 0), "both_dovish").otherwise("ambiguous")
    return s.groupBy(kind.alias("relationship")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (gardner_documents, gardner_rules, sharpe_documents, sentence_spread, normalised_scores, rule_labels, rule_sentiment, mandate_tension)}


def q(s: object) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(map(q, words))


def has(what: str, patterns: str | tuple) -> str:
    some = [patterns] if isinstance(patterns, str) else patterns
    return "(" + " AND ".join(f"coalesce(regexp_matches({what}, {q('(?i)' + p)}), false)" for p in some) + ")"


def cases(what: str, rules: list, default: object) -> str:
    return "(CASE " + " ".join(f"WHEN {has(what, p)} THEN {s}" for p, s in rules) + f" ELSE {default} END)"


#: Documents with a vertical tab as a tab, which the two engines class differently.
_DOCS = "docs AS (SELECT *, replace(text, chr(11), chr(9)) AS t FROM documents)"
_STOPS = rf"regexp_replace(regexp_replace(regexp_replace({{0}}, '\b(U)\.(S)\.', '\1' || chr(1) || '\2' || chr(1), 'gi'), '\b([pa])\.(m)\.', '\1' || chr(1) || '\2' || chr(1), 'gi'), '\b({g.ONE_STOP})\.', '\1' || chr(1), 'gi')"


def light(t: str) -> str:
    """SQL of the array of sentences of a text."""
    marked = rf"regexp_replace({_STOPS.format(t)}, '([.!?])\s+([A-Z])', '\1' || chr(2) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda z: regexp_replace(replace(z, chr(1), '.'), {q(g.EDGES)}, '', 'g')), lambda z: z <> '')"


_SENT = f"{_DOCS}, s AS (SELECT doc_id, unnest({light('t')}) AS s FROM docs), k AS (SELECT *, regexp_replace(replace(lower(s), '-', ' '), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS c FROM s WHERE NOT ({' OR '.join(has('s', r) for r in v.UNINFORMATIVE)}))"
_OVER = ", ".join(f"coalesce(CAST(sum({cases('c', [(p, s) for p, s, c in v.OVERRIDES if c == k], 0)}) AS BIGINT), 0) AS phrases_{k}" if any(c == k for *_, c in v.OVERRIDES) else f"CAST(0 AS BIGINT) AS phrases_{k}" for k in g.CATEGORIES)
_TOK = "list_filter(list_transform(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> '')"
_COUNT = lambda t, words: f"len(list_filter({_TOK.format(t)}, lambda w: w IN ({listed(words)})))"
_NET = lambda t: f"({_COUNT(t, v.POSITIVE)} - {_COUNT(t, v.NEGATIVE)})"
_HAS = lambda p: has("sentence", p)
_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(sentence), {q('|'.join(w))}) THEN {q(k)} END" for k, w in v.TOPIC_KEYWORDS.items()) + "], lambda z: z IS NOT NULL)"
_SIDE = lambda a, b: f"(CASE WHEN {_HAS(a)} THEN 2 WHEN {_HAS(b)} THEN 1 ELSE 0 END)"
_PLACE = lambda p: f"length(regexp_extract(sentence, {q('(?is)^(.*?)' + p)}, 1))"
_DOM = "[" + ", ".join(f"row({' + '.join(f'CAST(contains(lower(coalesce(sentence, {q(str())})), {q(w)}) AS INT)' for w in ws)}, {-i}, {q(k)})" for i, (k, ws) in enumerate(v.TOPIC_KEYWORDS.items())) + "]"
_DIFF = "(" + " - ".join(f"len(regexp_extract_all(lower(coalesce(sentence, '')), {q(p)}))" for p in (v.QUICK_POSITIVE, v.QUICK_NEGATIVE)) + ")"
ORACLES = {
    "gardner_rules": f"WITH {_SENT}, r AS (SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(regexp_extract_all(s, '\\S+'))) AS BIGINT) AS n_words, CAST(sum({cases('s', v.POLICY, 0)}) AS BIGINT) AS policy, {_OVER} FROM k GROUP BY 1) SELECT d.doc_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_sentences", "n_words", "policy", *(f"phrases_{k}" for k in g.CATEGORIES))) + " FROM documents d LEFT JOIN r USING (doc_id)",
    "sharpe_documents": f"WITH {_DOCS} SELECT doc_id, {_COUNT('t', v.POSITIVE)} AS sharpe_positive, {_COUNT('t', v.NEGATIVE)} AS sharpe_negative, {_NET('t')} AS sharpe_net FROM docs",
    "sentence_spread": f"WITH {_DOCS}, p AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda z: length(trim(z)) >= 15) AS s FROM docs WHERE t IS NOT NULL), e AS (SELECT doc_id, {_NET('z')} AS net FROM (SELECT doc_id, unnest(CASE WHEN len(s) > 0 THEN s ELSE [t] END) AS z FROM p)), r AS (SELECT doc_id, count(*) AS n, CAST(sum(net) AS DOUBLE) AS total, coalesce(stddev_samp(net), 0) AS deviation FROM e GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n, round(coalesce(total, 0), 6) AS total, round(coalesce(deviation, 0) + 1e-9, 5) AS deviation FROM documents LEFT JOIN r USING (doc_id)",
    "normalised_scores": f"WITH {_DOCS}, n AS (SELECT doc_id, source, doc_type, CAST({_NET('t')} AS DOUBLE) / nullif(len(regexp_extract_all(coalesce(t, ''), '\\S+')), 0) AS net FROM docs), w AS (SELECT doc_id, net, count(net) OVER p AS c, avg(net) OVER p AS m, stddev_samp(net) OVER p AS sd FROM n WINDOW p AS (PARTITION BY source, doc_type ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, round(CASE WHEN c >= 3 AND sd > 0 THEN (net - m) / sd END + 1e-9, 5) AS net FROM w",
    "rule_labels": f"""SELECT id, CASE WHEN len({_TOPICS}) > 0 THEN array_to_string({_TOPICS}, ',') ELSE 'no_topic' END AS top,
CASE WHEN {_HAS(v.HYPOTHETICAL)} OR {_HAS(v.FORWARD)} THEN 'forward' WHEN {_HAS(v.BACKWARD)} THEN 'backward' WHEN {_HAS(v.PRESENT)} THEN 'present' ELSE 'na' END AS tense,
{cases('sentence', v.POLICY, 0)} + {_SIDE(v.HAWKISH_STRONG, v.HAWKISH)} - {_SIDE(v.DOVISH_STRONG, v.DOVISH)} AS stance,
CASE WHEN {_HAS(v.SHORT_TERM)} AND (NOT {_HAS(v.LONG_TERM)} OR {_PLACE(v.SHORT_TERM)} < {_PLACE(v.LONG_TERM)}) THEN 'near_term' WHEN {_HAS(v.LONG_TERM)} THEN 'long_term' ELSE 'na' END AS horizon,
CASE WHEN NOT coalesce(list_contains({_TOPICS}, 'monetary_policy'), false) THEN 'none' WHEN {_HAS(v.CONDITIONAL)} THEN 'conditional' WHEN {_HAS(v.UNCONDITIONAL)} THEN 'unconditional' ELSE 'none' END AS com,
array_to_string(list_filter([{', '.join(f'CASE WHEN {_HAS(p)} THEN {q(k)} END' for k, p in v.CONDITIONS.items())}], lambda z: z IS NOT NULL), ',') AS conditions,
CASE WHEN {_HAS(v.RISK_SYMMETRIC)} THEN 'symmetric' WHEN {_HAS(v.RISK_DOWN)} AND NOT {_HAS(v.RISK_UP)} THEN 'skewed_downside' WHEN {_HAS(v.RISK_UP)} AND NOT {_HAS(v.RISK_DOWN)} THEN 'skewed_upside' ELSE 'na' END AS ris,
CASE WHEN {_HAS(v.ELEVATED)} THEN 'elevated' WHEN {_HAS(v.CONTESTED)} THEN 'contested' ELSE 'none' END AS wid,
greatest(-2, least(2, {_DIFF})) || '|' || (SELECT CASE WHEN h[1] > 0 THEN h[3] ELSE 'no_topic' END FROM (SELECT unnest({_DOM}) AS h) ORDER BY h[1] DESC, h[2] DESC LIMIT 1) AS stratum FROM annotations""",
}
