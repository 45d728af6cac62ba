"""Queries of text functions: counts, normal forms, tone, novelty, terms and hinges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import gardner as g
from chronotext.functions import scorers as s
from chronotext.functions import text as x
from chronotext.functions import fixed_values as v
from chronotext.operators.temporal import lag_by_span
from chronotext.plans.scoring_queries import _COUNT, _TOK, has
from chronotext.session import table


def _a(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with a vertical tab as a tab, as in the SQL."""
    return table(spark, d, "annotations").select("id", "board", "doc_type", F.translate("sentence", "\x0b", "\t").alias("sentence"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.translate("text", "\x0b", "\t")
    return table(spark, d, "documents").select("doc_id", x.word_count(t).cast("bigint").alias("n_words"), F.length("text").cast("bigint").alias("n_chars"))


def net_tone(spark: SparkSession, d: str) -> DataFrame:
    scored = s.scored(_a(spark, d), "sentence", "sharpe")
    return scored.select("id", *[F.col(f"sharpe_{c}").cast("bigint").alias(c) for c in ("positive", "negative", "net")])


def tone_per_document(spark: SparkSession, d: str) -> DataFrame:
    """Net tone and words of the informative sentences of each board and type."""
    a = _a(spark, d).withColumn("low", F.lower("sentence")).filter(~g.uninformative(F.col("low"), lowered=True)).withColumns({"net": g.net_words(F.col("sentence")), "n": F.size(g.bare_tokens(F.col("sentence")))})
    return a.groupBy("board", "doc_type").agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.sum("n").alias("words"))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("id", x.normalized(F.col("sentence")).alias("text"))


def novelty(spark: SparkSession, d: str) -> DataFrame:
    """1 - Jaccard of each record against the one before it on its board, by id; a hot board is cut into spans of ids."""
    a = _a(spark, d).filter("id IS NOT NULL").groupBy("board", "id").agg(F.min("sentence").alias("sentence"))
    b = lag_by_span(a, ["board"], "id", F.substring("id", 1, 2), "sentence", "prev")
    return b.select("id", "board", F.round(x.jaccard_novelty(F.col("sentence"), F.col("prev")), 6).alias("novelty"))


def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document and term frequency of every word of the corpus with its smooth idf; counts are combined before they are exchanged."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    tf = docs.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    df = docs.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.join(tf, "term").join(F.broadcast(n)).select("term", "df", "tf", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def hinges(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that open with However or But, beside what stands before them."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", x.contrast_split(F.translate("text", "\x0b", "\t")).alias("h"))
    return t.select("doc_id", F.size(F.filter("h", lambda z: z["after"] != "")).cast("bigint").alias("n"))


NAMES = [word_counts, net_tone, tone_per_document, normalized_text, novelty, tfidf_terms, hinges]
QUERIES = {f.__name__: f for f in NAMES}
_A = "WITH a AS (SELECT id, board, doc_type, replace(sentence, chr(11), chr(9)) AS sentence FROM annotations)"
_P, _N = _COUNT("sentence", v.POSITIVE), _COUNT("sentence", v.NEGATIVE)
ORACLES = {
    "word_counts": "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(replace(text, chr(11), chr(9)), ''), '\\S+')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
    "net_tone": f"{_A} SELECT id, {_P} AS positive, {_N} AS negative, {_P} - {_N} AS net FROM a",
    "tone_per_document": f"{_A} SELECT board, doc_type, count(*) AS n, CAST(sum({_P} - {_N}) AS BIGINT) AS net, CAST(sum(len({_TOK.format('sentence')})) AS BIGINT) AS words FROM a WHERE NOT ({' OR '.join(has('sentence', r) for r in v.UNINFORMATIVE)}) GROUP BY 1, 2",
    "normalized_text": _A + r" SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(sentence), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM a",
    "novelty": _A + ", b AS (SELECT board, id, min(sentence) AS sentence FROM a WHERE id IS NOT NULL GROUP BY 1, 2), w AS (SELECT id, board, list_distinct(regexp_extract_all(lower(sentence), '[a-z]+')) AS x, list_distinct(regexp_extract_all(lower(lag(sentence) OVER (PARTITION BY board ORDER BY id)), '[a-z]+')) AS y FROM b) SELECT id, board, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS novelty FROM w",
    "tfidf_terms": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents WHERE text IS NOT NULL) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf, round(ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS idf FROM w GROUP BY 1",
    "hinges": r"SELECT doc_id, CAST(len(regexp_extract_all(replace(text, chr(11), chr(9)), '\.\s+(?:However|But)\b')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL",
}
