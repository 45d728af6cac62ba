"""Queries from documents to annotation units, over whole texts. What texts become is compared by length and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import fixed_values as v
from chronotext.functions import gardner as g
from chronotext.functions import units as u
from chronotext.functions.novelty import MOST_WORDS, STOP, WORD, cosine_novelty
from chronotext.plans.scoring_queries import has, light, q
from chronotext.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vertical tab as a tab, as in the SQL."""
    return table(spark, d, "documents").select("doc_id", F.translate("text", "\x0b", "\t").alias("t"))


def _shape(name: str, c: Column) -> list[Column]:
    return [F.length(c).cast("bigint").alias(f"n_{name}"), F.md5(c).alias(name)]


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned corpora: the general cleaner, and those of statements, pages, speeches and transcripts."""
    ways = {"document": u.clean_document, "statement": u.clean_statement, "page": u.clean_page, "speech": u.clean_speech, "transcript": u.clean_transcript}
    made = _texts(spark, d).withColumns({f"__{k}": f(F.col("t")) for k, f in ways.items()})
    return made.select("doc_id", *[c for k in ways for c in _shape(k, F.col(f"__{k}"))])


def stock_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").select("id", u.is_stock_phrase(F.translate("sentence", "\x0b", "\t")).alias("stock"))


def unit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document: how many, of how many sentences, and the text of all of them."""
    parts = _texts(spark, d).filter("t IS NOT NULL").withColumn("parts", u.paragraphs_of(F.col("t"), g.light_sentences))
    made = parts.select("doc_id", u.chunks(F.col("parts")).alias("own"), u.chunks(F.col("parts"), True).alias("said"))
    count = lambda c: F.size(c).cast("bigint")
    merged = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + x["merges"]), F.lit(0)).cast("bigint")
    return made.select("doc_id", merged("own").alias("n_sentences"), count("own").alias("n_chunks"), count("said").alias("n_conversational"), F.md5(F.array_join(F.transform("own", lambda x: x["text"]), "\n")).alias("chunks"))


def transcript_parts(spark: SparkSession, d: str) -> DataFrame:
    """Speaker turns, prepared remarks and questions with answers of every text, and the cut at the first question phrase."""
    read = _texts(spark, d).filter("t IS NOT NULL").withColumns({"turns": u.turns(F.col("t")), "parts": u.transcript(F.col("t"))})
    remarks, questions = u.remarks_and_questions(F.col("t"))
    return read.select(
        "doc_id", F.size("turns").cast("bigint").alias("n_turns"), F.size(F.filter("turns", lambda x: x["chair"])).cast("bigint").alias("n_chair"), F.size("parts.questions").cast("bigint").alias("n_questions"),
        F.length("parts.prepared").cast("bigint").alias("n_prepared"), F.length(remarks).cast("bigint").alias("n_remarks"), F.length(questions).cast("bigint").alias("n_rest"),
    )


def procedure_filter(spark: SparkSession, d: str) -> DataFrame:
    s = _texts(spark, d).filter("t IS NOT NULL").select("doc_id", g.light_sentences(F.col("t")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.size(u.without_procedure(F.col("s"))).cast("bigint").alias("n_kept"))


def text_novelty(spark: SparkSession, d: str) -> DataFrame:
    """1 - cosine of each document and the one before it of its source and type, over the 500 most frequent words."""
    out = cosine_novelty(table(spark, d, "documents"), "doc_id", "text", ["source", "doc_type"], ["doc_id"])
    return out.select("doc_id", F.round(F.col("novelty") + 1e-9, 6).alias("novelty"))


QUERIES = {f.__name__: f for f in (clean_documents, stock_phrases, unit_chunks, transcript_parts, procedure_filter, text_novelty)}


def _sql(pattern: str) -> str:
    return q(pattern.replace("$1", r"\1").replace("$3", r"\3"))


def _replace(what: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        what = f"regexp_replace({what}, {q(p)}, {_sql(r)}, 'g')"
    return what


def _strip(what: str) -> str:
    return f"regexp_replace({what}, {q(g.EDGES)}, '', 'g')"


_T = "t AS (SELECT doc_id, replace(text, chr(11), chr(9)) AS t FROM documents)"


def _clean_sql() -> str:
    first = "t"
    for a, b in u.MARKS:
        first = f"replace({first}, {q(a)}, {q(b)})"
    steps = {
        "c1": f"regexp_replace({first}, {q(u.BANNER)}, '', 'g')",
        "c2": _replace(f"CASE WHEN contains(c1, '[SECTION]') THEN array_to_string(list_filter(list_transform(string_split(c1, '[SECTION]'), lambda z: {_strip('z')}), lambda z: z <> ''), chr(10) || chr(10)) ELSE c1 END", u.REMOVED),
        "c3": f"CASE WHEN regexp_matches(c2, {q('(?i)' + u.END_MARKERS)}) THEN {_strip('regexp_extract(c2, ' + q('(?is)^(.*?)' + u.END_MARKERS) + ', 1)')} ELSE c2 END",
        "c4": f"regexp_extract(c3, {q('(?is)^(.*?)' + u.TRIGGERS)}, 1)",
        "c5": "regexp_extract(c4, '(?s)^(.*[.?!]\\s+)[A-Z]', 1)",
        "c6": f"CASE WHEN regexp_matches(c3, {q('(?i)' + u.TRIGGERS)}) THEN substr(c3, CASE WHEN length(c5) > 0 THEN length(c5) ELSE length(c4) END + 1) ELSE c3 END",
    }
    out, before = "", "t"
    for k, e in steps.items():
        out += f", {k} AS (SELECT *, {e} AS {k} FROM {before})"
        before = k
    document = _strip(_replace("c6", [("[ \t ]+", " "), (r"\n\s*\n", "\n\n")]))
    statement = f"regexp_replace({_strip(_replace('t', [(u.VOTING, '$1'), (r'(?i)For\s+immediate\s+release\.?', ''), (u.DATES, ''), (r'\s+', ' ')]))}, '^[\\s\\-—]+|[\\s\\-—]+$', '', 'g')"
    page = _strip(_replace(f"regexp_replace(regexp_replace(t, '^SOURCE:.*\\n', ''), '^DATE:.*\\n', '')", [*[(f"(?i){p}", "") for p in u.CHROME], (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")]))
    speech = _strip(_replace("t", [(r"\n\s*\d+\s*\n", "\n"), (r"\s+", " ")]))
    transcript = _strip(_replace("t", [(r"\n\s*\d+\s+of\s+\d+\s*\n", "\n"), (r"\n\s*\d+\s*\n", "\n"), *[(f"(?i){p}", "") for p in u.RUNNING_HEADS], (r"\s+", " ")]))
    ways = {"document": document, "statement": statement, "page": page, "speech": speech, "transcript": transcript}
    made = ", ".join(f"{e} AS m_{k}" for k, e in ways.items())
    return f"WITH {_T}{out}, made AS (SELECT doc_id, {made} FROM c6) SELECT doc_id, " + ", ".join(f"CAST(length(m_{k}) AS BIGINT) AS n_{k}, md5(m_{k}) AS {k}" for k in ways) + " FROM made"


def _stock(s: str) -> str:
    words, numbers = f"len(regexp_extract_all({s}, '\\S+'))", f"len(regexp_extract_all({s}, {q(u.NUMBER)}))"
    capitals = f"length(regexp_replace({s}, '[^\\p{{Lu}}]', '', 'g'))"
    either = "|".join(f"(?:{p})" for p in v.STOCK_PHRASES)
    return f"(regexp_matches({_strip(f'lower({s})')}, {q('(?i)' + either)}) OR (length({s}) BETWEEN 1 AND 99 AND {capitals} / greatest(length({s}), 1) > 0.4) OR ({words} > 0 AND {numbers} / greatest({words}, 1) > 0.4))"


def _depends(s: str, conversational: bool) -> str:
    opening = "^(?:" + "|".join(v.DEPENDENT + (v.CONVERSATIONAL if conversational else [])) + ")"
    return f"(regexp_matches(lower({s}), {q(opening)}) OR (regexp_matches(lower({s}), {q(v.DEMONSTRATIVE)}) AND NOT regexp_matches(regexp_extract(lower({s}), {q('(?s)^(.*?)' + v.DEMONSTRATIVE)}, 1), {q(v.CONJUNCTIONS)})))"


def _fold(name: str, conversational: bool) -> str:
    dep, most = ("dc", "") if conversational else ("dep", f" AND f.merges < {u.MOST_SENTENCES}")
    join = f"(s.{dep} AND length(f.text) + 1 + length(s.s) <= {u.MOST_CHARACTERS}{most})"
    return f"""{name} AS (SELECT doc_id, p, i, 1 AS chunk, s AS text, 1 AS merges FROM s WHERE i = 1
 UNION ALL SELECT s.doc_id, s.p, s.i, CASE WHEN {join} THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN {join} THEN f.text || ' ' || s.s ELSE s.s END, CASE WHEN {join} THEN f.merges + 1 ELSE 1 END
 FROM {name} f JOIN s ON s.doc_id = f.doc_id AND s.p = f.p AND s.i = f.i + 1)"""


_PARTS = f"string_split(t, chr(10) || chr(10))"
_CHUNKS = f"""WITH RECURSIVE {_T}, pp AS (SELECT doc_id, unnest(list_filter(list_transform({_PARTS}, lambda z: {_strip('z')}), lambda z: z <> '')) AS para, generate_subscripts(list_filter(list_transform({_PARTS}, lambda z: {_strip('z')}), lambda z: z <> ''), 1) AS p FROM t WHERE t IS NOT NULL),
ss AS (SELECT doc_id, p, unnest({light('para')}) AS s, generate_subscripts({light('para')}, 1) AS o FROM pp),
s AS (SELECT doc_id, p, s, row_number() OVER (PARTITION BY doc_id, p ORDER BY o) AS i, {_depends('s', False)} AS dep, {_depends('s', True)} AS dc FROM ss WHERE NOT {_stock('s')}),
{_fold('f1', False)}, {_fold('f2', True)},
g1 AS (SELECT doc_id, p, chunk, arg_max(text, i) AS text, max(merges) AS merges FROM f1 GROUP BY 1, 2, 3),
r1 AS (SELECT doc_id, CAST(sum(merges) AS BIGINT) AS n_sentences, count(*) AS n_chunks, md5(string_agg(text, chr(10) ORDER BY p, chunk)) AS chunks FROM g1 GROUP BY 1),
r2 AS (SELECT doc_id, count(DISTINCT (p, chunk)) AS n_conversational FROM f2 GROUP BY 1)
SELECT t.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_conversational, 0) AS n_conversational, coalesce(chunks, md5('')) AS chunks FROM t LEFT JOIN r1 USING (doc_id) LEFT JOIN r2 USING (doc_id) WHERE t IS NOT NULL"""
#: Beginnings of words in capitals are marked first, as word borders of letters with accents differ between the engines.
_TAG = r"\x{04}([A-Z]{2,}(?:\s+\x{04}?[A-Z][a-zA-Z\-']*){1,3})\.\s+"
_BEGUN = r"regexp_replace(regexp_replace(t, '\bQUESTION\.\s+', 'JOURNALIST QUESTION. ', 'g'), '(^|[^\p{L}\p{N}\p{M}_])([A-Z]{2,})', '\1' || chr(4) || '\2', 'g')"
_MARKED = rf"string_split(replace(regexp_replace({_BEGUN}, {q(_TAG)}, chr(2) || '\1' || chr(3), 'g'), chr(4), ''), chr(2))"
_CUT = [f"instr(lower(t), {q(p.lower())})" for p in u.QUESTIONS_BEGIN]
_REST = [f"CASE WHEN {a} > 0 THEN length({_strip(q(p) + f' || split_part(substr(lower(t), {a} + {len(p)}), {q(p.lower())}, 1)')})" for a, p in zip(_CUT, u.QUESTIONS_BEGIN)]
ORACLES = {
    "clean_documents": _clean_sql(),
    "stock_phrases": f"SELECT id, {_stock('z')} AS stock FROM (SELECT id, replace(sentence, chr(11), chr(9)) AS z FROM annotations)",
    "unit_chunks": _CHUNKS,
    "transcript_parts": f"""WITH {_T}, m AS (SELECT doc_id, unnest({_MARKED}) AS x, generate_subscripts({_MARKED}, 1) AS i FROM t WHERE t IS NOT NULL),
n AS (SELECT doc_id, i, NOT contains(x, chr(3)) AS first, NOT contains(x, chr(3)) OR regexp_matches(upper(split_part(x, chr(3), 1)), {q(u.OFFICIALS)}) AS chair, {_strip("CASE WHEN contains(x, chr(3)) THEN split_part(x, chr(3), 2) ELSE x END")} AS said FROM m),
o AS (SELECT *, lag(chair) OVER w AS b, lag(said) OVER w AS bs FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT *, chair AND NOT coalesce(b, true) AND bs <> '' AS answers FROM o),
r AS (SELECT doc_id, count(*) AS n_turns, count(*) FILTER (chair) AS n_chair, count(*) FILTER (answers) AS n_questions, string_agg(said, chr(10) || chr(10) ORDER BY i) FILTER (chair AND NOT answers AND NOT (first AND said = '')) AS p FROM z GROUP BY 1)
SELECT doc_id, n_turns, n_chair, n_questions, CAST(coalesce(length(p), 0) AS BIGINT) AS n_prepared, CAST(CASE {' '.join(f'WHEN {a} > 0 THEN length({_strip(f"left(t, {a} - 1)")})' for a in _CUT)} ELSE length({_strip('t')}) END AS BIGINT) AS n_remarks,
CAST(CASE {' '.join(x.replace('CASE WHEN', 'WHEN', 1) for x in _REST)} ELSE 0 END AS BIGINT) AS n_rest FROM r JOIN t USING (doc_id)""",
    "text_novelty": f"""WITH d AS (SELECT doc_id, source, doc_type, list_filter(regexp_extract_all(lower(text), {q(WORD.replace("(", "").replace(")", ""))}), lambda w: w NOT IN ({", ".join(map(q, STOP))})) AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2),
t AS (SELECT w, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1 ORDER BY sum(n) DESC, w LIMIT {MOST_WORDS}),
v AS (SELECT doc_id, w, n * idf AS x FROM c JOIN t USING (w)), m AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1),
p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, doc_type ORDER BY doc_id) AS b FROM d),
s AS (SELECT p.doc_id, sum(v.x * y.x) AS dot FROM p JOIN v ON v.doc_id = p.doc_id JOIN v y ON y.doc_id = p.b AND y.w = v.w GROUP BY 1)
SELECT p.doc_id, round(CASE WHEN a.norm > 0 AND z.norm > 0 THEN 1 - coalesce(dot, 0) / (a.norm * z.norm) END + 1e-9, 6) AS novelty FROM p LEFT JOIN s USING (doc_id) LEFT JOIN m a ON a.doc_id = p.doc_id LEFT JOIN m z ON z.doc_id = p.b""",
    "procedure_filter": f"WITH {_T}, s AS (SELECT doc_id, {light('t')} AS s FROM t WHERE t IS NOT NULL) SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(len(list_filter(s, lambda z: NOT {has('z', '|'.join(u.PROCEDURE))})) AS BIGINT) AS n_kept FROM s",
}
