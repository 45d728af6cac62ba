"""Text to annotation units: cleaning, sentences, chunks, transcripts, JSON answers. Column builders; UDFs only where state is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations whose full stop ends no sentence, and mis-decoded marks with what they stand for; the published units are in `units`.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "U.S", "vs", "Jan", "Feb", "Aug", "Sept", "Oct", "Nov", "Dec"]
MISREAD = {"â€™": "'", "â€˜": "'", "â€œ": '"', "â€\x9d": '"', "â€“": "-", "â€”": "-", "Â": ""}
#: Openings by which a sentence depends on the one before it.
DEPENDENT = ["this", "that", "these", "those", "it", "they", "moreover", "in addition", "furthermore", "as a result", "consequently", "therefore"]


def plain_marks(text: Column) -> Column:
    """Straight quotes and dashes, ordinary blanks; mis-decoded marks repaired."""
    for bad, good in MISREAD.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.translate(text, "‘’“”–— ", "''\"\"-- ")


def clean_text(text: Column, end_markers: Sequence[str] = ("Voting for this action", "Last Update:")) -> Column:
    """Marks, links, bracketed sections and citations removed, cut at the first end marker, blanks collapsed; null stays null."""
    t = plain_marks(text)
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, r"\[(?i:SECTION)\]", " ")
    t = F.regexp_replace(t, r"\[\d+\]|(?<=[a-z.,])\d{1,2}(?=\s)", "")
    for m in end_markers:
        at = F.instr(t, m)
        t = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalized(text: Column) -> Column:
    """Lower case without ASCII punctuation, blanks collapsed: the key of duplicate tests."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def split_sentences(text: Column) -> Column:
    """Sentences of a text; full stops of known abbreviations end none."""
    t = text
    for a in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"\b{a.replace('.', chr(92) + '.')}\.", a.replace(".", "\u0001") + "\u0001")
    parts = F.split(t, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("\u0001"), F.lit(".")))), lambda x: x != "")


def plain_sentences(text: Column, least: int = 15) -> Column:
    """Pieces after sentence marks of at least `least` characters; the whole text if there is none."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) >= least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def is_boilerplate(text: Column, patterns: Sequence[str] = (r"^thank you", r"^good (morning|afternoon)", r"^voting (for|against)", r"^the meeting (was )?adjourned")) -> Column:
    """A stock phrase, mostly capitals in a short text, or mostly figures. Null and blank texts are boilerplate."""
    n = F.greatest(F.length(text), F.lit(1))
    caps, figures = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^0-9]", ""))
    return F.coalesce(F.lower(F.trim(text)).rlike("|".join(patterns)) | ((caps / n > 0.4) & (n < 100)) | (figures / n > 0.4) | (F.trim(text) == ""), F.lit(True))


def merged_chunks(sentences: Column, conversational: bool = False, most_sentences: int = 3, most_chars: int = 1000) -> Column:
    """Array of (text, merges): a dependent sentence joins the chunk before it, within the limits. A fold, no UDF."""
    kind = "array<struct<text:string,merges:int>>"
    opening = "^(" + "|".join(DEPENDENT) + r")\b"

    def step(acc: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.struct(F.lit("").alias("text"), F.lit(0).alias("merges")))
        joined = F.concat(last["text"], F.lit(" "), s)
        fits = F.length(joined) <= most_chars
        if not conversational:
            fits = fits & (last["merges"] + 2 <= most_sentences)
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(joined.alias("text"), (last["merges"] + 1).alias("merges"))))
        apart = F.concat(acc, F.array(F.struct(s.alias("text"), F.lit(0).alias("merges"))))
        return F.when((F.size(acc) > 0) & F.lower(s).rlike(opening) & fits, merged).otherwise(apart).cast(kind)

    return F.aggregate(sentences, F.array().cast(kind), step)


def transcript_turns(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, turn, speaker, role, said): turns by upper-case speaker tags; the chair answers, others ask."""
    marked = F.split(text, r"(?=(?:CHAIR|MR\.|MS\.|GOVERNOR|VICE CHAIR) [A-Z]{3,}\. )")
    turns = docs.filter(F.col(text).isNotNull()).select(id_, F.posexplode(marked).alias("turn", "piece"))
    tag = r"^(CHAIR|MR\.|MS\.|GOVERNOR|VICE CHAIR) ([A-Z]{3,})\. "
    return turns.filter(F.col("piece").rlike(tag)).select(id_, "turn", F.regexp_extract("piece", tag, 2).alias("speaker"), F.when(F.regexp_extract("piece", tag, 1) == "CHAIR", "chair").otherwise("other").alias("role"), F.trim(F.regexp_replace("piece", tag, "")).alias("said"))


def question_answers(turns: DataFrame, id_: str) -> DataFrame:
    """Each turn of another speaker with the chair's turn right after it; chair turns before any question are prepared remarks."""
    w = Window.partitionBy(id_).orderBy("turn")
    t = turns.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("said").over(w), "asked": F.max(F.when(F.col("role") == "other", 1).otherwise(0)).over(w)})
    return t.select(id_, "turn", "speaker", F.when((F.col("role") == "other") & (F.col("next_role") == "chair"), "question").when((F.col("role") == "chair") & (F.col("asked") == 0), "prepared").otherwise("turn").alias("kind"), "said", F.when((F.col("role") == "other") & (F.col("next_role") == "chair"), F.col("answer")).alias("answer"))


def jaccard_novelty(a: Column, b: Column) -> Column:
    """1 - Jaccard of the [a-z]+ words of two texts; null if either has none."""
    wa, wb = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))) for x in (a, b))
    return F.when((F.size(wa) > 0) & (F.size(wb) > 0), 1 - F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))


def html_paragraphs(html: Column, least: int = 40) -> Column:
    """Texts of the <p> elements of at least `least` characters, scripts and styles stripped first."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    parts = F.regexp_extract_all(bare, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " "))), lambda x: F.length(x) >= least)


def statement_text(html: Column, least: int = 200) -> Column:
    """After 'For release', else all paragraphs, else the bare page: the first of more than `least` characters."""
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " "))
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)[^>]*>.*?</\1>", " ")
    ways = [strip(F.regexp_extract(bare, r"(?is)For (?:immediate )?release(.*)$", 1)), F.array_join(html_paragraphs(html, 1), " "), strip(bare)]
    return F.coalesce(*[F.when(F.length(w) > least, w) for w in ways])


def answer_json(response: Column, keys: Sequence[str]) -> Column:
    """The last flat JSON object of a model's response that has a known key, as text; what follows ANSWER: comes first."""
    def last_of(text: Column) -> Column:
        objects = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))
        good = F.filter(objects, lambda o: o.rlike('"(' + "|".join(keys) + r')"\s*:') & F.try_parse_json(o).isNotNull())
        return F.try_element_at(good, F.lit(-1))

    return F.coalesce(last_of(F.regexp_extract(response, r"(?is)ANSWER:(.*)$", 1)), last_of(response))


def contrast_split(text: Column, hinges: Sequence[str] = ("However", "But")) -> Column:
    """Array of (before, after) at every sentence that opens with a hinge word, each up to the next hinge; (text, '') without any."""
    parts = F.split(text, r"(?<=\.)\s+(?=(?:" + "|".join(hinges) + r")\b)")
    pair = lambda i: F.struct(F.get(parts, i).alias("before"), F.get(parts, i + 1).alias("after"))
    alone = F.array(F.struct(text.alias("before"), F.lit("").alias("after")))
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), pair)).when(text.isNotNull(), alone)
