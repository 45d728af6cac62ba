"""Documents to annotation units: cleaners by kind of source, stock phrases, chunks of dependent sentences, transcripts.

All are expressions over one row: arrays and folds, no explode and no UDF. Null texts stay null, or have no units.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotext.functions import fixed_values as v
from chronotext.functions.gardner import stripped

MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Fixed values: (pattern, what stands for it), applied in turn to a document; marks that are curly, long or mis-decoded.
MARKS = [("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("—", " -- "), ("–", "-"), ("â€™", "'"), ("â€", "-")]
BANNER = r"(?is)An official website of the United States Government.*?Resources for Consumers\s*"
REMOVED = [
    (rf"(?is)For release on delivery\s+.*?{MONTH}\s+\d{{1,2}},\s+\d{{4}}.*?{MONTH}\s+\d{{1,2}},\s+\d{{4}}\s+", ""),
    (r"(?is)At the conclusion of the discussion.*?(Voting for this action)", "$1"),
    (r"https?://\S+", ""),
    (r"www\.\S+", ""),
    (r"([a-zA-Z])\.(\d+)\s", "$1. "),
    (r"([a-zA-Z]),(\d+)\s", "$1, "),
    (r"([a-zA-Z])\.(\d+)([A-Z])", "$1. $3"),
    (r"(?s)(\.)\s+\d{1,2}\s+(?:See\s+)?[A-Z][a-z].{10,400}?(?:www\.\S+|\.htm[l]?|\.pdf)\.", "$1 "),
    (r"\s+\d+\s+[A-Z][^.]+(?:CBO|Congress|Budget|available at|www\.|p\.\s*\d+)[^.]*\.", ""),
    (r"(?m)^\d+\s+", ""),
    (r"(Figure|Table|Chart|Exhibit)\s+[A-Z0-9\-]+[:\.]?", ""),
    (r"See\s+[A-Z][a-z]+.*?\(\d{4}\).*?\.", ""),
    (r"\bShare\b\s+", ""),
]
END_MARKERS = r"(?:Notation Vote|Following the FOMC policy vote)"
TRIGGERS = r"\b(?:review|developments|participants|staff|outlook|guidance)\b"
#: What is cut from statements, and from the pages of speeches and transcripts.
VOTING = r"(?is)Voting\s+for\s+(?:this|the)\s+(?:action|FOMC).*?(\n\n|\z)"
DATES = rf"{MONTH}\s+\d{{1,2}}(?:[-–]\d{{1,2}})?,?\s*\d{{4}}"
PROCEDURE = [r"^the\s+federal\s+open\s+market\s+committee\s+decided", r"^the\s+committee\s+directs\s+the\s+desk", r"^this\s+action\s+is\s+expected\s+to", r"^the\s+vote\s+encompassed"]
CHROME = [
    r"Federal Reserve issues FOMC statement", r"For release at \d+:\d+ [ap]\.m\. [A-Z]+", r"For immediate release", r"Last Update:.*", r"Board of Governors of the Federal Reserve System",
    r"20th Street and Constitution Avenue.*", r"Home\s*›.*", r"Share\s*Twitter.*", r"Back to Top", r"Stay Connected.*", r"Subscribe to.*",
]
RUNNING_HEADS = [r"Transcript of Chair .* Press Conference", r"FEDERAL RESERVE BOARD", r"RESERVE BOARD OF GOVERNORS"]
QUESTIONS_BEGIN = ["QUESTIONS AND ANSWERS", "thank you. we'll now take questions", "i'm happy to take your questions"]
OFFICIALS = "POWELL|BERNANKE|YELLEN|WARSH|CHAIR|CHAIRMAN"
MOST_SENTENCES, MOST_CHARACTERS = 3, 1000
#: Letters that are no word but part of a number, before a unit: words, capitals, numbers of a sentence.
NUMBER = r"\b\d+(?:\.\d+)?\b"


def _all(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def clean_document(text: Column) -> Column:
    """Marks made plain; banners, release heads, links, footnotes and table names removed; sections as paragraphs; cut at the
    first end marker and before the sentence of the first word of substance; blanks collapsed, paragraphs kept."""
    t = reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), MARKS, text)
    t = F.regexp_replace(t, BANNER, "")
    sections = F.filter(F.transform(F.split(t, r"\[SECTION\]"), stripped), lambda s: s != "")
    t = _all(F.when(F.contains(t, F.lit("[SECTION]")), F.array_join(sections, "\n\n")).otherwise(t), REMOVED)
    ends = F.regexp_extract(t, f"(?is)^(.*?){END_MARKERS}", 1)
    t = F.when(t.rlike(f"(?i){END_MARKERS}"), stripped(ends)).otherwise(t)
    before = F.regexp_extract(t, f"(?is)^(.*?){TRIGGERS}", 1)
    head = F.regexp_extract(before, r"(?s)^(.*[.?!]\s+)[A-Z]", 1)
    cut = F.when(F.length(head) > 0, F.length(head)).otherwise(F.length(before))
    t = F.when(t.rlike(f"(?i){TRIGGERS}"), F.substring(t, cut + 1, F.length(t))).otherwise(t)
    return stripped(_all(t, [(r"[ \t ]+", " "), (r"\n\s*\n", "\n\n")]))


def clean_statement(text: Column) -> Column:
    """Voting records, release heads and dates removed, blanks collapsed, dashes at either end dropped."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, VOTING, "$1"), r"(?i)For\s+immediate\s+release\.?", ""), DATES, "")
    return F.regexp_replace(stripped(F.regexp_replace(t, r"\s+", " ")), r"^[\s\-—]+|[\s\-—]+$", "")


def clean_page(text: Column) -> Column:
    """A scraped page without its heads, feet and menus."""
    t = F.regexp_replace(F.regexp_replace(text, r"^SOURCE:.*\n", ""), r"^DATE:.*\n", "")
    t = _all(t, [(f"(?i){p}", "") for p in CHROME])
    return stripped(_all(t, [(r"\n{3,}", "\n\n"), (r"[ \t]+", " ")]))


def clean_speech(text: Column) -> Column:
    return stripped(_all(text, [(r"\n\s*\d+\s*\n", "\n"), (r"\s+", " ")]))


def clean_transcript(text: Column) -> Column:
    t = _all(text, [(r"\n\s*\d+\s+of\s+\d+\s*\n", "\n"), (r"\n\s*\d+\s*\n", "\n"), *[(f"(?i){p}", "") for p in RUNNING_HEADS]])
    return stripped(F.regexp_replace(t, r"\s+", " "))


def without_procedure(sentences: Column) -> Column:
    return F.filter(sentences, lambda s: ~s.rlike("(?i)" + "|".join(PROCEDURE)))


def remarks_and_questions(text: Column) -> tuple[Column, Column]:
    """(remarks, questions): cut at the first of the known phrases that occurs anywhere; questions begin with that phrase."""
    remarks, questions = stripped(text), F.when(text.isNotNull(), F.lit(""))
    for phrase in reversed(QUESTIONS_BEGIN):
        at = F.instr(F.lower(text), phrase.lower())
        rest = F.substring(text, at + len(phrase), F.length(text))
        again = F.instr(F.lower(rest), phrase.lower())
        part = F.when(again > 0, F.substring(rest, F.lit(1), again - 1)).otherwise(rest)
        remarks = F.when(at > 0, stripped(F.substring(text, F.lit(1), at - 1))).otherwise(remarks)
        questions = F.when(at > 0, stripped(F.concat(F.lit(phrase), part))).otherwise(questions)
    return remarks, questions


def is_stock_phrase(sentence: Column) -> Column:
    """A stock phrase, a short text of over 40 % capitals, or one of over 40 % numbers. Empty is none; null is null."""
    size = F.length(sentence)
    capitals = F.length(F.regexp_replace(sentence, r"[^\p{Lu}]", ""))
    words = F.size(F.regexp_extract_all(sentence, F.lit(r"\S+"), F.lit(0)))
    numbers = F.size(F.regexp_extract_all(sentence, F.lit(f"({NUMBER})"), F.lit(1)))
    s = stripped(F.lower(sentence))
    at_start = "(?i)^(?:" + "|".join(p[1:] for p in v.STOCK_PHRASES if p[0] == "^") + ")"  # fails at once where it does not fit
    # whether a run of a class or one of its letters comes before makes no difference to what is found, but to the time
    anywhere = "|".join("(?:" + re.sub(r"^(\[[^\]]*\])\+", r"\1", p) + ")" for p in v.STOCK_PHRASES if p[0] != "^")
    return s.rlike(at_start) | s.rlike(anywhere) | ((size > 0) & (size < 100) & (capitals / F.greatest(size, F.lit(1)) > 0.4)) | ((words > 0) & (numbers / F.greatest(words, F.lit(1)) > 0.4))


def depends(sentence: Column, conversational: bool = False) -> Column:
    """Opens with a known connective, or names something of the sentence before (this progress) that no conjunction precedes."""
    s = F.lower(sentence)
    opening = "^(?:" + "|".join(v.DEPENDENT + (v.CONVERSATIONAL if conversational else [])) + ")"
    before = F.regexp_extract(s, f"(?s)^(.*?){v.DEMONSTRATIVE}", 1)
    return s.rlike(opening) | (s.rlike(v.DEMONSTRATIVE) & ~before.rlike(v.CONJUNCTIONS))


def chunks(paragraphs: Column, conversational: bool = False) -> Column:
    """Array of (text, merges) from an array of arrays of sentences: a sentence that depends on the one before joins its chunk,
    up to MOST_SENTENCES sentences (in conversation any number) and MOST_CHARACTERS characters. Chunks end with their paragraph."""
    kind = "array<struct<text:string,merges:int>>"
    new = lambda s: F.array(F.struct(s.alias("text"), F.lit(1).alias("merges")))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.length(last["text"]) + 1 + F.length(s) <= MOST_CHARACTERS) & depends(s, conversational)
        if not conversational:
            fits = fits & (last["merges"] < MOST_SENTENCES)
        more = F.struct(F.concat(last["text"], F.lit(" "), s).alias("text"), (last["merges"] + 1).alias("merges"))
        return F.when(F.size(acc) == 0, new(s)).when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, new(s))).cast(kind)

    return F.flatten(F.transform(paragraphs, lambda p: F.aggregate(p, F.array().cast(kind), step)))


def paragraphs_of(text: Column, sentences) -> Column:
    """Array of the sentences of each paragraph, stock phrases left out."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")
    return F.transform(parts, lambda p: F.filter(sentences(p), lambda s: ~is_stock_phrase(s)))


def turns(transcript: Column) -> Column:
    """Array of (speaker, chair, said) by tags of two to four words, the first in capitals, and a full stop. What comes before any tag has no speaker."""
    tag = r"\b([A-Z]{2,}(?:\s+[A-Z][a-zA-Z\-']*){1,3})\.\s+"
    t = F.regexp_replace(transcript, r"\bQUESTION\.\s+", "JOURNALIST QUESTION. ")
    marked = F.split(F.regexp_replace(t, tag, "\u0002$1\u0003"), "\u0002")
    return F.transform(
        marked,
        lambda p: F.struct(
            F.when(F.contains(p, F.lit("\u0003")), F.upper(F.split(p, "\u0003")[0])).alias("speaker"),
            (~F.contains(p, F.lit("\u0003")) | F.upper(F.split(p, "\u0003")[0]).rlike(OFFICIALS)).alias("chair"),
            stripped(F.element_at(F.split(p, "\u0003"), -1)).alias("said"),
        ),
    )


def transcript(text: Column) -> Column:
    """struct(prepared, questions): the chair's words before any other speaker and those without a question pending, as one
    text; and an array of (question, answer): the last question before each of the chair's turns."""
    kind = "struct<prepared:array<string>,pairs:array<struct<question:string,answer:string>>,pending:string,asked:boolean>"
    empty = F.struct(F.array().cast("array<string>").alias("prepared"), F.array().cast("array<struct<question:string,answer:string>>").alias("pairs"), F.lit(None).cast("string").alias("pending"), F.lit(False).alias("asked")).cast(kind)

    def step(a: Column, t: Column) -> Column:
        answers = a["asked"] & (F.coalesce(a["pending"], F.lit("")) != "")
        pair = F.concat(a["pairs"], F.array(F.struct(a["pending"].alias("question"), t["said"].alias("answer"))))
        said = F.when(t["speaker"].isNull() & (t["said"] == ""), a["prepared"]).otherwise(F.concat(a["prepared"], F.array(t["said"])))
        none = F.lit(None).cast("string")
        asks = F.struct(a["prepared"].alias("prepared"), a["pairs"].alias("pairs"), t["said"].alias("pending"), F.lit(True).alias("asked"))
        reply = F.struct(a["prepared"].alias("prepared"), pair.alias("pairs"), none.alias("pending"), a["asked"].alias("asked"))
        alone = F.struct(said.alias("prepared"), a["pairs"].alias("pairs"), a["pending"].alias("pending"), a["asked"].alias("asked"))
        return F.when(~t["chair"], asks).when(answers, reply).otherwise(alone).cast(kind)

    return F.aggregate(turns(text), empty, step, lambda a: F.struct(F.array_join(a["prepared"], "\n\n").alias("prepared"), a["pairs"].alias("questions")))


def preceding_sentence(sentences: Column, fragment: Column, size: int = 40) -> Column:
    """The sentence before the one that begins as the fragment does (its first `size` characters); null if it is the first or none does."""
    starts = F.transform(sentences, lambda s: (F.substring(s, 1, size) == F.substring(stripped(fragment), 1, size)) & (F.length(stripped(fragment)) > 0))
    at = F.array_position(starts, F.lit(True))
    return F.when(at > 1, F.get(sentences, (at - 2).cast("int")))


def repaired(sentences: Column, fragment: Column) -> Column:
    """A fragment that depends on the sentence before it, with that sentence in front; else as it is."""
    before = preceding_sentence(sentences, fragment)
    return F.when(before.isNotNull() & depends(fragment, True), F.concat(before, F.lit(" "), stripped(fragment))).otherwise(fragment)
