"""Two published scorers of policy texts and what is built on them: word lists, and topics with their closest modifiers.

A document is scored within its row: sentences are an array, rules are expressions over it, and only the distances of
topics to modifiers (step 4) are an Arrow UDF over the same array. No row is exploded, nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions import fixed_values as v

CATEGORIES = ("inf", "labor", "out", "fin")
POLARITY = {"pos": 1, "neu": 0, "neg": -1}
#: Abbreviations of one full stop that end no sentence (U.S., p.m. and a.m. have two).
ONE_STOP = "Mr|Mrs|Dr|vs|etc|approx|Corp|Ltd|Inc|No"
STOP = "\u0001"
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, EDGES, "")


def light_sentences(text: Column) -> Column:
    """Sentences end at . ! ? before blanks and a capital; the full stops of known abbreviations, in any case, end none. Null has none."""
    t = F.regexp_replace(text, r"(?i)\b(U)\.(S)\.", f"$1{STOP}$2{STOP}")
    t = F.regexp_replace(t, r"(?i)\b([pa])\.(m)\.", f"$1{STOP}$2{STOP}")
    t = F.regexp_replace(t, rf"(?i)\b({ONE_STOP})\.", f"$1{STOP}")
    whole = F.transform(F.split(t, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: stripped(F.replace(x, F.lit(STOP), F.lit("."))))
    return F.coalesce(F.filter(whole, lambda x: x != ""), F.array().cast("array<string>"))


def words_in(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def in_lower_case(pattern: str) -> str:
    """A pattern that finds in lower-cased text what `pattern` finds in any case; matching is faster so."""
    return f"(?i){pattern}" if re.search(r"\\[A-Z]", pattern) else pattern.lower()


def needed_words(pattern: str) -> str:
    """The longest run of letters and blanks that any match of a simple pattern contains; empty if the pattern is not simple."""
    if re.search(r"[|()\[\]{}^$]", pattern):
        return ""
    plain = re.sub(r"\\b", "\x00", pattern)
    plain = re.sub(r"(?:\\[wsd]|\.)[*+?]*", "\x00", re.sub(r"[^\\]\?", "\x00", re.sub(r"\.\*\??", "\x00", plain)))
    return "" if "\\" in plain or re.search(r"[*+]", plain) else max(plain.split("\x00"), key=len).lower()


def every(text: Column, patterns: str | Sequence[str], lowered: bool = False) -> Column:
    """All patterns occur, in any case; false for null. A plain search for words that a match must contain comes first.

    lowered: the text is in lower case already, which saves time where many patterns are looked for.
    """
    low, out = text if lowered else F.lower(text), F.lit(True)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        words = needed_words(p)
        plain, whole = F.contains(low, F.lit(words)), low.rlike(in_lower_case(p))
        out = out & (whole if len(words) < 3 else plain if words == p.lower() else plain & whole)
    return F.coalesce(out, F.lit(False))


def uninformative(sentence: Column, rules: Sequence[Sequence[str]] = tuple(v.UNINFORMATIVE), lowered: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [every(sentence, r, lowered) for r in rules])


def first_rule(text: Column, rules: Sequence[tuple], default: int | None = 0, lowered: bool = False) -> Column:
    """The score of the first rule of which all patterns occur."""
    out = None
    for patterns, score in rules:
        fits = every(text, patterns, lowered)
        out = F.when(fits, score) if out is None else out.when(fits, score)
    return F.lit(default).cast("int") if out is None else out.otherwise(F.lit(default).cast("int"))


def bare(sentence: Column) -> Column:
    """Lower case, hyphens as blanks, other marks dropped."""
    return F.regexp_replace(F.replace(F.lower(sentence), F.lit("-"), F.lit(" ")), r"[^\p{L}\p{N}_\s]", "")


def override(clean: Column, category: str, rules: Sequence[tuple] = tuple(v.OVERRIDES)) -> Column:
    """The score of the category's first phrase that occurs, null if none does."""
    return first_rule(clean, [(p, s) for p, s, c in rules if c == category], None, lowered=True) if any(c == category for *_, c in rules) else F.lit(None).cast("int")


class Proximity:
    """Sums, by category, of each topic's sign times the polarity of its closest modifier, distances in words.

    A modifier within the topic's own span is passed over; modifiers of different polarity at the least distance count 0.
    """

    def __init__(self, topics: Sequence[tuple] = tuple(v.TOPICS), modifiers: dict = v.MODIFIERS) -> None:
        shape = {"word": r"\b{}\b", "stem": r"{}\w*", "phrase": "{}"}
        longest = sorted(topics, key=lambda t: len(t[0]), reverse=True)
        self.topics = [(word, f"({shape[kind].format(re.escape(word))})", sign, category) for word, kind, sign, category in longest]
        form = {"stems": lambda x: re.escape(x) + r"\w*", "words": lambda x: rf"\b{re.escape(x)}\b", "phrases": re.escape, "special": str}
        self.modifiers = {
            category: [(POLARITY[p], [("" if kind == "special" else x, f"(?:{form[kind](x)})") for kind, xs in kinds.items() for x in xs]) for p, kinds in by.items()]
            for category, by in modifiers.items()
        }
        self.compiled: dict[tuple[str, ...], re.Pattern] = {}

    def either(self, patterns: tuple[str, ...]) -> re.Pattern:
        """The patterns as one. Only those whose letters occur are asked for, so a few of all combinations are ever compiled."""
        if patterns not in self.compiled:
            if len(self.compiled) > 20_000:
                self.compiled.clear()
            self.compiled[patterns] = re.compile("|".join(patterns))
        return self.compiled[patterns]

    def score(self, clean: str) -> dict[str, int]:
        out = dict.fromkeys(CATEGORIES, 0)
        here = [t for t in self.topics if t[0] in clean]
        if not here:
            return out
        begins = [m.start() for m in re.finditer(r"\S+", clean)]
        known: dict[str, list[tuple[int, int, int, int]]] = {}
        for topic in self.either(tuple(t[1] for t in here)).finditer(clean):
            _, _, sign, category = here[topic.lastindex - 1]
            if category not in known:
                some = [(p, tuple(r for x, r in rules if x in clean)) for p, rules in self.modifiers[category]]
                known[category] = [(bisect_left(begins, m.start()), m.start(), m.end(), p) for p, rules in some if rules for m in self.either(rules).finditer(clean)]
            at = bisect_left(begins, topic.start())
            outside = [(abs(at - w), p) for w, a, b, p in known[category] if a < topic.start() or b > topic.end()]
            nearest = min(outside, default=(0, 0))[0]
            polarity = {p for d, p in outside if d == nearest}
            out[category] += sign * polarity.pop() if len(polarity) == 1 else 0
        return out


def proximity(clean_sentences: Column) -> Column:
    """Array of struct(inf, labor, out, fin), one for each bare sentence."""

    @F.pandas_udf(f"array<struct<{','.join(f'{c}:int' for c in CATEGORIES)}>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Proximity()
        for b in batches:
            yield b.map(lambda xs: [p.score(x) for x in xs] if xs is not None else [])

    return scored(clean_sentences)


def with_gardner(df: DataFrame, text: str) -> DataFrame:
    """df with n_sentences, n_words of the informative sentences; gardner_<category>, gardner_mp, gardner_total, over the root of n_words.

    Uninformative sentences are dropped first. A category that a long phrase scores in a sentence takes nothing from that
    sentence's topics. Null and empty texts score 0. The steps are columns of their own, so that none is computed twice.
    """
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    in_all = lambda c: total(F.zip_with("__clean", "__near", lambda s, p: F.coalesce(override(s, c), p[c])))
    steps = df.withColumn("__low", F.transform(light_sentences(F.col(text)), F.lower)).withColumn("__kept", F.filter("__low", lambda s: ~uninformative(s, lowered=True)))
    steps = steps.withColumns({"__clean": F.transform("__kept", bare), "n_sentences": F.size("__kept"), "n_words": total(F.transform("__kept", words_in)), "__mp": total(F.transform("__kept", lambda s: first_rule(s, v.POLICY, lowered=True)))})
    steps = steps.withColumn("__near", proximity(F.col("__clean"))).withColumns({f"__{c}": in_all(c) for c in CATEGORIES})
    root, parts = F.sqrt(F.greatest("n_words", F.lit(1))), [*CATEGORIES, "mp"]
    out = {f"gardner_{c}": F.col(f"__{c}") / root for c in parts}
    out["gardner_total"] = reduce(lambda a, b: a + b, (F.col(f"__{c}") for c in parts)) / root
    return steps.select(*df.columns, "n_sentences", "n_words", *[c.alias(k) for k, c in out.items()])


def bare_tokens(text: Column) -> Column:
    """Words with all but a-z dropped, in lower case; empty ones left out."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: F.regexp_replace(x, "[^a-z]", "")), lambda x: x != "")


def with_sharpe(df: DataFrame, text: str, positive: Sequence[str] = tuple(v.POSITIVE), negative: Sequence[str] = tuple(v.NEGATIVE)) -> DataFrame:
    """df with sharpe_positive, sharpe_negative and sharpe_net: how many words are in either list, and the difference."""
    count = lambda words: F.size(F.filter("__tokens", lambda x: x.isin(*words)))
    out = df.withColumn("__tokens", bare_tokens(F.col(text))).withColumns({"sharpe_positive": count(positive), "sharpe_negative": count(negative)})
    return out.withColumn("sharpe_net", F.col("sharpe_positive") - F.col("sharpe_negative")).drop("__tokens")


def net_words(text: Column, positive: Sequence[str] = tuple(v.POSITIVE), negative: Sequence[str] = tuple(v.NEGATIVE)) -> Column:
    """sharpe_net in one pass, for use inside another expression."""
    return F.aggregate(bare_tokens(text), F.lit(0), lambda a, x: a + F.when(x.isin(*positive), 1).when(x.isin(*negative), -1).otherwise(0))


def by_sentence(sentences: Column, score) -> Column:
    """struct(n, sum, std) of score(sentence) over an array of sentences; std is that of the sample, 0 for a single sentence."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    more = lambda a, y: F.struct((a["n"] + 1).alias("n"), (a["s"] + y).alias("s"), (a["q"] + y * y).alias("q"))
    left = lambda a: F.greatest(a["q"] - a["s"] * a["s"] / a["n"], F.lit(0.0))
    end = lambda a: F.struct(a["n"].alias("n"), a["s"].alias("sum"), F.when(a["n"] > 1, F.sqrt(left(a) / (a["n"] - 1))).otherwise(0.0).alias("std"))
    return F.aggregate(F.transform(sentences, lambda s: score(s).cast("double")), zero, more, end)


def normalised(df: DataFrame, scores: Sequence[str], how: str, words: str = "word_count", by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Scores by word count, by an expanding z-score of the rows before (at least 3), by both in this order, or as they are.

    No words and no spread give null. An unknown `how` is refused.
    """
    if how not in ("none", "wordcount", "zscore", "wordcount_zscore"):
        raise ValueError(f"no such normalisation: {how}")
    out = df
    if "wordcount" in how:
        out = out.withColumns({c: F.try_divide(F.col(c).cast("double"), F.nullif(F.col(words), F.lit(0))) for c in scores})
    if "zscore" in how:
        past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        z = lambda c: F.when((F.count(c).over(past) >= 3) & (F.stddev_samp(c).over(past) > 0), (F.col(c) - F.avg(c).over(past)) / F.stddev_samp(c).over(past))
        out = out.withColumns({c: z(c) for c in scores})
    return out
