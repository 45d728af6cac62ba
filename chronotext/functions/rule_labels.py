"""Labels of a sentence by keyword lists and patterns: topic, tense, sentiment, commitment, horizon, conditions, risk, width."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotext.functions import fixed_values as v
from chronotext.functions.gardner import first_rule, in_lower_case

SENTIMENTS = ["very dovish", "dovish", "neutral", "hawkish", "very hawkish"]
NO_TOPIC = "no_topic"


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(text).rlike(in_lower_case(pattern)), F.lit(False))


def place(text: Column, pattern: str) -> Column:
    """Characters before the first match."""
    return F.length(F.regexp_extract(F.lower(text), f"(?s)^(.*?){in_lower_case(pattern)}", 1))


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def topics(text: Column, keywords: Mapping[str, Sequence[str]] = v.TOPIC_KEYWORDS) -> Column:
    """The topics of which a keyword occurs anywhere, also within words; no_topic if there is none."""
    t = _lower(text)
    some = F.filter(F.array(*[F.when(t.rlike("|".join(words)), topic) for topic, words in keywords.items()]), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(NO_TOPIC)))


def dominant(text: Column, keywords: Mapping[str, Sequence[str]] = v.TOPIC_KEYWORDS) -> Column:
    """The topic of which most keywords occur, the first of equals."""
    t = _lower(text)
    count = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    best = F.array_max(F.array(*[F.struct(count(w).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, w) in enumerate(keywords.items())]))
    return F.when(best["n"] > 0, best["k"]).otherwise(NO_TOPIC)


def tense(text: Column) -> Column:
    return F.when(found(text, v.HYPOTHETICAL) | found(text, v.FORWARD), "forward").when(found(text, v.BACKWARD), "backward").when(found(text, v.PRESENT), "present").otherwise("na")


def stance(text: Column) -> Column:
    """The policy rules' score and the strong or else mild words of either side."""
    side = lambda strong, mild: F.when(found(text, strong), 2).when(found(text, mild), 1).otherwise(0)
    return first_rule(text, v.POLICY) + side(v.HAWKISH_STRONG, v.HAWKISH) - side(v.DOVISH_STRONG, v.DOVISH)


def sentiment(text: Column, total: Column) -> Column:
    """The stance or the binned total score of the economy, whichever is stronger (the stance of equals), within -2 and 2.

    total: gardner_total of the sentence (gardner.with_gardner).
    """
    g = total
    binned = F.when(g <= -0.35, -2).when(g <= -0.10, -1).when(g <= 0.10, 0).when(g <= 0.35, 1).otherwise(2)
    mp = stance(text)
    score = F.greatest(F.lit(-2), F.least(F.lit(2), F.when(F.abs(mp) >= F.abs(binned), mp).otherwise(binned)))
    return F.get(F.array(*map(F.lit, SENTIMENTS)), score + 2)


def commitment(text: Column, of: Column | None = None) -> Column:
    """Only of sentences on monetary policy; a condition wins over a commitment."""
    label = F.when(found(text, v.CONDITIONAL), "conditional").when(found(text, v.UNCONDITIONAL), "unconditional").otherwise("none")
    return F.when(F.array_contains(topics(text) if of is None else of, "monetary_policy"), label).otherwise("none")


def horizon(text: Column) -> Column:
    """near_term or long_term; of both, the one that comes first (long_term if they begin together)."""
    near, far = found(text, v.SHORT_TERM), found(text, v.LONG_TERM)
    return F.when(near & (~far | (place(text, v.SHORT_TERM) < place(text, v.LONG_TERM))), "near_term").when(far, "long_term").otherwise("na")


def conditions(text: Column) -> Column:
    return F.filter(F.array(*[F.when(found(text, p), k) for k, p in v.CONDITIONS.items()]), lambda x: x.isNotNull())


def risk(text: Column) -> Column:
    down, up = found(text, v.RISK_DOWN), found(text, v.RISK_UP)
    return F.when(found(text, v.RISK_SYMMETRIC), "symmetric").when(down & ~up, "skewed_downside").when(up & ~down, "skewed_upside").otherwise("na")


def width(text: Column) -> Column:
    return F.when(found(text, v.ELEVATED), "elevated").when(found(text, v.CONTESTED), "contested").otherwise("none")


def labels(text: Column, total: Column) -> dict[str, Column]:
    """All label fields. Null and empty sentences have the defaults."""
    return {
        "top": topics(text), "sen": sentiment(text, total), "ten": F.when(tense(text) == "forward", "interpretive").otherwise("descriptive"),
        "hor": horizon(text) == "long_term", "com": commitment(text), "ris": risk(text), "wid": width(text),
    }


def stratum(text: Column) -> Column:
    """'<balance of quick positive and negative words, within -2 and 2>|<dominant topic>'."""
    t = _lower(text)
    diff = F.regexp_count(t, F.lit(v.QUICK_POSITIVE)) - F.regexp_count(t, F.lit(v.QUICK_NEGATIVE))
    return F.concat_ws("|", F.greatest(F.lit(-2), F.least(F.lit(2), diff)).cast("string"), dominant(text))
