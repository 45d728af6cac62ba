"""Scorers by name, and the general form of the proximity scorer with topics and modifiers of one's own."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions.gardner import with_gardner, with_sharpe


def proximity_score(topics: Mapping[str, int], modifiers: Mapping[str, int]):
    """UDF of a sentence: sum over topic phrases (longest first) of the topic's sign times its closest modifier's.

    Distance is in words; equally close modifiers of opposite signs count 0; a modifier inside a topic phrase is passed
    over. Null and empty texts score 0. Words are numbered once for a sentence.
    """
    phrases = sorted(topics, key=lambda k: (-len(k), k))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        topic = re.compile(r"\b(?:" + "|".join(map(re.escape, phrases)) + r")\b")
        modifier = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, modifiers), key=len, reverse=True)) + r")\b")

        def one(text: str | None) -> float:
            spans = list(topic.finditer(t)) if (t := (text or "").lower()) else []
            if not spans:
                return 0.0
            begins, ends = [s.start() for s in spans], [s.end() for s in spans]
            words = [m.start() for m in re.finditer(r"\S+", t)]
            mods = []
            for m in modifier.finditer(t):
                i = bisect_left(begins, m.start() + 1) - 1
                if i < 0 or m.start() >= ends[i]:
                    mods.append((bisect_left(words, m.start()), modifiers[m.group()]))
            total = 0
            for s in spans:
                at = bisect_left(words, s.start())
                least = min((abs(w - at) for w, _ in mods), default=0)
                signs = {x for w, x in mods if abs(w - at) == least}
                total += topics[s.group()] * signs.pop() if len(signs) == 1 else 0
            return float(total)

        for b in batches:
            yield b.map(one)

    return score


#: Functions of (frame, text column) that add score columns, and the columns they add.
REGISTRY: dict[str, tuple[Callable[[DataFrame, str], DataFrame], tuple[str, ...]]] = {
    "gardner": (with_gardner, ("gardner_inf", "gardner_labor", "gardner_out", "gardner_fin", "gardner_mp", "gardner_total")),
    "sharpe": (with_sharpe, ("sharpe_positive", "sharpe_negative", "sharpe_net")),
}


def scored(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the score columns of a registered scorer; an unknown name is refused."""
    if name not in REGISTRY:
        raise ValueError(f"no such scorer: {name}")
    run, columns = REGISTRY[name]
    return run(df, text).select(*df.columns, *columns)
