import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.functions import fixed_values as v
from chronotext.functions import gardner as g
from chronotext.functions import rule_labels as rl
from chronotext.functions import units as u
from chronotext.functions.dates import any_year
from chronotext.functions.novelty import cosine_novelty


def slow_proximity(clean):
    """The definition, by plain search over all pairs."""
    shape = {"word": r"\b{}\b", "stem": r"{}\w*", "phrase": "{}"}
    topics = sorted(v.TOPICS, key=lambda t: len(t[0]), reverse=True)
    out = dict.fromkeys(g.CATEGORIES, 0)
    for m in re.finditer("|".join(shape[k].format(re.escape(w)) for w, k, _, _ in topics), clean):
        word = m.group()
        sign, category = next(((s, c) for w, k, s, c in topics if w == word), None) or next((s, c) for w, k, s, c in topics if k == "stem" and word.startswith(w))
        found = []
        for polarity, kinds in v.MODIFIERS[category].items():
            form = {"stems": lambda x: re.escape(x) + r"\w*", "words": lambda x: rf"\b{re.escape(x)}\b", "phrases": re.escape, "special": str}
            for n in re.finditer("|".join(form[k](x) for k, xs in kinds.items() for x in xs), clean):
                if not (n.start() >= m.start() and n.end() <= m.end()):
                    found.append((abs(len(clean[: m.start()].split()) - len(clean[: n.start()].split())), g.POLARITY[polarity]))
        near = {p for d, p in found if d == min(found)[0]}
        out[category] += sign * (near.pop() if len(near) == 1 else 0)
    return out


def test_proximity_against_plain_search():
    r = random.Random(2)
    words = [w for w, *_ in v.TOPICS] + ["economic", "rising", "low", "soft", "software", "picked up", "declined", "steady", "the", "of", "very", "moderate", "strengthening", "tight", "supportive", "weigh on", "and"]
    p = g.Proximity()
    for _ in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))
        assert p.score(text) == slow_proximity(text), text
    assert p.score("") == dict.fromkeys(g.CATEGORIES, 0)


def test_gardner_of_documents(spark):
    rows = [(1, "Inflation rose. Unemployment declined but remains elevated. The Committee will monitor data as needed."), (2, None), (3, ""), (4, "Employment was strong. " * 3000), (5, "Mr. Smith said U.S. output slowed.")]
    got = {r["id"]: r for r in g.with_gardner(spark.createDataFrame(rows, "id int, text string").withColumn("n_words_x", F.lit(1)), "text").collect()}
    assert got[1]["n_sentences"] == 2 and got[1]["n_words"] == 7
    assert got[1]["gardner_inf"] == pytest.approx(1 / 7**0.5) and got[1]["gardner_labor"] == pytest.approx(1 / 7**0.5)
    assert got[2]["gardner_total"] == got[3]["gardner_total"] == 0 and got[4]["n_sentences"] == 3000 and got[5]["n_sentences"] == 1


def test_sharpe_and_spread(spark):
    df = spark.createDataFrame([(1, "Good, good! Bad? Fine."), (2, None), (3, "")], "id int, t string")
    assert [(r["sharpe_positive"], r["sharpe_negative"], r["sharpe_net"]) for r in g.with_sharpe(df, "t").orderBy("id").collect()] == [(2, 1, 1), (0, 0, 0), (0, 0, 0)]
    x = df.select(g.by_sentence(F.array(F.lit("good good"), F.lit("bad"), F.lit("none")), g.net_words).alias("x")).first()["x"]
    assert x["n"] == 3 and x["sum"] == 1 and x["std"] == pytest.approx(np.std([2, -1, 0], ddof=1))
    assert df.select(g.by_sentence(F.array(F.lit("good")), g.net_words).alias("x")).first()["x"]["std"] == 0


def test_normalisations(spark):
    df = spark.createDataFrame([(i, float(i * i), 10 if i != 3 else 0) for i in range(8)], "i int, s double, word_count int")
    with pytest.raises(ValueError):
        g.normalised(df, ["s"], "other")
    by_words = {r["i"]: r["s"] for r in g.normalised(df, ["s"], "wordcount").collect()}
    assert by_words[3] is None and by_words[4] == 1.6
    z = {r["i"]: r["s"] for r in g.normalised(df, ["s"], "zscore", order=["i"]).collect()}
    assert z[2] is None and z[5] == pytest.approx((25 - np.mean([0, 1, 4, 9, 16])) / np.std([0, 1, 4, 9, 16], ddof=1))


def test_labels_of_odd_sentences(spark):
    rows = [(1, "If inflation falls, the Committee will maintain accommodation over the next few quarters."), (2, None), (3, ""), (4, "Risks are roughly balanced over the longer run, although uncertainty is high.")]
    df = spark.createDataFrame(rows, "id int, s string")
    got = {r["id"]: r for r in df.select("id", *[c.alias(k) for k, c in rl.labels(F.col("s"), F.lit(0.0)).items()], rl.stratum(F.col("s")).alias("stratum")).collect()}
    assert got[1]["com"] == "conditional" and got[1]["ten"] == "interpretive" and not got[1]["hor"] and "monetary_policy" in got[1]["top"] and got[1]["sen"] == "dovish"
    assert (got[2]["top"], got[2]["com"], got[2]["ris"], got[2]["wid"], got[2]["stratum"]) == (["no_topic"], "none", "na", "none", "0|no_topic") and got[3]["sen"] == "neutral"
    assert got[4]["ris"] == "symmetric" and got[4]["wid"] == "elevated" and got[4]["hor"]


def test_chunks(spark):
    text = "Prices rose. This progress was broad. Although wages fell, this trend held. Therefore rates moved.\n\nThus ends it. Thank you."
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(u.chunks(u.paragraphs_of(F.col("t"), g.light_sentences)).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert [(x["text"], x["merges"]) for x in got[0]] == [("Prices rose. This progress was broad.", 2), ("Although wages fell, this trend held. Therefore rates moved.", 2), ("Thus ends it.", 1)]
    assert got[1] is None and got[2] == []


def test_transcript(spark):
    t = "Welcome all. CHAIR POWELL. We met. MARY O'NEIL. Will it last? CHAIR POWELL. Yes. CHAIR POWELL. One more thing. QUESTION. And then? CHAIR POWELL. No."
    got = spark.createDataFrame([(t,), (None,)], "t string").select(u.transcript(F.col("t")).alias("x")).collect()
    assert got[0]["x"]["prepared"] == "Welcome all.\n\nWe met.\n\nOne more thing." and [tuple(p) for p in got[0]["x"]["questions"]] == [("Will it last?", "Yes."), ("And then?", "No.")]
    r, q = (spark.createDataFrame([("We met. I'm happy to take your questions. Well?",)], "t string").select(*u.remarks_and_questions(F.col("t"))).first())
    assert r == "We met." and q == "i'm happy to take your questions. Well?"


def test_years(spark):
    values = ["2012-06-20 10:00:00", "20120620", "2012", "June 2012", "unknown", "", None, "page 12"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in values], "s string").select(any_year(F.col("s"))).collect()] == [2012, 2012, 2012, 2012, None, None, None, None]


def test_cosine_novelty(spark):
    df = spark.createDataFrame([(1, "red green blue", "a"), (2, "red green blue", "a"), (3, "black white", "a"), (4, None, "a"), (5, "", "a"), (6, "red", "b")], "id int, t string, g string")
    got = {r["id"]: r["novelty"] for r in cosine_novelty(df, "id", "t", ["g"], ["id"]).collect()}
    assert got[1] is None and got[2] == pytest.approx(0, abs=1e-9) and got[3] == pytest.approx(1) and got[5] is None and got[6] is None and 4 not in got
    assert cosine_novelty(df.limit(0), "id", "t", ["g"], ["id"]).count() == 0


def test_fragments_are_repaired(spark):
    rows = [("This was broad.",), ("Prices rose.",), ("Wages fell.",), (None,), ("",)]
    s = F.array(*map(F.lit, ["Prices rose.", "This was broad.", "Wages fell."]))
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(u.repaired(s, F.col("v"))).collect()]
    assert got == ["Prices rose. This was broad.", "Prices rose.", "Wages fell.", None, ""]
