import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.functions import macro, scorers, text
from chronotext.operators import relational
from chronotext.sources import readers, writers
from chronotext.stats import models, tails
from chronotext.streaming import events


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_sentiment_map(spark):
    df = spark.createDataFrame([("Hawkish ",), ("very dovish",), ("nonsense",), (None,), ("2",)], "v string")
    assert [r[0] for r in df.select(relational.sentiment(F.col("v"))).collect()] == [1.0, -2.0, 0.0, 0.0, 2.0]


def test_topical(spark):
    df = spark.createDataFrame([(["no_topic"],), ([],), (None,), (["no_topic", "inflation"],)], "t array<string>")
    assert [r[0] for r in df.select(relational.topical(F.col("t"))).collect()] == [False, False, False, True]


def test_metrics_sum_to_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    m = {r["label"]: r for r in relational.label_metrics(df, "t", "p").collect()}
    assert m["a"]["tp"] == 1 and m["a"]["fn"] == 1 and m["a"]["fp"] == 1 and m["c"]["f1"] == 0


def test_largest_remainder():
    got = relational.largest_remainder({"a": 70, "b": 29, "c": 1}, 10, 1)
    assert sum(got.values()) == 10 and min(got.values()) == 1
    assert relational.largest_remainder({}, 5) == {}


def test_hashed_split_and_samples(spark):
    df = spark.range(20000).withColumn("s", relational.hashed_split(F.col("id"), [("train", 0.8), ("test", 0.2)]))
    assert abs(df.filter("s = 'train'").count() / 20000 - 0.8) < 0.02
    picked = relational.sample_per_group(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], "id", 5)
    assert picked.groupBy("g").count().filter("count = 5").count() == 3


def test_unknown_strategy():
    with pytest.raises(ValueError):
        relational.uncertainty(None, "other")


def test_sentences_and_chunks(spark):
    t = "Mr. Smith spoke in the U.S. Senate. This was noted. Prices rose. These fell. It ended. They left."
    parts = one(spark, t, text.split_sentences(F.col("v")))
    assert parts[0] == "Mr. Smith spoke in the U.S. Senate." and len(parts) == 6
    chunks = one(spark, t, text.merged_chunks(text.split_sentences(F.col("v"))))
    assert [c["merges"] for c in chunks] == [1, 2, 0]
    assert one(spark, "", F.size(text.merged_chunks(text.split_sentences(F.col("v"))))) == 0


def test_clean_text(spark):
    assert one(spark, "â€œPricesâ€\x9d  rose http://x.y/z [SECTION] now. Voting for this action: A", text.clean_text(F.col("v"))) == '"Prices" rose now.'
    assert one(spark, None, text.clean_text(F.col("v"))) is None


def test_answer_json(spark):
    r = 'thinking {"topic": 1} ANSWER: {"other": 2} {"topic": "x"} done'
    assert json.loads(one(spark, r, text.answer_json(F.col("v"), ["topic"]))) == {"topic": "x"}
    assert one(spark, "nothing", text.answer_json(F.col("v"), ["topic"])) is None


def test_html(spark):
    h = "<script>var a='<p>no</p>'</script><p class='x'>" + "A <b>bold</b> paragraph of text that is long enough.</p>"
    assert one(spark, h, text.html_paragraphs(F.col("v"))) == ["A bold paragraph of text that is long enough."]


def test_question_answers(spark):
    t = "CHAIR ALPHA. Welcome. MS. BETA. Why now? CHAIR ALPHA. Because. MR. GAMMA. And then?"
    turns = text.transcript_turns(spark.createDataFrame([(1, t), (2, None), (3, "no tags")], "id int, v string"), "id", "v")
    got = {r["turn"]: (r["kind"], r["answer"]) for r in text.question_answers(turns, "id").collect()}
    assert sorted(got.values(), key=str) == sorted([("prepared", None), ("question", "Because."), ("turn", None), ("turn", None)], key=str)


def test_contrast(spark):
    assert [tuple(x) for x in one(spark, "Prices rose. However, wages fell.", text.contrast_split(F.col("v")))] == [("Prices rose.", "However, wages fell.")]


def test_proximity(spark):
    score = scorers.proximity_score({"prices": 1, "house prices": -1}, {"rose": 1, "fell": -1})
    df = spark.createDataFrame([("House prices rose while others fell",), ("fell prices rose",), (None,), ("",), ("Prices fell",)], "v string")
    assert [r[0] for r in df.select(score("v")).collect()] == [-1.0, 0.0, 0.0, 0.0, -1.0]


def test_macro(spark):
    df = spark.createDataFrame([("1968Q4",), ("x",)], "v string")
    assert [str(r[0]) for r in df.select(macro.quarter_end(F.col("v"))).collect()] == ["1968-12-31", "None"]
    assert one(spark, ".", macro.observation(F.col("v"))) is None and one(spark, " 1.5", macro.observation(F.col("v"))) == 1.5
    assert one(spark, "1.5-2.5", macro.number_range(F.col("v"))) == 2.0


def test_tails():
    assert abs(tails.t_p(2.0, 10) - 0.073388) < 1e-5
    assert abs(tails.f_sf(3.0, 2, 20) - 0.072498) < 1e-4
    assert abs(tails.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(tails.normal_sf(1.959964) - 0.025) < 1e-6
    assert abs(tails.binomial_sf(8, 10) - 56 / 1024) < 1e-10


def test_ols_and_friends():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] + r.normal(size=200)
    m = models.ols(y, x)
    assert abs(m["beta"][1] - 2) < 0.3 and m["p"][1] < 1e-10
    b, h = np.linalg.lstsq(models.with_constant(x), y, rcond=None)[0], models.with_constant(x)
    assert np.allclose(m["beta"], b)
    leverage = np.diag(h @ np.linalg.inv(h.T @ h) @ h.T)
    inv = np.linalg.inv(h.T @ h)
    want = np.sqrt(np.diag(inv @ (h.T * ((y - h @ b) / (1 - leverage)) ** 2) @ h @ inv))
    assert np.allclose(m["se"], want)
    assert models.nested_f(y, x[:, :1], x)[1] > 0.001 and models.likelihood_ratio(y, x[:, 1:], x)[1] < 1e-10
    assert models.placebo_p(y, x, 0, 50) == 0
    f, load, part = models.pca(x, 1.0)
    assert np.allclose(f @ load, (x - x.mean(0)) / x.std(0)) and abs(part.sum() - 1) < 1e-9
    assert models.adf(np.cumsum(r.normal(size=300)), 4)[0] > -3.5 and models.adf(r.normal(size=300), 4)[0] < -5
    assert models.kpss(r.normal(size=300)) < 0.8
    c = np.digitize(x[:, 0] + r.normal(size=200), [-0.5, 0.5])
    beta, cuts, _ = models.ordered_probit(c, x)
    assert 0.6 < beta[0] < 1.4 and cuts[0] < cuts[1]
    assert math.isfinite(models.oos_rmse(y, x)) and np.isnan(models.rolling_ols(y, x)[:20]).all()
    assert models.clark_west(y, np.zeros(200), m["fitted"])[1] < 0.01
    assert models.directional_accuracy(y, m["fitted"])[0] > 0.7


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "chair").mkdir()
    (tmp_path / "chair" / "a.json").write_text(json.dumps({"date": "20200101", "content": ["x" * 40, "y" * 40]}))
    (tmp_path / "chair" / "b.json").write_text(json.dumps({"date": "20200101", "text": "z" * 60}))
    (tmp_path / "chair" / "c.json").write_text(json.dumps({"date": "20200102", "text": "short"}))
    got = readers.documents(spark, str(tmp_path / "chair")).collect()
    assert [(r["kind"], r["text"][0]) for r in got] == [("chair", "z")]
    assert readers.documents(spark, str(tmp_path / "chair"), one_per_day=False).count() == 2
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "l.json").write_text(json.dumps([{"id": "1", "top": ["a", "b"], "hor": True}, {"id": "2", "top": "a"}, {"id": "3", "top": "['a']", "hor": "no"}, {"id": "4"}]))
    assert [r["top"] for r in readers.label_records(spark, str(tmp_path / "labels")).orderBy("id").collect()] == [["a", "b"], ["a"], ["a"], []]
    (tmp_path / "c.csv").write_text("Unnamed: 0,d,v\n0,2020-01-01,1\n1,bad,2\n")
    assert [str(r["d"]) for r in readers.dated_csv(spark, str(tmp_path / "c.csv"), ["d"]).collect()] == ["2020-01-01", "None"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "2020-02-03.txt").write_text("hello\nworld")
    (tmp_path / "t" / "notes.txt").write_text("undated")
    assert [(str(r["day"]), r["text"]) for r in readers.dated_texts(spark, str(tmp_path / "t")).collect()] == [("2020-02-03", "hello\nworld")]
    assert one(spark, "Jan-68", readers.month_year(F.col("v"), 2030)).year == 1968
    out = str(tmp_path / "out")
    assert writers.append_missing(spark, spark.range(5), out, "id") == 5 and writers.append_missing(spark, spark.range(8), out, "id") == 3
    calls = []
    for _ in range(2):
        assert writers.get_or_compute(spark, str(tmp_path / "cache"), lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1
    writers.swap(spark.read.parquet(out).filter("id < 2"), out)
    assert spark.read.parquet(out).count() == 2


def test_streaming(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:00:01", "a", 1.0), (1, "2024-01-01 00:30:00", "a", 2.0), (2, "2024-01-01 02:00:00", "b", 3.0)], "id int, ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "s"))
    for name, df, want in (("w", events.windowed_counts(stream(), "ts", "k", "v"), 2), ("f", events.first_seen(stream(), "ts", "id"), 2), ("g", events.sessions(stream(), "ts", "k"), 2)):
        q = df.writeStream.outputMode("append" if name == "f" else "complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want
