import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronotext.operators import evaluation as e
from chronotext.operators import frames as f
from chronotext.operators import vintages as vt
from chronotext.sources import pages, readers, writers
from chronotext.stats import favar as fv
from chronotext.stats import models as m
from chronotext.streaming import events


def test_metrics_with_odd_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a"), ("", "a")], "t string, p string")
    got = e.single_label(df, "t", "p").first()
    assert got["n"] == 3 and got["accuracy"] == pytest.approx(1 / 3) and got["recall"] == pytest.approx((0.5 + 0) / 2)
    none = e.single_label(df.limit(0), "t", "p").first()
    assert none["n"] is None and none["f1"] is None
    sets = spark.createDataFrame([(["x"], ["x"]), ([], []), (["x", "y"], ["y", "y"])], "t array<string>, p array<string>")
    got = e.multi_label(sets, "t", "p", ["x", "y", "z"]).first()
    assert got["exact"] == pytest.approx(2 / 3) and got["jaccard"] == pytest.approx(2.5 / 3) and got["f1"] == pytest.approx((2 / 3 + 1) / 3)


def test_answers(spark):
    rows = ['{"topic": "a"} then ANSWER: {"topic": "b", "more": {"x": 1}}', 'no {"other": 1} {"topic": "c"} end', '{"topic": broken} ', None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(e.answer_object(F.col("v"), ["topic"])).collect()]
    assert json.loads(got[0])["topic"] == "b" and json.loads(got[1]) == {"topic": "c"} and got[2:] == [None, None, None]
    df = spark.createDataFrame([("one", None), ("two", "why?"), ("three", "")], "s string, q string")
    assert [r[0] for r in df.select(e.prompt('Read. Sentence: "{sentence}"', F.col("s"), F.col("q"))).collect()] == ['Read. Sentence: "one"', 'Read. \nContext (question being answered): "why?"\nSentence: "two"', 'Read. Sentence: "three"']
    assert e.summary({"topic": 0.5, "sentiment": 0.7, "risk": None}) == pytest.approx(0.6) and e.summary({}) == 0


def test_probabilities(spark):
    df = spark.createDataFrame([("d", {"dovish": 0.5, "hawkish": 0.5}, "dovish"), ("d", {"neutral": 1.0}, "neutral"), ("d", {"other": 1.0}, "hawkish")], "d string, p map<string,double>, t string")
    got = e.rollup(df, ["d"], "p", e.ORDINAL["sen"]).first()
    assert got["mean_score"] == 0 and got["mean_entropy"] == pytest.approx(np.log(2) / 3) and got["share_neutral"] == pytest.approx(1 / 3)
    assert e.log_loss(df, "p", "t").first()["log_loss"] == pytest.approx((np.log(2) - np.log(1e-15)) / 3, rel=1e-6)


def test_frames(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (2, None, None), (3, "", 1.0)], "k int, s string, v double")
    assert [r["k"] for r in f.complete_rows(a, ["s", "v"]).collect()] == [1]
    assert {r["k"] for r in f.without_prefixes(a, "s", ["x"], 1).collect()} == {2, 3}
    assert {(r["k"], r["side"]) for r in f.key_differences(a, a.filter("k > 1").union(a.selectExpr("k + 7", "s", "v").limit(1)), "k").collect()} == {(1, "left"), (8, "right")}
    assert f.argmax_row(a, "v").first()["k"] == 1 and f.argmax_row(a.limit(0), "v").count() == 0
    assert {r["direction"]: r["n"] for r in f.cut_counts(a.limit(0), "v").collect()} == {"Down": 0, "Flat": 0, "Up": 0}
    joined = f.join_by_index(a, a.select("k", F.lit("z").alias("s")), "k")
    assert joined.columns == ["k", "s", "v", "s_right"]
    assert f.outer_all([a.select("k", "v"), a.select("k", "s", "v")], "k").columns == ["k", "v", "s"]
    assert f.column_parts("GDP(T+2)") == ("GDP", "T+2") and f.column_parts("GDP") is None
    assert len({r[0] for r in a.select(f.stable_id(F.col("k"), F.col("s"))).collect()}) == 3
    s = f.stratified_seed(spark.range(1000).select(F.col("id"), F.when(F.col("id") < 3, "rare").otherwise("many").alias("g")), "g", "id", 50)
    assert s.filter("g = 'rare'").count() == 2 and s.count() <= 50
    assert [r["converged"] for r in f.settled(spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.48)], "r int, u double"), "r", "u").orderBy("r").collect()] == [False, False, True]


def test_vintages(spark):
    rows = [("s", "2020-01-01", "2020-02-01", 1.0), ("s", "2020-01-01", "2020-03-01", 2.0), ("s", "2020-02-01", "2020-03-01", None), ("t", "2020-01-01", "2020-05-01", 3.0)]
    df = spark.createDataFrame(rows, "series string, p string, v string, x double").withColumns({"p": F.to_date("p"), "v": F.to_date("v")})
    days = spark.createDataFrame([("2020-02-15",), (None,), ("2020-02-15",)], "day string").select(F.to_date("day").alias("day"))
    got = {(r["series"], str(r["v"])): r["n_days"] for r in vt.needed(days, df, "day", ["series"], "v").collect()}
    assert got == {("s", "2020-02-01"): 1, ("s", "2020-03-01"): 1, ("t", "2020-05-01"): 1}
    assert [(r["first"], r["last"], r["revised"]) for r in vt.revisions(df, ["series", "p"], "v", "x").orderBy("series").collect()] == [(1.0, 2.0, True), (3.0, 3.0, False)]
    assert vt.snapshot(df, ["series"], "p", "v", "x", "2020-02-20").collect()[0]["x"] == 1.0


def test_regressions():
    r = np.random.default_rng(3)
    n = 120
    p = pd.DataFrame({"a": r.normal(size=n).cumsum(), "b": r.normal(size=n), "c": r.normal(size=n), "sent_total": r.normal(size=n), "sent_x": r.normal(size=n), "flag": r.integers(0, 3, n)})
    p["y"] = np.r_[0, (p["a"] + 0.5 * p["sent_total"])[:-1]] + r.normal(size=n) * 0.1
    base, more = fv.augmented(p, ["a", "b", "c", "none"], "y", None), fv.augmented(p, ["a", "b", "c"], "y", p[["sent_total"]])
    assert base["n"] == n - 1 and more["adj_r2"] > base["adj_r2"] > 0.5
    X = np.column_stack([np.ones(n - 1), more["x"]])
    e_ = more["y"] - X @ np.linalg.lstsq(X, more["y"], rcond=None)[0]
    assert more["r2"] == pytest.approx(1 - e_ @ e_ / ((more["y"] - more["y"].mean()) ** 2).sum())
    assert fv.augmented(p.head(10), ["a", "b"], "y", None) is None and fv.augmented(p, ["a"], "y", None) is None
    assert fv.row("s", None)[-1] == "too few rows"
    one, two = (fv.augmented(p, ["a", "b", "c"], "y", fv.added_terms(p, "total", ["x"], {}, [], x))["adj_r2"] for x in (1.0, 3.0))
    assert one == pytest.approx(two)  # a linear scale changes nothing
    assert set(fv.added_terms(p, "novelty", ["x"], {}, [])) == {"delta_sent_x", "delta_sent_total"} and fv.added_terms(p, "matched", ["x"], {"sent_q": "a"}, []) is None
    assert fv.masks(p, ["flag"], "y")["flag_one"].sum() == (p["flag"] == 1).sum()
    kept = fv.retained(more["y"], base["x"], np.column_stack([p["sent_total"][: n - 1], r.normal(size=n - 1)]), ["real", "noise"])
    assert kept[0][-1] and kept[0][3] < 1e-6
    assert fv.rolling_bands(more["y"], more["x"], more["x"].shape[1] - 1).shape == (n - 1 - 20, 4)
    walk = fv.walk_forward(more["y"], p["y"][: n - 1].to_numpy(), base["x"], more["x"], 1, 30)
    assert walk["rmse_full"] < walk["rmse_base"] and walk["cw_p"] < 0.01
    assert fv.tradeable(10, 0.6, 0.01) == "yes" and fv.tradeable(10, 0.5, 0.5) == "maybe" and fv.tradeable(0, float("nan"), 0.1) == "n/a"
    x = r.normal(size=(400, 2))
    assert fv.kaiser_pca(np.column_stack([x, x[:, :1] + 0.01 * r.normal(size=(400, 1))]), 0.5)[1] >= 1
    o = np.column_stack([np.ones(50) * 2, r.normal(size=50)])
    assert fv.uncentered_vif(o)[0] == pytest.approx(1 / (1 - (o[:, 0] @ o[:, 1]) ** 2 / ((o[:, 0] @ o[:, 0]) * (o[:, 1] @ o[:, 1]))))


def test_tests_of_series():
    r = np.random.default_rng(4)
    assert fv.adf_p(-2.86) == pytest.approx(0.05, abs=0.003) and fv.adf_p(-3.43) == pytest.approx(0.01, abs=0.002) and fv.adf_p(5) == 1
    assert fv.kpss_auto(r.normal(size=300))[1] > 0.05 and fv.kpss_auto(r.normal(size=300).cumsum())[1] == 0.01
    a = r.normal(size=60)
    n, pr, pp, sr, sp = fv.correlation_tests(a, a + r.normal(size=60))
    assert n == 60 and 0 < pp < 0.01 and sr > 0.4 and fv.correlation_tests(a[:5], a[:5]) is None
    change = np.where(r.normal(size=80) > 0.5, 0.25, np.where(r.normal(size=80) > 0.5, -0.25, 0.0))
    g = fv.walk_forward_probit(change, np.column_stack([change + 0.1 * r.normal(size=80)]), 20, 20)
    assert len(g) == 60 and g["gain"].sum() > 0


def test_pages(spark):
    body = "For release at once. " + "The Committee decided to keep the rate. " * 6 + "Last Update: today"
    html = f"<html><head><style>x</style></head><body><nav>menu</nav><div id='n'></div><div class=\"article\">{body}</div></body></html>"
    got = spark.createDataFrame([(html,), (None,), ("<p>short</p>",)], "h string").select(pages.page_body(F.col("h"))).collect()
    assert got[0][0].startswith("at once. The Committee") and "Last Update" not in got[0][0] and got[1][0] is None and got[2][0] is None
    t = "<table><tr><th>Federal funds rate</th><th>2024</th><th>2025</th><th>Longer run</th></tr><tr><td>4-1/4 to 4-1/2</td><td>3</td><td>1</td><td></td></tr><tr><td>5.25 to 5.50</td><td>1</td><td>x</td><td>2</td></tr></table>"
    cells = pages.projections(spark.createDataFrame([(1, t), (2, "<table><tr><td>none</td></tr></table>")], "id int, h string"), "id", "h")
    assert {(r["year"], r["level"], r["n"]) for r in cells.collect()} == {("2024", 4.375, 3), ("2024", 5.375, 1), ("2025", 4.375, 1), ("lr", 5.375, 2)}
    s = {r["year"]: r for r in pages.projection_statistics(cells, ["id", "year"]).collect()}
    assert s["2024"]["median"] == 4.375 and s["2024"]["n"] == 4 and s["2024"]["tail_asymmetry"] == 1.0 and s["2024"]["p75"] == pytest.approx(4.625)
    line = spark.createDataFrame([("GDP 1.8 2.0 1.5-2.0 1.2 to 2.4",)], "l string").select(*[c.alias(k) for k, c in pages.projection_line(F.col("l")).items()]).first()
    assert line["medians"] == [1.8, 2.0] and line["ranges"] == [[1.5, 2.0], [1.2, 2.4]]
    assert pages.with_spreads(spark.createDataFrame([(3.0, 1.0, 5.0, 0.0)], "ct_high double, ct_low double, range_high double, range_low double")).first()["outlier_pull"] == 3.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Jan-68;x;1.5\nFeb-20;x;2.5\nFeb-20;x;3.5\nbad;x;1\nMar-20;x;\n")
    got = {str(r["day"]): r["value"] for r in readers.positional_csv(spark, str(tmp_path / "s.csv"), 2026).collect()}
    assert got == {"1968-01-01": 1.5, "2020-02-01": 3.5}
    for kind, name, doc in [("minutes", "m1.json", {"date": "20070102", "content": ["One.", "Two."]}), ("minutes", "m2.json", {"date": "20050102", "text": "old"}), ("conf", "c1.json", {"date": "2011-01-01", "prepared_remarks": ["A.", "B."], "source": "c"})]:
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / name).write_text(json.dumps(doc))
    docs = {r["doc_type"]: (r["source"], r["text"]) for r in readers.corpus(spark, {"minutes": str(tmp_path / "minutes"), "conf": str(tmp_path / "conf")}).collect()}
    assert docs == {"minutes": ("m1.json", "One.\n\nTwo."), "conf": ("c", "A. B.")}
    for n in ("x20200102a.txt", "x20200102b.txt", "y20201301.txt", "z.txt"):
        (tmp_path / "idx").mkdir(exist_ok=True)
        (tmp_path / "idx" / n).write_text("t")
    idx = readers.dated_index(spark, str(tmp_path / "idx")).collect()
    assert len(idx) == 1 and len(idx[0]["files"]) == 2
    with pytest.raises(ValueError):
        readers.from_registry(spark, str(tmp_path), "other")
    df = spark.range(5).withColumn("n", F.lit(None).cast("string"))
    writers.json_array(df, str(tmp_path / "arr"))
    read = json.loads("".join(next((tmp_path / "arr").glob("part*")).read_text()))
    assert [r["id"] for r in read] == list(range(5)) and read[0]["n"] is None
    writers.json_array(df.limit(0), str(tmp_path / "none"))
    assert json.loads(next((tmp_path / "none").glob("part*")).read_text()) == []
    for k in range(3):
        writers.publish((writers.read_current(spark, str(tmp_path / "t")) if k else df).select((F.col("id") + 1).alias("id")), str(tmp_path / "t"))
    assert sorted(r["id"] for r in writers.read_current(spark, str(tmp_path / "t")).collect()) == [3, 4, 5, 6, 7]
    writers.append_log(df.select("id"), str(tmp_path / "log"))
    writers.append_log(df.select("id"), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 10
    assert writers.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string"), "T").splitlines()[-1] == "| 1 | 0.5000 |  |"


def test_stream_beside_history_and_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    base = spark.createDataFrame([(1, "k", "2024-01-05"), (2, "k", "2024-01-15"), (3, "q", "2024-01-15"), (3, "q", "2024-01-15")], "id int, k string, t string").withColumn("t", F.to_timestamp("t"))
    base.write.parquet(src)
    history = spark.createDataFrame([("k", "2024-01-01", 1), ("k", "2024-01-10", 2), ("k", "2024-01-10", 0), (None, "2024-01-01", 9)], "k string, t string, x int").withColumn("t", F.to_timestamp("t"))
    for _ in range(2):
        stream = events.known_beside(spark.readStream.schema(base.schema).parquet(src), events.spans(history, "k", "t", ["x"]), "k", "t", "valid_from", "valid_to", ["x"])
        q = events.resumable(stream, out, ck, "id")
        q.awaitTermination(60)
    assert {r["id"]: r["known_x"] for r in spark.read.parquet(out).collect()} == {1: 1, 2: 2, 3: None} and spark.read.parquet(out).count() == 3
    assert m.directional_accuracy(np.array([1.0, -1.0]), np.array([1.0, 1.0]))[0] == 0.5


def test_exact_quantiles_both_ways(spark):
    from chronotext.operators.relational import exact_quantiles

    r = np.random.default_rng(8)
    rows = [("a", float(x)) for x in r.integers(0, 900, 3000)] + [("b", float(x)) for x in r.normal(size=2500)] + [("c", 1.0)] * 700 + [(None, 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for accuracy in (10_000, 100):  # all groups are sorted whole, or only the smallest
        got = {q["g"]: q for q in exact_quantiles(df, ["g"], "x", (0.25, 0.5, 0.99), accuracy).collect()}
        for g in ("a", "b", "c"):
            x = [v for k, v in rows if k == g and v is not None]
            assert [got[g]["q0"], got[g]["q1"], got[g]["q2"]] == pytest.approx(list(np.quantile(x, (0.25, 0.5, 0.99)))), (g, accuracy)
        assert got[None]["q1"] == 3.0 and got["a"]["n"] == 3000


def test_lag_by_span(spark):
    from chronotext.operators.temporal import lag_by_span

    df = spark.range(300).select((F.col("id") * 7 % 300).alias("o"), (F.col("id") % 3).cast("string").alias("g")).withColumn("g", F.nullif("g", F.lit("2"))).withColumn("v", F.col("o") + 0.5)
    got = lag_by_span(df, ["g"], "o", F.floor(F.col("o") / 11), "v", "prev").collect()
    for g in ("0", "1", None):
        mine = sorted((r["o"], r["v"], r["prev"]) for r in got if r["g"] == g)
        assert len(mine) == 100 and [p for _, _, p in mine] == [None] + [v for _, v, _ in mine[:-1]]
