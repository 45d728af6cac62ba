import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotext.llm import language, mixing, sampling, splits
from chronotext.llm.common import permuted_position
from chronotext.llm.tokenizing import Codec, decoded, encoded, token_counts


@pytest.fixture(scope="module")
def codec():
    return Codec()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_codec_equals_library_and_round_trips(texts):
    c = test_codec_equals_library_and_round_trips.codec = getattr(test_codec_equals_library_and_round_trips, "codec", None) or Codec()
    ids = c.encode(texts)
    assert ids == [e.ids for e in c.library.encode_batch(texts, add_special_tokens=False)]
    assert [c.decode(x) for x in ids] == texts
    for t, x in zip(texts, ids):
        a, b = c.offsets(t, x)
        assert (not x) or (a[0] == 0 and b[-1] == len(t) and all(p < q for p, q in zip(a, b)))


def test_special_strings_and_split_characters(codec):
    assert codec.decode(codec.encode(["a <|endoftext|> b"])[0]) == "a <|endoftext|> b" and 50256 not in codec.encode(["<|endoftext|>"])[0]
    ids = codec.encode(["🙂"])[0]
    assert len(ids) > 1 and "\ufffd" in codec.decode(ids[:1]) and codec.offsets("🙂", ids) == ([0] * len(ids), [1] * len(ids))


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "one two", 0), (3, "one two", 0), (4, "é " * 20000, 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in encoded(df, "doc_id", "text").collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] > 20000
    back = {r["doc_id"]: r["text"] for r in decoded(encoded(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back[1] == "" and back[3] == "one two" and back[4] == "é " * 20000
    assert token_counts(df.limit(0), ["doc_id"], "text").count() == 0


@pytest.mark.parametrize("source,name", [(" https://a.b/c/Minutes_2012.HTML?print=1 ", "minutes2012"), ("C:\\x\\y z.pdf#p", "yz"), ("A - b (3)", "ab3"), ("x.txt.json", "xtxt"), (None, None)])
def test_document_name(spark, source, name):
    assert spark.createDataFrame([(source,)], "s string").select(splits.document_name(F.col("s"))).first()[0] == name


def test_any_date(spark):
    values = ["20120620", "2012-06-20", "2012-06-20 00:00:00", "June 20, 2012", "20 June 2012", "6/20/2012", " 20120620 ", "", " ", None, "soon", "20121399"]
    got = [str(r[0]) for r in spark.createDataFrame([(v,) for v in values], "s string").select(splits.any_date(F.col("s"))).collect()]
    assert got == ["2012-06-20"] * 7 + ["None"] * 5


def test_closest_totals():
    r = random.Random(4)
    for _ in range(40):
        sizes = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        flat = [s for s, c in sizes.items() for _ in range(c)]
        sums = {0}
        for s in flat:
            sums |= {x + s for x in sums}
        target = r.uniform(0, sum(flat))
        got = splits.closest(sizes, target)
        assert all(c <= sizes[s] for s, c in got.items())
        assert abs(abs(sum(s * c for s, c in got.items()) - target) - min(abs(x - target) for x in sums)) < 1e-9
    assert splits.closest({}, 5) == {}


def test_rounded_totals(monkeypatch):
    monkeypatch.setattr(splits, "MOST_CELLS", 50)
    got = splits.closest({1: 500, 40: 10, 300: 2}, 700)
    assert abs(sum(s * c for s, c in got.items()) - 700) <= 20


def test_totals_are_exact_beyond_four_million():
    got = splits.closest({4: 5_000_000, 10_000_000: 1}, 4_500_000)
    assert sum(s * c for s, c in got.items()) == 4_500_000


def test_rounded_totals_give_back(monkeypatch):
    monkeypatch.setattr(splits, "MOST_CELLS", 50)
    got = splits.closest({4: 500, 1000: 1}, 450)
    assert abs(sum(s * c for s, c in got.items()) - 450) <= 2 and got.get(4, 0) <= 500


def test_grouped_splits(spark):
    r = random.Random(5)
    rows = [(f"i{i}", r.choice(["a.html", " A.HTML", "b.pdf", "c", "d", None]) if i % 3 else None, r.choice(["x", "y", None]), r.choice(["20200101", "2020-01-02", "", None]), 7) for i in range(200)] + [(f"s{i}", f"own{i}", "z", None, 7) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, source string, board string, date string, size int")
    got = splits.grouped_splits(df, {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert got.count() == 300 and got.groupBy("component").agg(F.count_distinct("new_split").alias("n")).filter("n > 1").count() == 0
    assert got.filter("new_split is null").count() == 0
    assert splits.grouped_splits(df.limit(0), {"train": 1.0}).count() == 0


def test_permuted_position(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 600, "hot").when(F.col("id") < 900, "x").alias("g"), F.lit(2).alias("w"))
    for g in ("hot", "x", None):
        mine = permuted_position(df, ["g"], ["id"], 1, F.col("w")).filter(F.col("g").eqNullSafe(F.lit(g)))
        n = df.filter(F.col("g").eqNullSafe(F.lit(g))).count()
        assert sorted(r["before"] for r in mine.collect()) == list(range(0, 2 * n, 2))


def test_allocation_passes_unmet_quota_on():
    q = sampling.allocate(100, {"a": {"t": 5, "u": 100, sampling.REST: 0}, "b": {"t": 10, "u": 10, sampling.REST: 10}}, {"a": (0.5, 1), "b": (0.5, 1)}, {"t": (0.5, 1), "u": (0.5, 1)})
    assert q["a", "t"] == 5 and sum(q.values()) == 100 and q["b", "t"] == 10 and q["b", sampling.REST] == 10 and q["a", "u"] == 65
    assert sampling.allocate(5, {}, {}, {}) == {}


def test_sampling(spark):
    rows = [(f"i{i}", ["Minutes", " minutes", "speech", None][i % 4], [["Inflation"], ["unemployment", "macro"], None, [None, ""]][i % 4], 1) for i in range(400)] + [("i0", "Minutes", ["labor-market"], 1), (None, "speech", ["x"], 1)]
    df = spark.createDataFrame(rows, "id string, doc_type string, top array<string>, type int")
    targets = [{"field_name": f, "category": c, "as_given": c, "share": s, "min_n": m} for f, c, s, m in [("doc_type", "minutes", 0.6, 3), ("doc_type", "speech", 0.4, 3), ("top", "inflation", 0.5, 2), ("top", "labor_market", 0.3, 2), ("top", "housing", 0.2, 2)]]
    records = sampling.usable_records(df)
    n, available = sampling.category_counts(records, targets)
    assert n == 300 and available["top", "labor_market"] == 101 and available["top", "housing"] == 0
    got = sampling.proportional_sample(records, targets)
    assert got.count() == 60 and got.select("id").distinct().count() == 60
    assert sampling.proportional_sample(records.limit(0), targets).count() == 0


def test_report_of_what_was_drawn(spark):
    rows = [(f"s{i}", "speech", ["housing"] if i < 100 else ["macro"]) for i in range(250)] + [(f"m{i}", "minutes", ["macro"]) for i in range(250)]
    records = sampling.usable_records(spark.createDataFrame(rows, "id string, doc_type string, top array<string>"))
    targets = [{"field_name": f, "category": c, "as_given": c, "share": s, "min_n": m} for f, c, s, m in [("doc_type", "minutes", 0.8, 1), ("doc_type", "speech", 0.2, 1), ("top", "housing", 0.4, 1), ("top", "macro", 0.6, 1), ("top", "wages", 0.1, 5)]]
    got = {r[1]: r for r in sampling.target_report(records, targets)}
    assert got["housing"][5] == 100 and got["housing"][6] < got["housing"][4] == 40 and got["housing"][-2:] == (True, False)
    assert got["wages"][-2:] == (True, True) and got["speech"][-2:] == (False, False)


def test_flow_prefers_fewer_repeats():
    flow = mixing.cheapest_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 15, "b": 15}, {"a": 1, "b": 2})
    got = {s: sum(n for (_, _, t), n in flow.items() if t == s) for s in "ab"}
    assert got == {"a": 15, "b": 15} and sum((u - 1) * n for (_, u, _), n in flow.items()) == 5
    assert mixing.cheapest_flow({}, {"a": 3}, {"a": 1}) == {}


def test_mixing(spark):
    docs = [(i, f"text number {i} of some words", [" A", "a", "B", "c", None][i % 5], 0) for i in range(200)] + [(900, None, "a", 0), (901, "", "a", 0), (902, "text number 0 of some words", "b", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("none", 0.0, 1)], "source string, weight double, max_repeats int")
    mix, sizes, whole = mixing.mixed(df, targets)
    size = {r["source"]: r["size"] for r in sizes.collect()}
    assert whole == sum(size.values()) and set(size) == {"a", "b"}
    rows = mix.collect()
    assert max(r["copies"] for r in rows if r["source"] == "b") == 1 and max(r["copies"] for r in rows) <= 2
    got = sum(r["tokens"] * r["copies"] for r in rows if r["source"] == "a")
    assert abs(got - whole / 2) < 0.1 * whole
    assert mixing.mixed(df.limit(0), targets)[0].count() == 0


def test_mixing_counts_each_id_of_a_text(spark):
    docs = [(i, "the same few words", "a") for i in range(6)] + [(10 + i, f"other words {i} here", "b") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, weight double, max_repeats int")
    mix, sizes, whole = mixing.mixed(df, targets)
    got = {}
    for r in mix.collect():
        got[r["source"]] = got.get(r["source"], 0) + r["tokens"] * r["copies"]
        assert r["copies"] <= 2
    assert got["a"] >= whole / 2 and got["b"] >= whole / 2
    assert {r[0]: (r[-2], r[-1]) for r in mixing.source_report(df, targets)} == {"a": (False, False), "b": (False, False)}


def test_source_report_follows_the_flow(spark):
    docs = [(1, "one two three four", "a"), (2, "one two three five", "a"), (2, "one two three five", "b"), (3, "six seven eight nine", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.3, 1), ("c", 0.2, 1)], "source string, weight double, max_repeats int")
    rows = {r[0]: r for r in mixing.source_report(df, targets)}
    assert rows["a"][-2:] == (True, True) and rows["c"][-2:] == (False, False)
    assert rows["a"][5] <= rows["a"][3] and rows["b"][5] <= rows["b"][3]


EN = "The committee noted that prices rose faster than expected during the last quarter of the year. "
FR = "Le comité a constaté que les prix ont augmenté plus vite que prévu au cours du dernier trimestre. "
DE = "Der Ausschuss stellte fest, dass die Preise im letzten Quartal schneller gestiegen sind als erwartet. "


def test_language(spark):
    base = [(i, t * 3, l) for i, (t, l) in enumerate([(EN, "en"), (FR, "fr"), (DE, "de")] * 12)]
    odd = [(100, EN + FR, "en"), (101, DE * 2, "EN-us"), (102, None, "en"), (103, "", None), (104, "12 13 14 15 16 17 18 19 20\n" * 3, "fr"), (105, "Le prix. " + EN * 2, "English"), (106, FR.upper() * 200, "fra"), (107, EN, None), (108, DE + "\n\n" + DE + EN, "de"), (107, EN, None)]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string")
    got = {}
    for r in language.language_passages(df).collect():
        got.setdefault(r["doc_id"], {})[r["seg_no"]] = r["lang"]
        assert 0.5 <= r["confidence"] <= 1
    assert got[100] == {0: "en", 1: "fr"} and got[101] == {0: "de"} and got[105] == {0: "en"} and got[106] == {0: "fr"} and got[108] == {0: "de", 1: "en"}
    assert not {102, 103, 104} & set(got)
    assert language.language_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("label,code", [("en-US", "en"), ("FRENCH", "fr"), ("deu", "de"), (" pt_BR ", "pt"), ("und", None), ("", None), (None, None)])
def test_language_named(label, code):
    assert language.language_named(label) == code


UK = "Комітет зазначив, що ціни зростали швидше, ніж очікувалося в останньому кварталі року. "
PL = "Komitet zauważył, że ceny rosły szybciej niż oczekiwano w ostatnim kwartale roku, a gospodarka zwolniła. "


def test_rare_and_unlisted_languages_are_not_the_largest(spark):
    rows = [(i, t * 3, l) for i, (t, l) in enumerate([(EN, "en"), (FR, "fr"), (DE, "de")] * 60)]
    rows += [(500 + i, UK * 2, "uk") for i in range(4)] + [(600 + i, EN * 2, "nl") for i in range(4)] + [(700, PL * 2, None), (701, UK, "unknown"), (702, EN + UK, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, odd = {}, {}
    for r in language.language_passages(df).collect():
        got.setdefault(r["doc_id"], []).append(r["lang"])
    for r in language.language_passages(df, unlisted=True).collect():
        odd.setdefault(r["doc_id"], []).append(r["lang"])
    assert all(got[500 + i] == ["uk"] for i in range(4)) and got[701] == ["uk"] and sorted(got[702]) == ["en", "uk"]
    assert all(got[600 + i] == ["en"] for i in range(4))
    assert 700 not in got and odd[700] == ["und"]


def test_label_codes_agree(spark):
    labels = ["en-US", "FRENCH", "deu", " pt_BR ", "und", "", None, "uk", "XX", "n/a", "some words", "pol", "zh-Hant"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "s string").select(language.code_of(F.col("s"))).collect()]
    assert got == [language.language_named(x) for x in labels]


def test_even_shares():
    assert language.even_shares({"a": 5000, "b": 2, "c": 400}, 300) == {"b": 2, "c": 149, "a": 149}
    assert language.even_shares({}, 10) == {} and sum(language.even_shares({f"l{i}": 5 for i in range(40)}, 10).values()) == 10


def test_draw_lets_few_rows_through(spark):
    from chronotext.llm.common import draw_limit, drawn, hash_of

    df = spark.range(20_000).select((F.col("id") % 15_000).alias("id")).repartition(16)
    few = df.filter(hash_of(["id"]) <= draw_limit(200, 20_000))
    assert few.count() < 500
    got = drawn(few, ["id"], ["id"], 200)
    assert 100 < len({r["id"] for r in got}) == len(got) <= 200
    assert len(drawn(df.limit(50), ["id"], ["id"], 200)) <= 50


def test_allocation_counts_a_record_for_all_its_topics():
    tree = {"a": {"t": 300, "t|u": 200, "u": 100, sampling.REST: 500}, "b": {"t|u": 50, "u": 400, sampling.REST: 600}, "(other)": {"t": 9}}
    types, tops = {"a": (0.5, 1), "b": (0.5, 1)}, {"t": (0.3, 1), "u": (0.25, 1), "v": (0.1, 3)}
    q = sampling.allocate(400, tree, types, tops)
    assert all(n <= tree[t][c] for (t, c), n in q.items()) and sum(q.values()) == 400
    assert abs(sum(n for (t, _), n in q.items() if t == "a") - 200) <= 1
    for name, (share, _) in tops.items():
        assert name == "v" or abs(sum(n for (_, c), n in q.items() if name in sampling.members(c)) - share * 400) <= 4


def test_topic_quota_moves_to_other_types():
    tree = {"a": {"t": 0, sampling.REST: 500}, "b": {"t": 300, sampling.REST: 500}}
    q = sampling.allocate(100, tree, {"a": (0.5, 1), "b": (0.5, 1)}, {"t": (0.4, 1)})
    assert sum(q.values()) == 100 and abs(q["b", "t"] - 40) <= 1


def test_rounding_leaves_no_topic_short():
    tree = {"a": {"t": 300, "u": 300, sampling.REST: 500}, "b": {"t|u": 50, "u": 400, sampling.REST: 600}}
    q = sampling.allocate(333, tree, {"a": (0.5, 1), "b": (0.5, 1)}, {"t": (0.17, 1), "u": (0.23, 1)})
    got = {n: sum(c for (_, k), c in q.items() if n in sampling.members(k)) for n in "tu"}
    assert sum(q.values()) == 333 and got["t"] >= 57 and got["u"] >= 77 and all(c <= tree[t][k] for (t, k), c in q.items())
