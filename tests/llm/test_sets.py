import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from chronotext.llm import cross_split, near_dup, sets
from chronotext.llm.components import components

VOCAB = [f"w{i}" for i in range(300)]


def similar(a, b, t=Fraction(7, 10)):
    x, y = set(sets.words(a)), set(sets.words(b))
    return len(x & y) * t.denominator >= t.numerator * len(x | y)


def corpus(seed, n=150, longest=40, shuffled=0.2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split()
            for _ in range(r.randrange(0, 9)):
                j = r.randrange(len(w))
                w = w[:j] + r.choice([[], [r.choice(VOCAB)], [w[j], r.choice(VOCAB)]]) + w[j + 1 :] or ["x"]
            if r.random() < shuffled:
                r.shuffle(w)
        else:
            w = [VOCAB[min(299, int(r.expovariate(0.02)))] for _ in range(r.randrange(10, longest))]
        out.append((f"id{i:03}", " ".join(w)))
    return out


def wanted(rows, least=12):
    ok = sorted({(i, s) for i, s in rows if i and s and len(set(sets.words(s))) >= least})
    return {(min(a, c), max(a, c)) for a, b in ok for c, d in ok if a != c and similar(b, d)}


@pytest.mark.parametrize("seed,longest", [(1, 40), (2, 40), (3, 150)])
def test_pairs_against_brute_force(spark, seed, longest):
    rows = [*corpus(seed, longest=longest), ("n1", None), (None, "w1 " * 30), ("n2", ""), ("n3", "   "), ("id000", corpus(seed, longest=longest)[0][1])]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "id string, sentence string, key string")
    got = {tuple(r) for r in near_dup.near_duplicate_pairs(df).collect()}
    assert got == wanted(rows) and len(got) > 20


@pytest.mark.parametrize("lists", [False, True])
def test_both_kinds_of_bands_lose_nothing(lists):
    rows = [s for _, s in corpus(5, 200)]
    m = sets.Measure(Fraction(7, 10), 12)
    v = sets.Vocabulary()
    s = sets.read_sets(rows, 12, v)
    h = v.grown()
    keys = sets.keys_of(h[s.flat], np.cumsum(s.sizes) - s.sizes, s.sizes)
    plan = sets.make_plan(m, dict(zip(*map(lambda x: x.tolist(), np.unique(s.sizes, return_counts=True)))), rows[:80], 3)
    for b in plan.bands:
        b.lists = lists
    found = set()
    code, key = [], []
    import pyarrow as pa

    for batch in sets.postings([pa.RecordBatch.from_arrays([pa.array(rows)], ["t"])], plan):
        for x in batch.column(1).to_pylist():
            c, k = sets.unpack(x)
            code.append(c)
            key.append(k)
    for a, b in sets.meetings(*sets.in_order(np.concatenate(code), np.concatenate(key))[:2], m.table(), False):
        found |= set(zip(a.tolist(), b.tolist()))
    texts = [set(sets.words(rows[i])) for i in s.rows]
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] != keys[j] and m.holds(texts[i], texts[j]):
                assert (min(int(keys[i]), int(keys[j])), max(int(keys[i]), int(keys[j]))) in found


@pytest.mark.parametrize("postings", [8_000, 5])
def test_hot_group_of_copies_and_hot_signature(spark, monkeypatch, postings):
    monkeypatch.setattr(sets, "CELL_POSTINGS", postings)
    base = " ".join(VOCAB[:20])
    rows = [(f"c{i:03}", base) for i in range(60)] + [(f"d{i:03}", base + " " + " ".join(VOCAB[40 + 9 * i : 49 + 9 * i])) for i in range(25)] + [("e", base + " extra")]
    df = spark.createDataFrame(rows, "id string, sentence string")
    assert {tuple(r) for r in near_dup.near_duplicate_pairs(df).collect()} == wanted(rows)
    groups = near_dup.near_duplicate_groups(df).collect()
    assert len({r["id"] for r in groups}) == len(groups) and {r["id"] for r in groups} >= {f"c{i:03}" for i in range(60)} | {"e"}


def test_rare_long_rows_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(sets, "SAMPLE", 5)
    a = " ".join(VOCAB[:20])
    rows = [(f"h{i:03}", f"a headline of few words number {i}") for i in range(300)] + [("x", a), ("y", a.replace("w5 ", "q "))]
    df = spark.createDataFrame(rows, "id string, sentence string")
    assert {tuple(r) for r in near_dup.near_duplicate_pairs(df).collect()} == {("x", "y")}
    plan = sets.make_plan(sets.Measure(Fraction(7, 10), 12), {20: 2}, [], 3)
    assert plan.bands
    out = next(sets.postings([pa.RecordBatch.from_arrays([pa.array([a])], ["t"])], plan))
    assert out.num_rows > 1


def test_empty(spark):
    df = spark.createDataFrame([], "id string, sentence string")
    assert near_dup.near_duplicate_pairs(df).count() == 0 and near_dup.near_duplicate_groups(df).count() == 0


def test_pack_round_trip():
    r = np.random.default_rng(0)
    sig, key, kind = r.integers(0, 2**63, 500).astype(np.uint64), r.integers(0, 2**63, 500).astype(np.uint64), r.integers(0, 2, 500)
    want = sorted((int(s % np.uint64(3)), (int(s >> np.uint64(64 - sets.CODE_BITS)) << 1) | int(x), int(k)) for s, k, x in zip(sig, key, kind))
    got = sorted((b, int(c), int(k)) for b, blk in sets.pack(sig, key, kind, 3) for c, k in zip(*sets.unpack(blk)))
    assert got == want


def test_winnow_keeps_shared_runs():
    v = sets.Vocabulary()
    a, b = "q w e r t y u i o p".split(), "z x r t y u i c".split()
    flat = np.array([v[w] for w in a + b])
    f, owner = cross_split.winnow(flat, np.array([len(a), len(b)]), v.grown())
    assert set(f[owner == 0]) & set(f[owner == 1])
    assert len(cross_split.winnow(flat[:2], np.array([2]), v.grown())[0]) == 0


def test_alignment():
    a, b = "a b c d e f g h".split(), "x a b c d q f g h y".split()
    covered, seeds = cross_split.aligned(a, b)
    assert covered == 7 and seeds >= 2
    assert cross_split.aligned([], b) == (0, 0)


def test_cross_split(spark):
    rows = corpus(7, 200)
    base = [f"w{i}" for i in range(30)]
    rows += [("z0", " ".join(base)), ("z1", " ".join(base[::-1])), ("z2", " ".join(w for i in range(0, 30, 2) for w in (base[i + 1], base[i])))]
    r = random.Random(1)
    split = {i: r.choice(["train", "train", "validation", "test", None]) for i, _ in rows} | {"z0": "train", "z1": "test", "z2": "validation"}
    df = spark.createDataFrame([(i, s, split[i]) for i, s in rows] + [("n", None, "train"), (None, "a", "test"), ("e", "", "test")], "id string, sentence string, split string")
    links, members = cross_split.cross_split_links(df, "id", "sentence", "split", "train", ["validation", "test"])
    m = members.collect()
    ids = {(k, r["key"], r["content"]): [] for r in m for k in (r["kind"],)}
    for r_ in m:
        ids[r_["kind"], r_["key"], r_["content"]].append(r_["id"])
    got = {(min(a, b), max(a, b)) for l in links.collect() for a in ids[0, l["key_a"], l["content_a"]] for b in ids[1, l["key_b"], l["content_b"]]}
    want = {(a, b) for a, b in wanted(rows) if {split[a] == "train", split[b] == "train"} == {True, False} and None not in (split[a], split[b])}
    assert got == want and len(want) > 20 and {("z0", "z1"), ("z0", "z2")} <= got
    assert all(0 <= l["coverage"] <= 1 for l in links.collect())


def test_both_ways_across_find_pairs(spark):
    rows = corpus(11, 200, shuffled=0)
    df = spark.createDataFrame([(i, s, int(n % 3 == 0)) for n, (i, s) in enumerate(rows)], "id string, text string, kind int")
    m = sets.Measure(Fraction(7, 10), 12)
    by_sets, by_both, by_prints = ({tuple(r) for r in cross_split.across_pairs(df, m, **k).collect()} for k in ({"fingerprints": False}, {}, {"exact": False}))
    assert by_prints and by_both == by_sets | by_prints


def test_cross_split_in_a_hot_group_with_spread_edits(spark, monkeypatch):
    r, base = random.Random(3), [f"w{i}" for i in range(20)]
    rows = [("t0", " ".join(base)), ("v0", " ".join(f"x{i}" if i in (10, 18) else w for i, w in enumerate(base)))]
    for i in range(1, 200):
        at = r.sample(range(20), r.choice([0, 1, 1, 2, 3]))
        rows.append((f"{'tv'[i % 2]}{i}", " ".join(f"y{i}x{j}" if j in at else w for j, w in enumerate(base))))
    df = spark.createDataFrame([(i, s, "train" if i[0] == "t" else "test") for i, s in rows], "id string, sentence string, split string")
    # the group is hot: its fingerprints are left to the exact join
    monkeypatch.setattr(cross_split, "HOT_POSTINGS", 20)
    monkeypatch.setattr(sets, "CELL_POSTINGS", 10)
    assert len(cross_split.hot_fingerprints([s for _, s in rows], 12, 200)) >= 3
    links, members = cross_split.cross_split_links(df, "id", "sentence", "split", "train", ["validation", "test"])
    ids = {}
    for m in members.collect():
        ids.setdefault((m["kind"], m["key"], m["content"]), []).append(m["id"])
    got = {(a, b) for l in links.collect() for a in ids[0, l["key_a"], l["content_a"]] for b in ids[1, l["key_b"], l["content_b"]]}
    assert ("t0", "v0") in got
    assert got == {(a, b) for a, b in wanted(rows) if a[0] == "t" and b[0] == "v"}


def test_coverage_compares_every_order_of_a_set(spark):
    base = [f"w{i:02}" for i in range(10, 30)]
    other = base[10:] + base[:10]
    rows = [("t1", " ".join(base), "train"), ("t2", " ".join(["w10", "w10"] + base[11:] + base[1:11]), "train"), ("v1", " ".join(base), "test"), ("v2", " ".join(other), "test")]
    df = spark.createDataFrame(rows, "id string, sentence string, split string")
    got = {r["id"]: r for r in cross_split.best_coverage(*cross_split.cross_split_links(df, "id", "sentence", "split", "train", ["test"])).collect()}
    assert got["v1"]["exact"] and got["v1"]["coverage"] == 1 and got["v1"]["n_train_sets"] == 1
    assert not got["v2"]["exact"]


def test_components(spark):
    e = [("a", "b"), ("b", "c"), ("x", "y"), ("c", "c"), ("a", "b"), (None, "q"), ("z", None)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "u string, v string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and {got[f"p{i:02}"] for i in range(41)} == {"p00"} and "q" not in got
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_filter_lets_all_its_values_pass(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "key").repartition(5)
    some = df.filter("key % 10 = 0")
    got = {r["key"] for r in sets.maybe_in(df, sets.filter_of(some)).collect()}
    assert got >= set(range(0, 3000, 10)) and len(got) < 330
    assert sets.maybe_in(df, sets.filter_of(df.limit(0))).count() == 0
    monkeypatch.setattr(sets, "SLICE_BITS", 1 << 10)
    got = {r["key"] for r in sets.maybe_in(df, sets.filter_of(some)).collect()}
    assert got >= set(range(0, 3000, 10)) and len(got) < 330
    monkeypatch.setattr(sets, "MOST_BITS", 1)
    assert {r["key"] for r in sets.maybe_in(df, sets.filter_of(some)).collect()} == set(range(0, 3000, 10))


def test_crowded_signatures_are_left_out_and_nothing_is_lost():
    # templates of common words with few rare ones: some group is crowded in every set
    r, common, rare = random.Random(9), [f"c{i}" for i in range(60)], [f"r{i}" for i in range(1500)]
    templates = [r.sample(common, 22) for _ in range(3)]
    rows = []
    for i in range(1200):
        w = r.choice(templates) + r.sample(rare[:40], 5) + r.sample(rare, 9)
        rows.append(" ".join(w))
        if i % 8 == 0:
            for j in r.sample(range(36), r.choice([1, 3, 5, 6])):
                w[j] = r.choice([w[j] + "x", r.choice(rare), "c0"])
            rows.append(" ".join(w))
    m, v = sets.Measure(Fraction(7, 10), 12), sets.Vocabulary()
    s = sets.read_sets(rows, 12, v)
    keys = sets.keys_of(v.grown()[s.flat], np.cumsum(s.sizes) - s.sizes, s.sizes)
    texts = [frozenset(sets.words(x)) for x in rows]
    close = {(min(a, b), max(a, b)) for i, a in enumerate(keys.tolist()) for j, b in enumerate(keys[:i].tolist()) if a != b and m.holds(texts[i], texts[j])}
    # as for 20 million rows: crowded signatures are spread over cells and have a second parity
    plan = sets.make_plan(m, {n: 8_000 * c for n, c in zip(*(x.tolist() for x in np.unique(s.sizes, return_counts=True)))}, r.sample(rows, 600), 1)
    plan.buckets = 1
    parts = [sets.opened(x) for b in sets.postings([pa.RecordBatch.from_arrays([pa.array(rows)], ["t"])], plan) for x in b.column(1).to_pylist()]
    code, key, second = (np.concatenate(p) for p in zip(*parts))
    asks = code >> (sets.CODE_BITS + 1)
    assert (asks >= sets.WIDE).any() and any(len(b.hot) for b in plan.bands)
    code, key, _, second = sets.in_order(code, key, second)
    found = set()
    for a, b in sets.meetings(code, key, m.table(), False, second):
        found |= set(zip(a.tolist(), b.tolist()))
    assert close <= found and len(close) > 100
    # compared pairs: each posting that asks with those listed under its signature
    what, sig = (code >> (sets.CODE_BITS + 1)) % sets.WIDE, code & ((1 << (sets.CODE_BITS + 1)) - 1)
    listed = np.bincount(sig[what < sets.ONLY_WHOLE], minlength=1 << (sets.CODE_BITS + 1))
    compared = listed[sig[what > 0] & ~1].sum() + listed[sig[(what % 2 == 0) & (what > 0) & (sig & 1 == 0)] | 1].sum()
    every = 0
    for _, s_, _, k, _ in sets.band_postings(s, v.grown(), keys, plan):
        u, at = np.unique(s_, return_inverse=True)
        whole, less = (np.bincount(at[k == x], minlength=len(u)) for x in (0, 1))
        every += int((whole * whole + 2 * whole * less).sum())
    assert compared < 0.7 * every


def test_a_set_asks_least_where_it_is_crowded():
    band = sets.Band(0, 99, 3, False, np.ones(99, bool), need=np.full(99, 4))
    n, sizes = 2, np.array([6, 6])
    s = sets.mix(np.arange(n * 3 + 12, dtype=np.uint64))
    cell = np.concatenate([np.arange(n * 3), np.repeat(np.arange(n * 3), 2)])
    crowds = np.zeros((2, 1 << sets.CROWD_BITS), np.float32)
    crowds[0][s[[1, 3]] >> np.uint64(64 - sets.CROWD_BITS)] = 1000
    asks = sets.asked(s, cell, sizes, band, crowds)
    assert asks[:6].tolist() == [sets.ALL, sets.LISTED, sets.ALL, sets.LISTED, sets.ALL, sets.ALL]
    assert asks[6:].tolist() == [sets.WHOLE] * 2 + [sets.LISTED] * 2 + [sets.WHOLE] * 2 + [sets.LISTED] * 2 + [sets.WHOLE] * 4
