"""The same or nearly the same records in the training split and in others (problem 4): winnowing fingerprints.

Each sentence selects, in every window of WINDOW word grams, the gram of the smallest rolling hash: any run of
GRAM + WINDOW - 1 words shared by two sentences leaves a common fingerprint. Fingerprints of training records meet those
of evaluation records only. Fingerprints follow the reading order and stock phrases have too many, so the exact join of
`sets`, across the two kinds, adds what they cannot find: pairs of reordered or densely edited sentences, and pairs whose
only common fingerprints are among those expected to have more than HOT_POSTINGS postings, which are left to it. Both
leave the scan in one pass and meet in the same buckets. What meets is bounded by the keys of `sets` before texts are
fetched; then the common grams of a pair are chained (the longest run of seeds in the order of both texts), extended word
by word, and the covered share of the evaluation record is reported. The exact similarity of the word sets decides last.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import sets
from chronotext.llm.near_dup import LEAST_WORDS, SIMILARITY
from chronotext.session import cut_lineage, shuffle_partitions, table

GRAM, WINDOW, SEED = 3, 3, 3
U = np.uint64
#: Fingerprints a sentence leaves on average, for the number of buckets; postings from which on one is left to the exact join.
PER_ROW, HOT_POSTINGS = 20, 5_000


class Grams:
    """Hashes of any run of words in sequences given as one flat array (sums of powers modulo 2**64)."""

    C = 0x9E3779B97F4A7C15

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        n = len(flat)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the end of the sequence
        up, down = np.full(n + 1, self.C, U), np.full(n + 1, pow(self.C, -1, 2**64), U)
        up[0] = down[0] = 1
        self.inverse = np.multiply.accumulate(down)[:n]
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(sets.mix(hashes[flat]) * np.multiply.accumulate(up)[:n], dtype=U)])

    def run(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return sets.mix((self.sums[at + length] - self.sums[at]) * self.inverse[at] + np.asarray(length).astype(U))

    def starts(self, length: int) -> np.ndarray:
        return np.flatnonzero(self.left >= length)


def winnow(flat: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, owner) of word sequences. A sequence shorter than a gram leaves none; one of fewer grams than a window its smallest."""
    g = Grams(flat, sizes, hashes)
    at = g.starts(gram)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    value = g.run(at, gram)
    own, m = g.owner[at], len(at)
    best = np.arange(m)
    for i in range(1, window):  # the last smallest of the window that starts here, within one sequence
        other = np.minimum(np.arange(m) + i, m - 1)
        best = np.where((own[other] == own) & (value[other] <= value[best]), other, best)
    full = own[np.minimum(np.arange(m) + window - 1, m - 1)] == own
    full[m - window + 1 :] = False
    few = np.bincount(own, minlength=len(sizes))[own] < window
    chosen = np.zeros(m, bool)
    chosen[best[full | few & np.r_[True, own[1:] != own[:-1]]]] = True
    return value[chosen], own[chosen]


def read_sequences(texts: list[str], least: int, vocabulary: sets.Vocabulary) -> tuple[np.ndarray, ...]:
    """(rows, flat, sizes, distinct, counts): word sequences and word sets of the texts with enough distinct words."""
    rows, flat, sizes, distinct, counts = [], [], [], [], []
    number = vocabulary.__getitem__
    for i, s in enumerate(texts):
        w = sets.words(s)
        d = set(w)
        if len(d) >= least:
            rows.append(i)
            flat.extend(map(number, w))
            distinct.extend(map(number, d))
            sizes.append(len(w))
            counts.append(len(d))
    return tuple(np.array(x, np.int64) for x in (rows, flat, sizes, distinct, counts))


def hot_fingerprints(sample: list[str], least: int, total: int) -> np.ndarray:
    """Sorted fingerprints that, going by the sample, have more than HOT_POSTINGS postings in `total` sentences."""
    vocabulary = sets.Vocabulary()
    _, flat, sizes, _, _ = read_sequences(sample, least, vocabulary)
    found, n = np.unique(winnow(flat, sizes, vocabulary.grown())[0], return_counts=True)
    return found[(n >= 4) & (n * total / max(1, len(sample)) > HOT_POSTINGS)]


def aligned(a: list[str], b: list[str], gram: int = SEED) -> tuple[int, int]:
    """(words of b covered, seeds chained): common grams in the order of both, extended while words agree."""
    where = defaultdict(list)
    for i in range(len(a) - gram + 1):
        where[tuple(a[i : i + gram])].append(i)
    seeds = [(j, i) for j in range(len(b) - gram + 1) for i in reversed(where.get(tuple(b[j : j + gram]), ()))]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    for s, (_, i) in enumerate(seeds):  # longest chain that grows in both texts
        p = bisect_left(tails, i)
        if p == len(tails):
            tails.append(i)
            ends.append(s)
        else:
            tails[p], ends[p] = i, s
        back[s] = ends[p - 1] if p else -1
    chain, s = [], ends[-1] if ends else -1
    while s >= 0:
        chain.append(seeds[s])
        s = back[s]
    covered = set()
    for j, i in chain:
        covered.update(range(j, j + gram))
        for step in (-1, 1):
            x, y = (i - 1, j - 1) if step < 0 else (i + gram, j + gram)
            while 0 <= x < len(a) and 0 <= y < len(b) and y not in covered and a[x] == b[y]:
                covered.add(y)
                x, y = x + step, y + step
    return len(covered), len(chain)


def new_texts(texts: list[str], kinds: list[int], seen: set[int], most: int = 300_000) -> tuple[list[str], list[int]]:
    """Those that this task has not had yet; a copy's postings would say nothing new. `seen` is emptied when it is full."""
    if len(seen) > most:
        seen.clear()
    out: tuple[list[str], list[int]] = ([], [])
    for t, k in zip(texts, kinds):
        h = sets._hash(f"{k}{t}")
        if h not in seen:
            seen.add(h)
            out[0].append(t)
            out[1].append(k)
    return out


def across_pairs(rows: DataFrame, measure: sets.Measure, fingerprints: bool = True, exact: bool = True) -> DataFrame:
    """(key_a, key_b): keys of training (a) and evaluation (b) sentences that may be similar. rows: id, text, kind.

    fingerprints, exact: which of the two ways is gone (both by default; one alone is for tests and measurements).
    """
    plan, sample, total = sets.plan_for(rows, "id", "text", measure)
    hot = hot_fingerprints(sample, measure.least, total)
    most = int(total * PER_ROW / sets.BUCKET_POSTINGS) + 1
    first = (0, most, most + plan.buckets)  # buckets of fingerprints, of whole groups of training, of evaluation

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = sets.Vocabulary(), set()
        for texts, kinds in sets.chunked(batches, 16_384):
            vocabulary.bounded()
            texts, kinds = new_texts(texts, kinds, seen)
            at, flat, sizes, distinct, counts = read_sequences(texts, measure.least, vocabulary)
            if not len(sizes):
                continue
            h, kind = vocabulary.grown(), np.array(kinds, np.int64)[at]
            starts = np.cumsum(counts) - counts
            keys = sets.keys_of(h[distinct], starts, counts)
            parts = []
            if fingerprints:
                sig, owner = winnow(flat, sizes, h)
                cold = sets.places(hot, sig) < 0
                parts.append((sig[cold], keys[owner][cold], kind[owner][cold]))
            else:
                parts.append(sets.joined([]))
            single = sets.first_of_each(keys, sets.content_of(h[distinct], starts), kind.astype(U))
            own = sets.Sets(at, distinct, counts).take(single)
            parts += sets.across_postings(own, h, keys[single], kind[single], plan) if exact else []
            yield sets.blocks_of(x for p, n, begin in zip(parts, (most, plan.buckets, plan.buckets), first) for x in sets.pack(*p, n, begin))

    limit = measure.table()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, code, key, _ in sets.by_bucket(batches):
            code, key, _ = sets.in_order(code, key)
            turn = -1 if bucket >= first[2] else 1
            yield sets.key_pairs([np.stack(p[::turn]) for p in sets.meetings(code, key, limit, cross=True) if len(p[0])])

    return sets.met(rows.select("text", "kind").mapInArrow(emit, "bucket int, block binary"), most + 2 * plan.buckets, meet)


def with_sequence(rows: DataFrame) -> DataFrame:
    """rows with `seq`, the hash of the text's words in their order (a set may be held in several orders)."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = np.array([sets._hash(" ".join(sets.words(s))) for s in b.column("text").to_pylist()], U)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq.view(np.int64))], [*b.schema.names, "seq"])

    return rows.mapInArrow(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", seq long")


def cross_split_links(rows: DataFrame, id_: str, text: str, split: str, train: str, others: list[str], t: Fraction = SIMILARITY, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: key_a, content_a, seq_a of training words, key_b, content_b, seq_b of similar evaluation words, coverage, exact.

    A set is named by key and content; seq tells the orders and repeats of its words apart, each of which is compared.
    members: kind (0 training, 1 evaluation), key, content, seq, id of the records of those sets. Records of other or null
    splits, null ids and sentences, and sentences of fewer than `least` distinct words are left out.
    """
    kind = F.when(F.col(split) == train, 0).when(F.col(split).isin(others), 1)
    kept = rows.select(F.col(id_).alias("id"), F.col(text).alias("text"), kind.cast("int").alias("kind")).dropna()
    measure = sets.Measure(t, least)
    pairs = across_pairs(kept, measure)
    named = cut_lineage(sets.maybe_in(sets.keyed(kept, "text", least, ["id", "kind"]).select("id", "kind", *sets.NAMED), sets.key_filter(pairs)))
    close = cut_lineage(sets.close_pairs(pairs, *(sets.one_each(named.filter(F.col("kind") == k)) for k in (0, 1)), measure))
    wanted = sets.filter_of(sets.maybe_in(named, sets.key_filter(close)).select("id"))
    near = sets.maybe_in(sets.keyed(sets.maybe_in(kept, wanted, "id"), "text", least, ["id", "kind"]), sets.key_filter(close))
    near = cut_lineage(with_sequence(near))
    of = lambda k: near.filter(F.col("kind") == k)
    side = lambda k, s: of(k).groupBy("key", "content", "seq").agg(F.min("text").alias("text")).select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "content", "seq", "text")])
    names = ["key_a", "content_a", "seq_a", "key_b", "content_b", "seq_b"]
    both = close.join(side(0, "a"), ["key_a", "content_a"]).join(side(1, "b"), ["key_b", "content_b"]).select(*names, "text_a", "text_b")

    def checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_, cover, same = [], [], []
            for i, (x, y) in enumerate(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())):
                wa, wb = sets.words(x), sets.words(y)
                if measure.holds(set(wa), set(wb)):
                    covered, _ = aligned(wa, wb)
                    rows_.append(i)
                    cover.append(covered / len(wb))
                    same.append(wa == wb)
            kept_ = b.take(pa.array(rows_, pa.int64())).select(names)
            yield pa.RecordBatch.from_arrays([*kept_.columns, pa.array(cover, pa.float64()), pa.array(same, pa.bool_())], [*kept_.schema.names, "coverage", "exact"])

    links = cut_lineage(both.mapInArrow(checked, ", ".join(f"{n} long" for n in names) + ", coverage double, exact boolean"))
    return links, near.select("kind", "key", "content", "seq", "id").distinct()


TRAIN, OTHERS = "train", ["validation", "test"]


def annotation_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cross_split_links(table(spark, sf_dir, "annotations"), "id", "sentence", "split_name", TRAIN, OTHERS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = annotation_links(spark, sf_dir)
    side = lambda k, s: members.filter(F.col("kind") == k).select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "content", "id")]).distinct()
    pairs = links.select("key_a", "content_a", "key_b", "content_b").distinct().join(side(0, "a"), ["key_a", "content_a"]).join(side(1, "b"), ["key_b", "content_b"]).filter(F.col("id_a") != F.col("id_b"))
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def best_coverage(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, coverage, exact, n_train_sets) of each evaluation record's own words."""
    own = [F.col(f"{c}_b").alias(c) for c in ("key", "content", "seq")]
    best = links.groupBy(*own).agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact"), F.count_distinct("key_a", "content_a").alias("n_train_sets"))
    return members.filter(F.col("kind") == 1).join(best, ["key", "content", "seq"]).select("id", "coverage", "exact", "n_train_sets")


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation record found in training: its best coverage and whether the words agree in order."""
    links, members = annotation_links(spark, sf_dir)
    found = best_coverage(links, members).groupBy("id").agg(F.round(F.max("coverage"), 6).alias("coverage"), F.max("exact").alias("exact"), F.max("n_train_sets").alias("n_train_sets"))
    named = table(spark, sf_dir, "annotations").filter(F.col("split_name").isin(OTHERS)).groupBy("id").agg(F.min("split_name").alias("split_name"), F.min("source").alias("source"))
    return found.join(named, "id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: evaluation records, how many of them are in training exactly and nearly, mean coverage."""
    named = table(spark, sf_dir, "annotations").filter(F.col("split_name").isin(OTHERS)).groupBy("id").agg(F.min("split_name").alias("split_name"), F.min("source").alias("source"))
    found = p4_coverage(spark, sf_dir).select("id", "coverage", "exact")
    return named.join(found, "id", "left").groupBy("split_name", "source").agg(
        F.count("*").alias("n_records"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


QUERIES = {"p4_found": p4_found, "p4_coverage": p4_coverage, "p4_report": p4_report}
ORACLES: dict[str, str] = {}
