"""Missing or wrong document language labels (problem 8): naive Bayes over hashed character n-grams.

The classifier is fitted on the driver to a bounded sample of labelled documents, drawn evenly over the languages that the
labels name (any code of two or three letters is one). Two halves score each other: a label that the other half does not
confirm is replaced, and a class that a larger one explains as well is no language of its own. What sentences of a class score
in the other half also tells from where on a sentence is in none of the languages. The matrix of log-probabilities
(languages x SLOTS) is broadcast, and the sentences of each Arrow batch are scored together in numpy: n-grams of a batch
as one array, one gather and one segmented sum per language. No shuffle but for the fit, whose counts are by label.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import draw_limit, drawn, hash_of
from chronotext.session import ship_package, table

#: Names of languages by code: fixed values.
NAMES = {
    "en": ("eng", "english"), "fr": ("fra", "fre", "french"), "de": ("deu", "ger", "german"), "es": ("spa", "spanish"), "it": ("ita", "italian"), "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"), "sv": ("swe", "swedish"), "da": ("dan", "danish"), "no": ("nor", "norwegian"), "fi": ("fin", "finnish"), "pl": ("pol", "polish"), "cs": ("ces", "cze", "czech"),
    "ro": ("ron", "rum", "romanian"), "hu": ("hun", "hungarian"), "el": ("ell", "gre", "greek"), "ru": ("rus", "russian"), "tr": ("tur", "turkish"), "ja": ("jpn", "japanese"), "zh": ("zho", "chi", "chinese"),
}
CODE_OF = {name: code for code, names in NAMES.items() for name in (code, *names)}
#: Codes and words for an unknown, a mixed or no language; and what a passage in none of the fitted languages is called.
UNKNOWN, NONE = {"und", "unk", "mul", "mis", "zxx", "xx", "xxx", "na", "nan", "any", "all"}, "und"

#: Documents the classifier is fitted to, at most; sentences a language needs; hashed n-grams; rounds of relabelling.
FIT_DOCUMENTS, LEAST_TEXTS, ORDERS, SLOTS, ROUNDS, SMOOTHING = 3000, 3, (3, 4), 1 << 16, 3, 0.5
#: A sentence is in none of the languages if its mean log-probability is so many deviations below what its best one has.
REJECT = 6.0
#: Words of a passage; words from which on a sentence counts towards one; log-probability margin a short one needs.
PASSAGE_WORDS, SENTENCE_WORDS, CLEAR = 8, 5, 8.0
#: Characters scored together.
CHUNK = 1_000_000

SENTENCE_END = re.compile(r"(?<=[.!?…])[\s​]+|[\r\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: Scripts written without blanks; about two characters make a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
ENTITY = re.compile(r"&#?\w{1,8};")
BREAKS = re.compile(r"[;,:]")


def language_named(label: str | None) -> str | None:
    """The code of the language a label names, in any case, with or without a region; None for null, blank and unknown words.

    Any other two or three letters are a code of their own.
    """
    if label is None:
        return None
    first = re.split(r"[-_ ]", label.strip().lower(), maxsplit=1)[0]
    return CODE_OF.get(first) or (first if re.fullmatch("[a-z]{2,3}", first) and first not in UNKNOWN else None)


def code_of(label: Column) -> Column:
    """language_named as an expression."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^[^-_ ]*", 0)
    known = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(known, first), F.when(first.rlike("^[a-z]{2,3}$") & ~first.isin(*UNKNOWN), first))


def _letters() -> np.ndarray:
    out = np.zeros(0x3000, np.uint32)
    for i in range(len(out)):
        if chr(i).isalpha() or unicodedata.combining(chr(i)):
            out[i] = i
    return out


LETTERS = _letters()


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(slots of the n-grams of each order, start of each text). Slot 0: no n-gram here (it spans a gap or a text's end).

    An n-gram lies within a word and the marks of its ends. Every order has one slot for each character of the joined
    texts, so that texts are equal stretches in all of them.
    """
    joined = "\x00".join(texts) + "\x00"
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    c = np.where(raw < len(LETTERS), LETTERS[np.minimum(raw, len(LETTERS) - 1)], np.where(raw < 0x10000, raw, 0)).astype(np.uint64)
    wide = np.r_[c, np.zeros(max(ORDERS), np.uint64)]
    out = []
    for n in ORDERS:
        h = np.full(len(c), n, np.uint64)
        inner = np.ones(len(c), bool)
        for i in range(n):
            part = wide[i : i + len(c)]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            if 0 < i < n - 1:
                inner &= part != 0
        slots = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 16)).astype(np.int32)
        out.append(np.where(inner, np.maximum(slots, 1), 0))
    return out, np.cumsum(sizes) - sizes


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x SLOTS, slot 0 is 0
    usual: np.ndarray | None = None  # by language: mean, deviation of a sentence's mean and of one n-gram's log-probability

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text in each language, n-grams of each text); empty and letterless texts have 0 in all."""
        out, size_of = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
                size += len(texts[to]) + 1
                to += 1
            slots, starts = grams(texts[at:to])
            for k in range(len(self.languages)):
                row = self.logs[k]
                out[at:to, k] = sum(np.add.reduceat(row[s], starts, dtype=np.float64) for s in slots)
            size_of[at:to] = sum(np.add.reduceat(s > 0, starts, dtype=np.int64) for s in slots)
            at = to
        return out, size_of

    def strange(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Texts that are in none of the languages."""
        if self.usual is None or not len(scores):
            return np.zeros(len(scores), bool)
        mean, sd, one = self.usual[scores.argmax(1)].T
        n = np.maximum(size, 1)
        return (size > 0) & (scores.max(1) / n < mean - REJECT * np.sqrt(sd**2 + one**2 / n))


def counted(texts: list[str]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    return [grams(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]


def log_model(names: list[str], slots: list, label: np.ndarray, use: np.ndarray) -> Model:
    """Multinomial naive Bayes of the texts in use. What a class has not seen is equally unlikely in all of them, so that a small one gains nothing by it."""
    counts = np.zeros((len(names), SLOTS))
    for i, (orders, starts) in enumerate(slots):
        mine = np.where(use, label, -1)[i * 2000 : i * 2000 + len(starts)]
        owner = np.repeat(mine, np.diff(np.r_[starts, len(orders[0])]))
        for s in orders:
            counts += np.bincount((owner * SLOTS + s)[owner >= 0], minlength=len(names) * SLOTS).reshape(len(names), SLOTS)
    counts[:, 0] = 0
    size = counts.sum(1, keepdims=True)
    add = SMOOTHING * size / max(1.0, size.max())
    logs = np.log(np.maximum(counts + add, 1e-9)) - np.log(np.maximum(size + add * SLOTS, 1e-9))
    logs[size[:, 0] == 0] = -50.0
    logs[:, 0] = 0
    return Model(names, logs.astype(np.float32))


def fit(texts: list[str], labels: list[str], half: list[int] | None = None) -> Model:
    """Each half (0, 1: that of the text's document) is scored by a model of the other, so that no text confirms its own label."""
    names = sorted(set(labels))
    side = np.arange(len(texts)) % 2 if half is None else np.array(half)
    slots = counted(texts)
    label = np.array([names.index(x) for x in labels], np.int64)
    keep = np.ones(len(texts), bool)

    def other() -> tuple[np.ndarray, np.ndarray]:
        score, size = np.zeros((len(texts), len(names))), np.zeros(len(texts))
        for s in (0, 1):
            if (side == s).any():
                score[side == s], size[side == s] = log_model(names, slots, label, keep & (side != s)).scores([t for t, x in zip(texts, side) if x == s])
        return score, size

    for round_ in range(ROUNDS):
        score, size = other()
        verdict = score.argmax(1)
        if round_ == 0 and len(names) > 1:
            texts_of = np.bincount(label, minlength=len(names))
            real = np.zeros(len(names), bool)
            for k in range(len(names)):
                larger = (texts_of > texts_of[k]) | (texts_of == texts_of[k]) & (np.arange(len(names)) < k)
                mine = score[label == k]
                clear = mine[:, k] > mine[:, larger].max(1, initial=-np.inf) + CLEAR
                real[k] = texts_of[k] >= LEAST_TEXTS and len(set(side[label == k])) == 2 and clear.mean() >= 0.5
            if real.any():  # the labels of the other classes are no languages of their own
                score[:, ~real] = -np.inf
                verdict = score.argmax(1)
        if round_ < ROUNDS - 1:
            label = verdict
    model = log_model(names, slots, label, keep)
    mean = score[np.arange(len(texts)), label] / np.maximum(size, 1)
    usual = np.zeros((len(names), 3))
    for k in range(len(names)):
        m, n = mean[(label == k) & (size > 0)], size[(label == k) & (size > 0)]
        if len(m):
            middle = np.median(m)
            low = np.maximum(middle - m, 0)  # only what lies below counts, without the farthest, which may be in no language
            few = low <= np.quantile(low, 0.99)
            usual[k] = middle, np.sqrt(2 * np.mean(low[few] ** 2)), np.sqrt(2 * np.mean(n[few] * low[few] ** 2))
    used = np.bincount(label, minlength=len(names)) > 0
    return Model([x for x, u in zip(names, used) if u], model.logs[used], usual[used])


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, cleaned text, words) of the sentences and lines that may count towards a passage."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    kept = []
    for a, b in out:
        if b - a < 2 * SENTENCE_WORDS:
            continue
        s = text[a:b]
        if "&" in s:
            s = ENTITY.sub("'", s)
        n = len(WORD.findall(s))
        if not s.isascii() and (u := len(UNSPACED.findall(s))):
            n = max(n, u // 2)
        # fewer words than this, or a list of names and figures, is no prose
        if n >= SENTENCE_WORDS and len(BREAKS.findall(s)) <= 0.4 * n:
            kept.append((a, b, s.lower() if s.isascii() else unicodedata.normalize("NFC", s).lower(), n))
    return kept


def passages(found: list[tuple[int, int, int]], score: np.ndarray, strange: np.ndarray, none: int | None = None) -> list[tuple[int, float, int, int]]:
    """(language, confidence, start, end) in reading order, from (start, end, words) and scores of a text's sentences.

    Sentences of one language that follow each other are one run; a run of fewer than PASSAGE_WORDS words is left out, and
    runs of one language that then meet are one. A short sentence counts only if it is clear. Strange sentences are in no
    language: they are passed over, or their runs are of language `none`. Confidence: the logistic of the margin over the
    next language, per n-gram of an average word, at most 1.
    """
    runs: list[list] = []
    for (a, b, n), s, odd in zip(found, score, strange):
        k = int(s.argmax())
        if odd:
            if none is None or n < PASSAGE_WORDS:
                continue
            k = none
        margin = float(s.max() - np.partition(s, -2)[-2]) if len(s) > 1 else 100.0
        if odd:
            margin = 0.0
        if (s == 0).all() or (n < PASSAGE_WORDS and margin < CLEAR):
            continue
        if runs and runs[-1][0] == k:
            runs[-1] = [k, runs[-1][1] + margin, runs[-1][2] + n, runs[-1][3], b]
        else:
            runs.append([k, margin, n, a, b])
    out: list[list] = []
    for r in runs:
        if r[2] >= PASSAGE_WORDS:
            if out and out[-1][0] == r[0]:
                out[-1] = [r[0], out[-1][1] + r[1], out[-1][2] + r[2], out[-1][3], r[4]]
            else:
                out.append(r)
    return [(k, float(1 / (1 + np.exp(-min(50.0, m / n)))), a, b) for k, m, n, a, b in out]


def even_shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many of each to take so that `total` is shared evenly; small ones are taken whole. Names of more than `total` languages: the most frequent."""
    out, left, names = {}, total, sorted(counts, key=lambda c: (counts[c], c))[-total:]
    for i, c in enumerate(names):
        out[c] = min(counts[c], left // (len(names) - i))
        left -= out[c]
    return {c: n for c, n in out.items() if n > 0}


def fitted(documents: DataFrame, id_: str, text: str, lang: str) -> Model:
    """The model of a seeded sample of at most FIT_DOCUMENTS documents, evenly over the codes that labels name.

    The counts of the codes (at most all words of two or three letters) come to the driver; the documents are drawn by
    hash in the scan.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"), code_of(F.col(lang)).alias("code")).filter(F.length("text") > 2 * PASSAGE_WORDS)
    counts = {r["code"]: r["n"] for r in rows.filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).collect()}
    shares = even_shares(counts, FIT_DOCUMENTS)
    texts, labels, half, taken = [], [], [], dict.fromkeys(shares, 0)
    if shares:
        limit = F.try_element_at(F.create_map(*[F.lit(x) for c, n in shares.items() for x in (c, draw_limit(n, counts[c]))]), F.col("code"))
        for r in drawn(rows.filter(hash_of(["id", "text"]) <= limit), ["id", "text", "code"], ["id", "text"], 3 * FIT_DOCUMENTS):
            if taken[r["code"]] < shares[r["code"]]:
                taken[r["code"]] += 1
                for _, _, s, n in sentences(r["text"]):
                    if n >= PASSAGE_WORDS:
                        texts.append(s)
                        labels.append(r["code"])
                        half.append(taken[r["code"]] % 2)
    return fit(texts, labels, half) if texts else Model([], np.zeros((0, SLOTS), np.float32))


def language_passages(documents: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", unlisted: bool = False) -> DataFrame:
    """(id, seg_no, lang, confidence, start, end, n_passages, named) of every passage of every text; named: the code its label names.

    Null, empty, blank and letterless texts, and texts without a run of PASSAGE_WORDS words, have no rows. Sentences in
    none of the fitted languages are passed over; unlisted: their runs are passages of lang NONE (und).
    """
    model = fitted(documents, id_, text, lang)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["seg_no", "lang", "confidence", "start", "end", "n_passages", "named"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                units, texts, cuts = [], [], [0]
                for t in b.column(1).to_pylist():
                    s = sentences(t) if t and m.languages else []
                    units.append([(a, e, n) for a, e, _, n in s])
                    texts.extend(x for _, _, x, _ in s)
                    cuts.append(len(texts))
                score, size = m.scores(texts)
                strange, names_ = m.strange(score, size), [*m.languages, NONE]
                rows, columns = [], ([], [], [], [], [], [])
                for i, u in enumerate(units):
                    of = slice(cuts[i], cuts[i + 1])
                    found = passages(u, score[of], strange[of], len(m.languages) if unlisted else None)
                    for seg, (k, conf, a, e) in enumerate(found):
                        rows.append(i)
                        for c, v in zip(columns, (seg, names_[k], conf, a, e, len(found))):
                            c.append(v)
                label = b.column(2).to_pylist()
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([language_named(label[i]) for i in rows], pa.string())], [id_, *names]
                )

    kind = documents.schema[id_].dataType.simpleString()
    return documents.select(id_, text, lang).mapInArrow(run, f"`{id_}` {kind}, seg_no int, lang string, confidence double, start int, `end` int, n_passages int, named string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the documents in several languages, or in one that the label does not name."""
    found = language_passages(table(spark, sf_dir, "documents"))
    return found.filter((F.col("n_passages") > 1) | ~F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "seg_no", "lang")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage, those in none of the fitted languages among them."""
    return language_passages(table(spark, sf_dir, "documents"), unlisted=True).select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "start", "end")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its main language by covered characters, how many languages it has, and what its label names."""
    found = language_passages(table(spark, sf_dir, "documents"))
    by = found.groupBy("doc_id", "lang", "named").agg(F.sum(F.col("end") - F.col("start")).alias("size"), F.avg("confidence").alias("confidence"))
    return by.groupBy("doc_id").agg(F.max_by("lang", F.struct("size", "lang")).alias("lang"), F.round(F.max_by("confidence", F.struct("size", "lang")), 4).alias("confidence"), F.count("*").alias("n_languages"), F.first("named").alias("named"))


def p8_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one passage whose label names a language, by tenths of confidence: how many, mean confidence, share that the label agrees with."""
    one = language_passages(table(spark, sf_dir, "documents")).filter((F.col("n_passages") == 1) & F.col("named").isNotNull())
    bin_ = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).alias("tenth")
    return one.groupBy(bin_).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg((F.col("lang") == F.col("named")).cast("double")), 4).alias("agreed"))


QUERIES = {"p8_calibration": p8_calibration, "p8_found": p8_found, "p8_passages": p8_passages, "p8_documents": p8_documents}
ORACLES: dict[str, str] = {}
