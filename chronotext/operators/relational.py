"""Projections, label maps, masks and aggregates of the label and panel layers, as Column builders and lazy plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentiment scale, both spellings of its ends, and the long names of the label fields.
SCALE = {"strongly_dovish": -2, "dovish": -1, "neutral": 0, "hawkish": 1, "strongly_hawkish": 2}
SCALE_ALIASES = {"very dovish": -2, "very hawkish": 2}
LONG_NAMES = {"top": "topic", "ten": "tense", "sen": "sentiment", "hor": "horizon", "com": "commitment", "ris": "risk", "wid": "width"}
EXCLUDED_TOPICS = ["no_topic", "boilerplate"]


def mapped(value: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """The number of a trimmed, lower-cased name; numbers pass through; anything else is the default."""
    m = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(value.cast("string")))), value.cast("string").try_cast("double"), F.lit(default).cast("double"))


def sentiment(value: Column, aliases: bool = True) -> Column:
    return mapped(value, SCALE | (SCALE_ALIASES if aliases else {}), 0.0)


def columns_with(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def contains_text(value: Column, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(value), F.lit(part.lower())), F.lit(False))


def effective_rate(rate: Column, shadow: Column, floor: float = 0.25) -> Column:
    """The shadow rate at the lower bound where there is one."""
    return F.when((rate <= floor) & shadow.isNotNull(), shadow).otherwise(rate)


def decision(change: Column, step: float = 0.01) -> Column:
    return F.when(change > step, 1).when(change < -step, -1).otherwise(0)


def cut3(change: Column, step: float = 0.001) -> Column:
    return F.when(change <= -step, "Down").when(change <= step, "Flat").when(change.isNotNull(), "Up")


def rescaled_ends(value: Column, end: float) -> Column:
    return F.when(F.abs(value) == 2, F.signum(value) * end).otherwise(value)


def signed_power(value: Column, p: float = 1.1) -> Column:
    return F.signum(value) * F.pow(F.abs(value), F.lit(p))


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def topical(top: Column, excluded: Sequence[str] = tuple(EXCLUDED_TOPICS)) -> Column:
    """A row counts if it has a topic that is not excluded; empty and null lists do not."""
    return F.coalesce(F.size(F.array_except(top, F.array(*map(F.lit, excluded)))) > 0, F.lit(False))


def clean_topics(top: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(top, F.array().cast("array<string>")), lambda x: F.replace(F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))), lambda x: x != "")))


def document_aggregate(rows: DataFrame, keys: Sequence[str], score: str, top: str, topics: Sequence[str], transform=None) -> DataFrame:
    """Per document: total, per-topic sums (0 where none), sample deviation and variance, flags and counts, in one aggregate."""
    s = F.col(score) if transform is None else transform(F.col(score))
    by_topic = [F.coalesce(F.sum(F.when(F.array_contains(top, t), s)), F.lit(0.0)).alias(f"sent_{t}") for t in topics]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_sentences"), F.coalesce(F.sum(s), F.lit(0.0)).alias("sent_total"), *by_topic, F.stddev_samp(s).alias("sent_sd"), F.var_samp(s).alias("sent_var"),
        F.count_if(s > 0).alias("n_hawkish"), F.count_if(s < 0).alias("n_dovish"), F.coalesce(F.bool_or(F.abs(s) == 2), F.lit(False)).alias("flag_extreme"),
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, n, low, high, q0, q1, ..): exact quantiles by linear interpolation between the two closest rows; nulls are left out.

    Sketches first bracket each quantile; then one more aggregate counts what lies below the bracket and gathers only the
    values within it, some 8 / accuracy of a group, so that no task holds a large group. Ties at the ends of a bracket are
    counted. Groups of at most 5 * accuracy rows, where a bracket is few rows, are sorted whole; both ways are exact.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    e, small = 4.0 / accuracy, 5 * accuracy
    around = [min(1.0, max(0.0, p + d)) for p in shares for d in (-e, e)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"), F.percentile_approx("__x", F.array(*map(F.lit, around)), accuracy).alias("__b"))
    names = {c: f"__k{i}" for i, c in enumerate(keys)}
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    x, aggregates = F.col("__x"), []
    for i, _ in enumerate(shares):
        a, b = F.col("__b")[2 * i], F.col("__b")[2 * i + 1]
        aggregates += [F.percentile(F.when(F.col("n") <= small, x), F.lit(shares[i])).alias(f"__p{i}"), F.count_if(x < a).alias(f"__below{i}"), F.collect_list(F.when((x > a) & (x < b), x)).alias(f"__in{i}"), F.count_if(x == a).alias(f"__a{i}"), F.count_if((x == b) & (b > a)).alias(f"__z{i}"), F.first(a).alias(f"__va{i}"), F.first(b).alias(f"__vb{i}")]
    whole = rows.join(sketch.withColumnsRenamed(names), same).groupBy(*keys).agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), *aggregates)

    def at(i: int, place: Column) -> Column:
        """The value at a place (from 0) of the sorted group."""
        k = (place - F.col(f"__below{i}")).cast("int")
        inner, first = F.sort_array(f"__in{i}"), F.col(f"__a{i}").cast("int")
        return F.when(k < first, F.col(f"__va{i}")).when(k < first + F.size(inner), F.get(inner, k - first)).otherwise(F.col(f"__vb{i}"))

    out = {}
    for i, p in enumerate(shares):
        place = F.lit(p) * (F.col("n") - 1)
        low, high = at(i, F.floor(place)), at(i, F.ceil(place))
        out[f"q{i}"] = F.when(F.col("n") <= small, F.col(f"__p{i}")).otherwise(low + (high - low) * (place - F.floor(place)))
    return whole.select(*keys, "n", "low", "high", *[c.alias(k) for k, c in out.items()])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact quartiles by linear interpolation, range, IQR, Bowley skew and tail asymmetry."""
    q = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75, 0.99)).select(*keys, "low", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), "high", F.col("q3").alias("p99"))
    return q.withColumns({
        "iqr": F.col("p75") - F.col("p25"), "full_spread": F.col("high") - F.col("low"),
        "bowley": F.try_divide(F.col("p75") + F.col("p25") - 2 * F.col("median"), F.nullif(F.col("p75") - F.col("p25"), F.lit(0.0))),
        "tail_asymmetry": (F.col("high") - F.col("median")) - (F.col("median") - F.col("low")),
    })


def label_metrics(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over the union of true and predicted labels; 0 where undefined. One shuffle of label counts."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)
    rows = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), hit.alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("n") - hit).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), (F.col("n") - hit).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    m = rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    m = m.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def set_scores(truth: Column, predicted: Column) -> dict[str, Column]:
    """Exact match and Jaccard of two label sets; two empty sets agree."""
    union = F.size(F.array_union(truth, predicted))
    return {"exact": (F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(predicted))).cast("int"), "jaccard": F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(truth, predicted)) / union)}


def entropy(p: Column) -> Column:
    """Nats of an array of probabilities, zeros left out."""
    return -F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log(x))


def margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return 1 - (F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)))


def uncertainty(p: Column, strategy: str) -> Column:
    if strategy == "entropy":
        return entropy(p)
    if strategy == "margin":
        return margin(p)
    if strategy == "least_confidence":
        return 1 - F.array_max(p)
    raise ValueError(f"no such strategy: {strategy}")


def reliability(df: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy of equal half-open bins; a probability of 1 is in none."""
    return df.filter(F.col(p) < 1).groupBy(F.floor(F.col(p) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(hit).cast("double")).alias("accuracy"))


def sample_per_group(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in a seeded order of `key`; only the n smallest of each task's rows are kept per group before the exchange."""
    from pyspark.sql import Window

    h = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    return h.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key))).filter(F.col("__n") <= n).drop("__n", "__h")


def largest_remainder(counts: Mapping[str, int], total: int, least: int = 0) -> dict[str, int]:
    """`total` shared in proportion to counts, none below min(least, count), whole numbers by largest remainder."""
    whole = sum(counts.values()) or 1
    exact = {k: total * c / whole for k, c in counts.items()}
    out = {k: min(counts[k], max(least, int(x))) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k)):
        if sum(out.values()) >= total:
            break
        out[k] = min(counts[k], out[k] + 1)
    return out


def hashed_split(key: Column, shares: Sequence[tuple[str, float]], seed: int = 42) -> Column:
    """A split by a seeded hash of the key alone: no shuffle, stable as data grows, shares met in expectation."""
    u, low, out = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000, 0.0, None
    for name, share in shares:
        low += share
        out = F.when(u < low, name) if out is None else out.when(u < low, name)
    return out.otherwise(shares[-1][0])
