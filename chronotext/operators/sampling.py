"""Seeded samples and splits by stratum. The order is a hash, so results are the same on any cluster; no random state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.relational import largest_remainder
from chronotext.session import shuffle_partitions

#: Slices of a stratum: at least so many, and so many for each shuffle partition.
SLICES, PER_PARTITION = 256, 8


def ranked(df: DataFrame, by: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """df with `rank` (from 0) and `size` within its stratum in a seeded order; strata are cut into slices of the hash."""
    slices = max(SLICES, PER_PARTITION * shuffle_partitions(df.sparkSession))
    h = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__s", F.pmod(F.shiftrightunsigned("__h", 32), F.lit(slices)))
    w = Window.partitionBy(*by)
    counts = h.groupBy(*by, "__s").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("__n").over(w)).drop("__n")
    right = counts.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(by)], F.col("__s").alias("__rs"), "__before", "size")
    same = F.col("__s") == F.col("__rs")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h", key)) - 1
    return h.withColumn("__i", inside).join(right, same).withColumn("rank", F.col("__before") + F.col("__i")).select(*df.columns, "rank", "size")


def stratified_split(df: DataFrame, by: Sequence[str], key: str, shares: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Each stratum cut at its cumulated shares; the last split takes the rest."""
    low, out = 0.0, None
    for name, share in shares[:-1]:
        low += share
        cut = F.col("rank") < F.round(F.col("size") * low)
        out = F.when(cut, name) if out is None else out.when(cut, name)
    return ranked(df, by, key, seed).withColumn("split", out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])).drop("rank", "size")


def proportional(df: DataFrame, by: str, key: str, total: int, least: int = 1, seed: int = 42) -> DataFrame:
    """`total` rows over the values of one column by largest remainder, `least` of each where there are so many.

    The counts of the values come to the driver; use it on a label or a type, not on a free text.
    """
    counts = {r[by]: r["n"] for r in df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).collect()}
    quota = df.sparkSession.createDataFrame(list(largest_remainder(counts, total, least).items()), f"`{by}` string, __q long")
    return ranked(df, [by], key, seed).join(quota, by).filter(F.col("rank") < F.col("__q")).select(*df.columns)


def replenish(kept: DataFrame, pool: DataFrame, by: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """Rows of the pool (not kept yet) that bring each value of `by` among the kept up to `target`."""
    have = kept.groupBy(by).agg(F.count("*").alias("__have"))
    left = ranked(pool.join(kept.select(key), key, "left_anti"), [by], key, seed).join(have, by, "left")
    return left.filter(F.col("rank") < target - F.coalesce("__have", F.lit(0))).select(*pool.columns)


def uncertain_round(pool: DataFrame, labelled: DataFrame, key: str, score: str, crisis: str, n: int, most_crisis: int = 10) -> DataFrame:
    """One round of active learning: of the pool without what is labelled, the most uncertain records, at most `most_crisis`
    of the crisis stratum first and of the others as many as make `n`. Ties go to the smaller key; null scores are never taken."""
    open_ = pool.filter(F.col(score).isNotNull()).join(labelled.select(key).dropna().distinct(), key, "left_anti")
    best = lambda rows, k: rows.orderBy(F.col(score).desc(), key).limit(k)
    first = best(open_.filter(F.col(crisis)), most_crisis)
    rest = best(open_.filter(~F.coalesce(F.col(crisis), F.lit(False))), n)
    order = Window.orderBy(F.col("__c").desc(), F.col(score).desc(), key)  # at most n + most_crisis rows
    both = first.withColumn("__c", F.lit(1)).unionByName(rest.withColumn("__c", F.lit(0)))
    return both.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n", "__c")


def top_up(counts: Mapping[str, int], candidates: Sequence[tuple[str, Sequence[str]]], least: int = 15) -> list[str]:
    """Ids of candidates (id, labels), taken in order while one of their labels is below `least`; counts move as they are taken.

    Inherently sequential; for a labelled set of a few hundred, on the driver.
    """
    now, out = dict(counts), []
    for id_, labels in candidates:
        if any(now.get(x, 0) < least for x in labels):
            out.append(id_)
            for x in labels:
                now[x] = now.get(x, 0) + 1
    return out


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks of ties, rows with a null left out. Ranks are counted from value totals, not sorted rows."""
    use = df.dropna(subset=[a, b])

    def ranks(c: str) -> DataFrame:
        n = use.groupBy(*by, c).agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.select(*by, c, (before + (F.col("__n") + 1) / 2).alias(f"__rank_{c}"))

    return use.join(ranks(a), [*by, a]).join(ranks(b), [*by, b]).groupBy(*by).agg(F.corr(f"__rank_{a}", f"__rank_{b}").alias("spearman"), F.count("*").alias("n"))
