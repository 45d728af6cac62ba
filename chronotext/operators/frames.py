"""Small relational operators of panels: unions, guards, key joins, cuts, masks, encodings, correlations, samples of fixed size."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.sampling import ranked

CUT_NAMES = ("Down", "Flat", "Up")


def union_named(*frames: DataFrame) -> DataFrame:
    """Rows of all frames below each other, columns matched by name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_known(*values: Column) -> Column:
    return F.coalesce(*values)


def guidance_spread(implied: Column, effective: Column) -> Column:
    return implied - effective


def scaled(df: DataFrame, part: str, divisor: float) -> DataFrame:
    """Columns whose name contains `part`, in any case, divided."""
    return df.withColumns({c: F.col(c) / divisor for c in df.columns if part.lower() in c.lower()})


def rescaled(df: DataFrame, prefix: str, end: float) -> DataFrame:
    """Columns of a prefix times end / 2: what a scale of -2 to 2 becomes."""
    return df.withColumns({c: F.col(c) * (end / 2) for c in df.columns if c.startswith(prefix)})


def products(df: DataFrame, pairs: Sequence[tuple[str, str]], name: str = "inter_{a}_x_{b}") -> DataFrame:
    """A product column for each pair of which both columns exist."""
    return df.withColumns({name.format(a=a, b=b): F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns})


def between_days(df: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    out = df if first is None else df.filter(F.col(day) >= F.lit(first).cast("date"))
    return out if last is None else out.filter(F.col(day) <= F.lit(last).cast("date"))


def without_prefixes(df: DataFrame, id_: str, prefixes: Sequence[str], size: int = 8) -> DataFrame:
    """Rows whose id does not begin with one of the prefixes; null ids stay."""
    return df.filter(~F.coalesce(F.substring(id_, 1, size).isin(*prefixes), F.lit(False)))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of which no column is null or blank."""
    ok = [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in columns]
    return df.filter(reduce(lambda a, b: a & b, ok))


def encoded(df: DataFrame, label: str, codes: Mapping[str, int], unknown: int | None = None, out: str = "label") -> DataFrame:
    """The code of each label as text; labels without a code are left out, or `unknown` if it is given."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    coded = df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(label).cast("string")), F.lit(unknown).cast("int")))
    return coded if unknown is not None else coded.filter(F.col(out).isNotNull())


def cut_counts(df: DataFrame, change: str, step: float = 0.001) -> DataFrame:
    """Rows of each of the three directions, 0 where there are none."""
    cut = F.when(F.col(change) <= -step, CUT_NAMES[0]).when(F.col(change) <= step, CUT_NAMES[1]).when(F.col(change).isNotNull(), CUT_NAMES[2])
    one = df.agg(*[F.count_if(cut == n).alias(n) for n in CUT_NAMES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("direction"), F.col(n).alias("n")) for n in CUT_NAMES])).alias("x")).select("x.*")


def join_by_month(left: DataFrame, right: DataFrame, left_day: str, right_day: str, payload: Sequence[str]) -> DataFrame:
    """left with the payload of the right side's last row of the same month; the partial maximum is taken before the exchange."""
    month = lambda c: F.date_trunc("month", F.col(c).cast("timestamp"))
    last = right.groupBy(month(right_day).alias("__m")).agg(F.max(F.struct(F.col(right_day), *payload)).alias("__r"))
    return left.withColumn("__m", month(left_day)).join(last, "__m", "left").select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in payload])


def join_by_index(left: DataFrame, right: DataFrame, index: str, how: str = "left") -> DataFrame:
    """Columns of both sides by a row id that both have; clashing columns of the right side get the ending _right."""
    names = {c: f"{c}_right" for c in right.columns if c != index and c in left.columns}
    return left.join(right.withColumnsRenamed(names), index, how)


def outer_all(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of all by one key; a column that an earlier frame has is dropped from later ones."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.drop(*[c for c in b.columns if c != key and c in a.columns]), key, "full_outer")

    return reduce(add, frames)


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has: no rows means that the sets agree."""
    ka, kb = a.select(key).dropna().distinct(), b.select(key).dropna().distinct()
    return ka.exceptAll(kb).withColumn("side", F.lit("left")).unionByName(kb.exceptAll(ka).withColumn("side", F.lit("right")))


def argmax_row(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The row of the largest value of each group, the first by the other columns of equals; null values never win."""
    rest = [c for c in df.columns if c != value and c not in by]
    best = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.max(F.struct(value, *rest)).alias("__x"))
    return best.select(*by, *[F.col(f"__x.{c}").alias(c) for c in (value, *rest)]).select(*df.columns) if by else best.filter(F.col("__x").isNotNull()).select(*[F.col(f"__x.{c}").alias(c) for c in df.columns])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r, n) of all pairs of columns, each over the rows that have both, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    one = df.agg(*[F.struct(F.corr(F.col(a) * both(a, b), F.col(b) * both(a, b)).alias("r"), F.count(both(a, b)).alias("n")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}.r").alias("r"), F.col(f"c{i}.n").alias("n")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of the key; each task keeps its n smallest before they meet."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def stratified_seed(df: DataFrame, by: str, key: str, total: int, least: int = 2, seed: int = 42) -> DataFrame:
    """Each stratum's share of `total` rounded down, at least `least` where there are so many; then cut to `total` by hash."""
    out = ranked(df, [by], key, seed).crossJoin(F.broadcast(df.agg(F.count("*").alias("__all"))))
    quota = F.greatest(F.lit(least), F.floor(F.lit(total) * F.col("size") / F.col("__all")))
    return fixed_sample(out.filter(F.col("rank") < quota).select(*df.columns), key, total, seed + 1)


def column_parts(name: str) -> tuple[str, str] | None:
    """('GDP', 'T+2') of 'GDP(T+2)'."""
    m = re.fullmatch(r"\s*([^()]+?)\s*\(\s*(T(?:[+-]\d+)?)\s*\)\s*", name)
    return (m[1], m[2]) if m else None


def settled(df: DataFrame, order: str, value: str, drop: float = 0.05) -> DataFrame:
    """df with `converged`: the value fell by less than `drop` since the row before. One row a round of labelling."""
    return df.withColumn("converged", F.coalesce(F.lag(value).over(Window.orderBy(order)) - F.col(value) < drop, F.lit(False)))


def stable_id(*parts: Column) -> Column:
    """An id that depends on the content alone, so that a second run gives the same one."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


MASKS = {
    "flag_above_median": lambda c, median: c > median, "flag_positive": lambda c, median: c > 0, "flag_one": lambda c, median: c == 1, "flag_zero": lambda c, median: c == 0,
    "rising": lambda c, median: c > 0.001, "falling": lambda c, median: c < -0.001,
}


def masked_counts(df: DataFrame, columns: Sequence[str], names: Sequence[str] = tuple(MASKS)) -> DataFrame:
    """(column, mask, n): rows of each mask; the median of a column is exact and null rows are in no mask."""
    medians = df.agg(*[F.median(c).alias(f"__{c}") for c in columns])
    both = df.crossJoin(F.broadcast(medians))
    one = both.agg(*[F.count_if(MASKS[m](F.col(c), F.col(f"__{c}"))).alias(f"{c}|{m}") for c in columns for m in names])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("mask"), F.col(f"`{c}|{m}`").alias("n")) for c in columns for m in names]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
