"""Selections from a long table of vintages: which are needed, how periods were revised, what was known on a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.known_at import for_every_entity
from chronotext.operators.temporal import asof


def needed(days: DataFrame, obs: DataFrame, day: str, by: Sequence[str], vintage: str) -> DataFrame:
    """(by, vintage, n_days): the nearest vintage at or before each day and the next one after it, for each entity.

    Days are asked for every entity; a day before the first vintage needs only the next, one after the last only the last.
    """
    known = obs.select(*by, vintage).dropna().distinct()
    asked = for_every_entity(known.select(*by).distinct(), days.select(day).dropna().distinct())
    before = asof(asked, known, by, day, vintage, [vintage])
    after = asof(asked, known, by, day, vintage, [vintage], "forward", exact=False)
    both = before.select(*by, F.col(f"known_{vintage}").alias(vintage)).unionByName(after.select(*by, F.col(f"known_{vintage}").alias(vintage)))
    return both.filter(F.col(vintage).isNotNull()).groupBy(*by, vintage).agg(F.count("*").alias("n_days"))


def revisions(obs: DataFrame, period: Sequence[str], vintage: str, value: str, tie: str | None = None) -> DataFrame:
    """(period, first, last, revised): first and last published value; one partial aggregate. Null values were not published."""
    at = F.struct(vintage, *([tie] if tie else []))
    out = obs.filter(F.col(value).isNotNull() & F.col(vintage).isNotNull()).groupBy(*period).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return out.withColumn("revised", F.col("first") != F.col("last"))


def snapshot(obs: DataFrame, by: Sequence[str], period: str, vintage: str, value: str, day: str, most: int = 24, tie: str | None = None) -> DataFrame:
    """(by, period, value) of the latest `most` periods up to a day, by the last vintage of that day."""
    use = obs.filter((F.col(vintage) <= F.lit(day).cast("date")) & (F.col(period) <= F.lit(day).cast("date")) & F.col(value).isNotNull())
    known = use.groupBy(*by, period).agg(F.max_by(value, F.struct(vintage, *([tie] if tie else []))).alias(value))
    return known.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(period).desc()))).filter(F.col("__n") <= most).drop("__n")
