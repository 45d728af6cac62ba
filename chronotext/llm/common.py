"""Orders and running sums within groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chronotext.session import shuffle_partitions

#: Slices of an order: at least so many, and so many for each shuffle partition.
SLICES, PER_PARTITION = 512, 8
DRAW_SEED = 7


def hash_of(by: Sequence[str], seed: int = DRAW_SEED) -> Column:
    """63 bits that order rows for a draw."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 1)


def draw_limit(most: int, total: int) -> int:
    """The hash below which about `most` of `total` rows lie, with slack, so that a draw rarely has fewer."""
    return (1 << 63) - 1 if total <= 2 * most else min((1 << 63) - 1, int((most + 6 * math.sqrt(most) + 16) / total * (1 << 63)))


def drawn(few: DataFrame, columns: Sequence[str], by: Sequence[str], most: int) -> list[Row]:
    """At most `most` different rows of `few`, in the order of a seeded hash of `by`.

    few: rows that were let through by draw_limit in the scan. So about `most` rows come to the driver in all, whatever
    the number of tasks; repeated rows are one before they leave their task.
    """
    named = few.select(hash_of(by).alias("__h"), F.struct(*columns).alias("__r"))
    return [r["r"] for r in named.groupBy("__h").agg(F.min("__r").alias("r")).orderBy("__h").limit(most).collect()]


def permuted_position(df: DataFrame, group: Sequence[str], key: Sequence[str], seed: int, weight: Column | None = None) -> DataFrame:
    """`df` with `before`: the sum of `weight` (1 if none) over the rows of the group that come earlier in a seeded order.

    The order is that of a seeded hash of `key`. A group is cut into slices of the order, more of them the more partitions
    the job has, so that no task holds more than a slice; the sums of the slices give where each slice begins. Null groups
    are groups of their own. Rows of equal key get distinct positions.
    """
    group, weight = list(group), F.lit(1) if weight is None else weight
    slices = max(SLICES, PER_PARTITION * shuffle_partitions(df.sparkSession))
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).withColumn("__slice", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(slices))).withColumn("__w", weight.cast("bigint"))
    nulls = {g: f"__g{i}" for i, g in enumerate(group)}
    totals = hashed.groupBy(*group, "__slice").agg(F.sum("__w").alias("__total"))
    begins = totals.select(
        *[F.col(g).alias(n) for g, n in nulls.items()], F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__total").over(Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__begin"),
    )
    same = F.col("__slice") == F.col("__s")
    for g, n in nulls.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    inside = F.coalesce(F.sum("__w").over(Window.partitionBy(*group, "__slice").orderBy("__h", *key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hashed.withColumn("__inside", inside).join(begins, same).withColumn("before", F.col("__begin") + F.col("__inside")).select(*df.columns, "before")
