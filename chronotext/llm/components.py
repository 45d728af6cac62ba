"""Connected components by parallel hooking and shortcutting over a table of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.session import cut_lineage

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (u, v); component is the smallest node that edges reach.

    Each round hooks the parent of every node, and the node itself, to the smallest grandparent among its neighbours,
    and shortcuts every node to its grandparent. The number of rounds grows as the logarithm of the longest path. Each
    round is one join and one map-side combined minimum, and ends in the shared checkpoint folder. Null ends are left
    out; loops and repeated edges change nothing.
    """
    kept = edges.select("u", "v").dropna()
    both = cut_lineage(kept.union(kept.select("v", "u")).distinct())
    parents = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p")))
    for _ in range(MOST_ROUNDS):
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("g"))
        grand = parents.join(up, "p").select("node", "p", "g")
        near = both.join(grand.select(F.col("node").alias("v"), F.col("g")), "v").groupBy("u").agg(F.min("g").alias("m"))
        hooks = near.join(grand.select(F.col("node").alias("u"), "p", "g"), "u")
        offers = hooks.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.least("m", "g").alias("x")), F.struct(F.col("p").alias("node"), F.least("m", "g").alias("x")))).alias("o"))
        after = cut_lineage(offers.select("o.*").groupBy("node").agg(F.min("x").alias("p")))
        moved = after.join(parents.withColumnRenamed("p", "old"), "node").filter(F.col("p") != F.col("old")).limit(1).count()
        parents = after
        if not moved:
            return parents.withColumnRenamed("p", "component")
    raise RuntimeError(f"components: no end after {MOST_ROUNDS} rounds")
