"""Splits that keep related records together (problem 2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.dates import any_date
from chronotext.llm.common import permuted_position
from chronotext.llm.components import components
from chronotext.session import cut_lineage, table

SEED = 42
#: Longest table of reachable totals on the driver; beyond, sizes are rounded to a unit and the rest is made up by true size.
MOST_CELLS = 1 << 26


def document_name(source: Column) -> Column:
    """What a source names: outer blanks, a query or fragment, folders and one known ending dropped; letters and digits of the rest."""
    s = F.regexp_replace(source, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"(?s)[?#].*$", "")
    s = F.regexp_replace(s, r"(?s)^.*[/\\]", "")
    s = F.regexp_replace(s, r"(?i)\.(html|htm|pdf|json|txt)$", "")
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def tied(rows: DataFrame, id_: str, source: str, board: str, date: str) -> DataFrame:
    """rows with `__doc` and `__day`, the nodes a record touches: the document its source names, its board on its date."""
    day = any_date(F.col(date))
    return rows.withColumn("__doc", F.concat(F.lit("doc:"), document_name(F.col(source)))).withColumn(
        "__day", F.when(F.col(board).isNotNull() & day.isNotNull(), F.concat(F.lit("day:"), F.date_format(day, "yyyyMMdd"), F.lit("|"), F.col(board)))
    )


def node_components(nodes: DataFrame) -> DataFrame:
    """(node, component) from rows of (__doc, __day): an edge where a record touches both."""
    return components(nodes.select(F.col("__doc").alias("u"), F.col("__day").alias("v")).dropna().distinct())


def with_component(rows: DataFrame, id_: str, source: str, board: str, date: str) -> DataFrame:
    """rows with `component`. Records that nothing ties are their own component by id; those without an id and a tie share one."""
    nodes = tied(rows, id_, source, board, date)
    found = node_components(nodes)
    node = F.coalesce("__doc", "__day", F.concat(F.lit("id:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))))
    placed = nodes.withColumn("__node", node).join(found.withColumnsRenamed({"node": "__node", "component": "__root"}), "__node", "left")
    return placed.withColumn("component", F.coalesce("__root", "__node")).drop("__doc", "__day", "__node", "__root")


def closest(sizes: dict[int, int], target: float) -> dict[int, int]:
    """How many components of each size to take so that their total is closest to `target`.

    The reachable totals are a packed bitset to which each size is added in powers of two of its multiplicity; for each
    total the item that first reached it is kept, which gives the choice back. Exact up to MOST_CELLS; beyond that the
    sizes of a unit and more are chosen in units, and components are given back or added by their true size until the
    rest is smaller than the smallest component left.
    """
    whole = sum(s * c for s, c in sizes.items())
    reach = min(whole, int(target + min(max(sizes, default=0), target + 1)))
    unit = max(1, -(-reach // MOST_CELLS))
    items = []
    for s in sorted(sizes, reverse=True):
        left, k = sizes[s] if s >= unit else 0, 1
        while left > 0:
            items.append((s, min(k, left), round(s / unit) * min(k, left)))
            left -= k
            k *= 2
    top = reach // unit
    first = np.full(top + 1, -1, np.int32)
    ok, cells = 1, (1 << (top + 1)) - 1
    nearest = min(top, round(target / unit))
    for i, (_, _, w) in enumerate(items):
        if 0 < w <= top and not ok >> nearest & 1:
            both = (ok | ok << w) & cells
            new = np.frombuffer((both ^ ok).to_bytes(top // 8 + 1, "little"), np.uint8)
            for begin in range(0, len(new), 1 << 20):  # a slice at a time, for the driver's memory
                at = begin + np.flatnonzero(new[begin : begin + (1 << 20)])
                bits = np.flatnonzero(np.unpackbits(new[at], bitorder="little"))
                first[at[bits >> 3] * 8 + (bits & 7)] = i
            ok = both
    mark = min(top, int(target // unit))
    below, above = (ok & ((1 << (mark + 1)) - 1)).bit_length() - 1, ok >> (mark + 1)
    ends = [below, *([mark + (above & -above).bit_length()] if above else [])]
    at = min(ends, key=lambda x: abs(x * unit - target))
    taken: dict[int, int] = {}
    while at > 0:
        s, k, w = items[first[at]]
        taken[s] = taken.get(s, 0) + k
        at -= w
    if unit == 1:
        return taken
    rest = target - sum(s * c for s, c in taken.items())
    for s in sorted(taken, reverse=True):  # give back
        k = min(taken[s], int(max(0, -rest) // s))
        taken[s] -= k
        rest += k * s
    back = min((s for s, c in taken.items() if c), default=0)
    if rest < 0 and abs(rest + back) < -rest:
        taken[back] -= 1
        rest += back
    for s in sorted(sizes, reverse=True):  # add
        k = min(sizes[s] - taken.get(s, 0), int(max(0, rest) // s))
        taken[s] = taken.get(s, 0) + k
        rest -= k * s
    return taken


def split_counts(sizes: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """Components of each size for each split: small shares are chosen first, the largest share takes what is left."""
    whole, left, out = sum(s * c for s, c in sizes.items()), dict(sizes), {}
    names = sorted(shares, key=lambda n: (shares[n], n))
    for name in names[:-1]:
        out[name] = closest({s: c for s, c in left.items() if c > 0}, shares[name] * whole)
        for s, c in out[name].items():
            left[s] -= c
    if names:
        out[names[-1]] = {s: c for s, c in left.items() if c > 0}
    return out


def grouped_splits(rows: DataFrame, shares: dict[str, float], id_: str = "id", source: str = "source", board: str = "board", date: str = "date", seed: int = SEED) -> DataFrame:
    """rows with `component` and `new_split`; all rows of a component are in one split, the shares as close as sizes allow.

    Only the histogram of component sizes comes to the driver (at most sqrt(2 n) entries for n rows). Which components of
    a size go where follows a seeded order. No shares, or an empty table: new_split is null.
    """
    placed = with_component(rows, id_, source, board, date)
    sizes = cut_lineage(placed.groupBy("component").agg(F.count("*").alias("size")))
    histogram = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    chosen = split_counts(histogram, shares)
    spark, ranges, begin = rows.sparkSession, [], {}
    for name in sorted(chosen):
        for s, c in sorted(chosen[name].items()):
            ranges.append((s, begin.get(s, 0), begin.get(s, 0) + c, name))
            begin[s] = begin.get(s, 0) + c
    by_size = spark.createDataFrame(ranges, "size long, low long, high long, new_split string")
    ranked = permuted_position(sizes, ["size"], ["component"], seed)
    assigned = ranked.join(by_size, "size", "left").filter(F.col("low").isNull() | ((F.col("before") >= F.col("low")) & (F.col("before") < F.col("high")))).select("component", "new_split")
    return placed.join(assigned, "component")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of source values in tied records. Distinct (source, node) come first, so a hot source is one row."""
    nodes = tied(table(spark, sf_dir, "annotations").select("id", "source", "board", "date"), "id", "source", "board", "date")
    few = cut_lineage(nodes.select("source", "__doc", "__day").distinct())
    found = node_components(few)
    named = few.filter(F.col("source").isNotNull()).select("source", "__doc").distinct().join(found.withColumnRenamed("node", "__doc"), "__doc", "left").select("source", F.coalesce("component", "__doc").alias("component"))
    a, b = named.withColumnRenamed("source", "source_a"), named.withColumnRenamed("source", "source_b")
    return a.join(b, "component").filter(F.col("source_a") < F.col("source_b")).select("source_a", "source_b")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {r["split_name"]: r["share"] for r in table(spark, sf_dir, "split_targets").collect()}
    return grouped_splits(table(spark, sf_dir, "annotations").select("id", "source", "board", "date"), shares)


def p2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("id", "component", "new_split").distinct()


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: rows, share reached, share asked for."""
    got = _split(spark, sf_dir).groupBy("new_split").agg(F.count("*").alias("n_rows"), F.count_distinct("component").alias("n_components"))
    whole = got.agg(F.sum("n_rows").alias("whole"))
    wanted = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("new_split"), "share")
    return wanted.join(got, "new_split", "left").join(F.broadcast(whole)).select("new_split", "n_rows", "n_components", F.round(F.col("n_rows") / F.col("whole"), 6).alias("reached"), "share")


QUERIES = {"p2_found": p2_found, "p2_assignment": p2_assignment, "p2_shares": p2_shares}
_NAME = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '^\s+|\s+$', '', 'g'), '(?s)[?#].*$', ''), '(?s)^.*[/\\]', ''), '(?i)\.(html|htm|pdf|json|txt)$', ''), '[^A-Za-z0-9]', '', 'g'))"""
ORACLES = {
    "p2_found": rf"""WITH RECURSIVE r AS (
  SELECT DISTINCT source, 'doc:' || {_NAME} AS d, 'day:' || board || '|' || strftime(CASE
    WHEN regexp_full_match(trim(date), '\d{{8}}') THEN try_strptime(trim(date), '%Y%m%d')
    WHEN regexp_matches(trim(date), '^\d{{4}}-\d\d-\d\d') THEN try_strptime(left(trim(date), 10), '%Y-%m-%d')
    ELSE try_strptime(trim(date), '%B %d, %Y') END, '%Y%m%d') AS b FROM annotations),
e AS (SELECT DISTINCT d AS u, b AS v FROM r WHERE d IS NOT NULL AND b IS NOT NULL),
ee AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT d AS n, d AS m FROM r WHERE d IS NOT NULL UNION SELECT reach.n, ee.v FROM reach JOIN ee ON ee.u = reach.m),
comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
s AS (SELECT DISTINCT source, c FROM r JOIN comp ON comp.n = r.d WHERE source IS NOT NULL)
SELECT a.source AS source_a, b.source AS source_b FROM s a JOIN s b ON a.c = b.c AND a.source < b.source""",
}
