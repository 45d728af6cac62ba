"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import permuted_position
from chronotext.llm.tokenizing import token_counts
from chronotext.session import cut_lineage, table

SEED = 42


def source_name(column: str):
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def sized(documents: DataFrame, targets: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, text_key, tokens) of the documents with a text whose source has a target. Null and empty texts have no size."""
    names = targets.select(source_name("source").alias("source")).dropna().distinct()
    kept = documents.select(F.col(id_).alias("id"), source_name(source).alias("source"), F.col(text).alias("text")).filter(F.length("text") > 0).join(names, "source", "left_semi")
    return token_counts(kept.withColumn("text_key", F.sha2("text", 256)), ["id", "source", "text_key"], "text")


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    return {r["source"]: (r["weight"], int(r["max_repeats"])) for r in targets.select(source_name("source").alias("source"), "weight", "max_repeats").dropna().collect()}


def cheapest_flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], int, str], int]:
    """Tokens routed from (pattern, use) to source: as many as the quotas take, at the least cost.

    The n-th use of a pattern's documents costs n - 1 a token, so repetition is convex; it may go to a source only if the
    source allows n uses. Successive shortest paths on a graph of (patterns x uses + sources) nodes; ties take the
    first pattern and source by name.
    """
    graph: list[list[int]] = []
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def edge(a: int, b: int, r: int, c: int) -> int:
        for x, y, q, k in ((a, b, r, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(q)
            cost.append(k)
        return len(to) - 2

    begin, end = node(), node()
    sinks = {s: node() for s in sorted(quotas)}
    for s, n in sinks.items():
        edge(n, end, quotas[s], 0)
    arcs = {}
    for p in sorted(patterns):
        for use in range(1, max(repeats[s] for s in p) + 1):
            n = node()
            edge(begin, n, patterns[p], use - 1)
            for s in p:
                if use <= repeats[s]:
                    arcs[p, use, s] = edge(n, sinks[s], patterns[p], 0)
    while True:
        dist, via = [None] * len(graph), [-1] * len(graph)
        dist[begin] = 0
        queue, waiting = deque([begin]), [False] * len(graph)
        while queue:
            a = queue.popleft()
            waiting[a] = False
            for e in graph[a]:
                if room[e] > 0 and (dist[to[e]] is None or dist[a] + cost[e] < dist[to[e]]):
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if not waiting[to[e]]:
                        queue.append(to[e])
                        waiting[to[e]] = True
        if dist[end] is None:
            break
        path, at = [], end
        while at != begin:
            path.append(via[at])
            at = to[via[at] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    return {k: room[e ^ 1] for k, e in arcs.items() if room[e ^ 1] > 0}


def quota_of(weight: float, whole: int) -> int:
    """The fewest whole tokens that reach the weight."""
    return math.ceil(weight * whole)


@dataclass
class Mix:
    """rows: id, source, copies, tokens. size, routed: tokens by source, of its documents and through the flow. whole: tokens of all documents."""

    rows: DataFrame
    size: dict[str, int]
    routed: dict[str, int]
    whole: int


def mix_of(documents: DataFrame, targets: DataFrame, seed: int = SEED, **columns: str) -> Mix:
    """A document is an id (with its text): equal texts under several ids are as many documents, rows repeated under one
    id are one. An id that several sources hold may be used by any of them, at most max_repeats times through a source.
    Documents are aggregated by the set of sources that hold them (at most 2**sources sets, in practice one per source),
    the flow is solved over these sets, and each set's documents, in a seeded order, are cut at the routed token totals.
    So no source can be given more than max_repeats times its size, and one source's room is exactly that.
    """
    wanted = read_targets(targets)
    rows = cut_lineage(sized(documents, targets, **columns))
    held = rows.groupBy("id", "text_key").agg(F.max("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern"))
    patterns = {tuple(r["pattern"].split("\x1f")): r["n"] for r in held.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    size = {s: sum(n for p, n in patterns.items() if s in p) for s in sorted({s for p in patterns for s in p})}
    whole = sum(patterns.values())
    flow = cheapest_flow(patterns, {s: quota_of(w, whole) for s, (w, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()})
    routed: dict[str, int] = dict.fromkeys(wanted, 0)
    for (_, _, s), n in flow.items():
        routed[s] += n
    cuts, at = [], {}
    for (p, use, s), n in sorted(flow.items()):
        low = at.get((p, use), 0)
        cuts.append(("\x1f".join(p), s, low, low + n))
        at[p, use] = low + n
    ranges = documents.sparkSession.createDataFrame(cuts, "pattern string, source string, low long, high long")
    placed = permuted_position(held, ["pattern"], ["id", "text_key"], seed, F.col("tokens"))
    chosen = placed.join(ranges, "pattern").filter((F.col("before") >= F.col("low")) & (F.col("before") < F.col("high")))
    return Mix(chosen.groupBy("id", "text_key", "source", "tokens").agg(F.count("*").alias("copies")).drop("text_key"), size, routed, whole)


def mixed(documents: DataFrame, targets: DataFrame, seed: int = SEED, **columns: str) -> tuple[DataFrame, DataFrame, int]:
    """(mix, sizes, whole) of mix_of; sizes: source, size."""
    mix = mix_of(documents, targets, seed, **columns)
    return mix.rows, documents.sparkSession.createDataFrame(list(mix.size.items()), "source string, size long"), mix.whole


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")


def source_report(documents: DataFrame, targets: DataFrame, **columns: str) -> list[tuple]:
    """(source, weight, max_repeats, size, quota, tokens, share, short, lacking) per target, from the mix as drawn.

    short: the flow could route less than the quota. lacking: of these, the sources whose documents are too few whatever
    else is routed, max_repeats x size < weight x whole (one that shares documents may be short and not lacking).
    """
    mix = mix_of(documents, targets, **columns)
    got = {r["source"]: r["n"] for r in mix.rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    total, out = sum(got.values()), []
    for s, (w, r) in sorted(read_targets(targets).items()):
        size, quota, tokens = mix.size.get(s, 0), quota_of(w, mix.whole), got.get(s, 0)
        short = mix.routed[s] < quota
        out.append((s, w, r, size, quota, tokens, round(tokens / total, 6) if total else None, short, short and r * size < w * mix.whole))
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _tables(spark, sf_dir)
    given = {r["s"]: r["source"] for r in targets.select("source", source_name("source").alias("s")).collect()}
    return spark.createDataFrame([(given[r[0]],) for r in source_report(documents, targets) if r[-1]], "source string")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(*_tables(spark, sf_dir))[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its size, the tokens asked for and reached, and the shares of the mix."""
    rows = [r[:-1] for r in source_report(*_tables(spark, sf_dir))]
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int, size long, quota long, tokens long, share double, short boolean")


QUERIES = {"p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}
