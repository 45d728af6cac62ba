"""Near-duplicate records with small edits (problem 3): the size-aware set join over the sentences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import sets
from chronotext.llm.components import components
from chronotext.session import cut_lineage, table

SIMILARITY, LEAST_WORDS = Fraction(7, 10), 12


def verified(pairs: DataFrame, measure: sets.Measure) -> DataFrame:
    """Of rows (.., text_a, text_b) those whose word sets are similar, without the texts."""
    left = [c for c in pairs.columns if c not in ("text_a", "text_b")]

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [measure.holds(set(sets.words(x)), set(sets.words(y))) for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_())).select(left)

    return pairs.mapInArrow(exact, pairs.select(*left).schema)


def with_texts(close: DataFrame, rows_a: DataFrame, rows_b: DataFrame) -> DataFrame:
    """close with a text of each set (any that has its words)."""
    side = lambda df, s: df.groupBy("key", "content").agg(F.min("text").alias("text")).select(*[F.col(c).alias(f"{c}_{s}") for c in ("key", "content", "text")])
    return close.join(side(rows_a, "a"), ["key_a", "content_a"]).join(side(rows_b, "b"), ["key_b", "content_b"])


def similar_sets(rows: DataFrame, id_: str, text: str, measure: sets.Measure) -> tuple[DataFrame, DataFrame]:
    """(links, members) of all sets that have a similar set or a copy.

    links: key_a, content_a, key_b, content_b of different similar sets, each pair once. members: key, content, id of
    every record of those sets and of every set held by more than one row. A set is named by its key and content hash.
    """
    kept = rows.select(F.col(id_).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    plan, _, _ = sets.plan_for(kept, "id", "text", measure)
    pairs = sets.candidates(kept, "text", plan)
    named = cut_lineage(sets.maybe_in(sets.keyed(kept, "text", measure.least, ["id"]).select("id", *sets.NAMED), sets.key_filter(pairs)))
    different = sets.one_each(named)
    apart = (F.col("key_a") != F.col("key_b")) | (F.col("content_a") < F.col("content_b"))
    close = cut_lineage(sets.close_pairs(pairs, different, different, measure).filter(apart))
    wanted = sets.maybe_in(named, sets.key_filter(close.select("key_a", "key_b").union(pairs.filter("key_a = key_b"))))
    near = cut_lineage(sets.keyed(sets.maybe_in(kept, sets.filter_of(wanted.select("id")), "id"), "text", measure.least, ["id"]))
    links = cut_lineage(verified(with_texts(close, near, near), measure))
    return links, near.select("key", "content", "id").distinct()


def near_duplicate_pairs(rows: DataFrame, id_: str = "id", text: str = "sentence", t: Fraction = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose sentences share at least `t` of their distinct words.

    Null ids and sentences, and sentences of fewer than `least` distinct words, are in no pair. Rows repeated under one
    id count once. Copies are similar: every two ids with the same words are a pair.
    """
    links, members = similar_sets(rows, id_, text, sets.Measure(t, least))
    side = lambda s: members.select(F.col("key").alias(f"key_{s}"), F.col("content").alias(f"content_{s}"), F.col("id").alias(f"id_{s}"))
    between = links.join(side("a"), ["key_a", "content_a"]).join(side("b"), ["key_b", "content_b"]).select("id_a", "id_b")
    within = side("a").join(side("b"), (F.col("key_a") == F.col("key_b")) & (F.col("content_a") == F.col("content_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    low, high = F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")
    return between.unionByName(within).filter(F.col("id_a") != F.col("id_b")).select(low, high).distinct()


def near_duplicate_groups(rows: DataFrame, id_: str = "id", text: str = "sentence", t: Fraction = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(id, group_id, links): each record of a group of more than one id, with the group's smallest id.

    links: how many different sets the record's set is similar to. A group holds all records that pairs connect.
    """
    links, members = similar_sets(rows, id_, text, sets.Measure(t, least))
    name = lambda s: F.concat_ws(":", f"key{s}", f"content{s}")
    edges = links.select(name("_a").alias("u"), name("_b").alias("v"))
    degree = edges.select(F.explode(F.array("u", "v")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    owned = members.select(F.concat_ws(":", "key", "content").alias("set"), "id")
    found = components(edges).withColumnsRenamed({"node": "set", "component": "root"})
    # A set in no link is its own component; a record of several sets ties them only within pairs of its own sets.
    placed = owned.join(found, "set", "left").join(degree, "set", "left").select("id", F.coalesce("root", "set").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("n")).filter(F.col("n") > 1)
    return placed.join(named, "root").groupBy("id", "group_id").agg(F.max("links").alias("links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "annotations"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "annotations"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLES: dict[str, str] = {}
