"""How new a text is against the one before it: cosine of TF-IDF vectors of the corpus's most frequent words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words that are left out; a parameter.
STOP = "a an and are as at be been but by for from had has have he her his i if in into is it its more no not of on or our she so than that the their them there these they this to was we were what when which who will with would you your".split()
WORD, MOST_WORDS = r"([\p{L}\p{N}_]{2,})", 500


def words_of(text: Column, stop: Sequence[str] = tuple(STOP)) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)), lambda w: ~w.isin(*stop))


def cosine_novelty(docs: DataFrame, id_: str, text: str, by: Sequence[str], order: Sequence[str], most: int = MOST_WORDS, stop: Sequence[str] = tuple(STOP)) -> DataFrame:
    """(id, novelty): 1 - cosine of each text and the one before it in its group; null for the first, and if either has no such word.

    The vocabulary is the `most` words of the highest count (by name among equals) of all texts; with their document counts it is
    all that comes to the driver. Vectors have at most `most` entries, so what a window holds is bounded per row.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(id_, *by, *[c for c in order if c not in (id_, *by)], words_of(F.col(text), stop).alias("__w"))
    counted = rows.select(F.explode("__w").alias("w"), F.col(id_).alias("i")).groupBy("w", "i").agg(F.count("*").alias("n"))
    top = counted.groupBy("w").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.col("tf").desc(), "w").limit(most).collect()
    n = rows.count()
    if not top:
        return rows.select(id_, F.lit(None).cast("double").alias("novelty"))
    idf = F.create_map(*[x for r in top for x in (F.lit(r["w"]), F.log(F.lit((1 + n) / (1 + r["df"]))) + 1)])
    known = F.filter("__w", lambda w: F.map_contains_key(idf, w))
    tf = F.aggregate(F.array_sort(known), F.array().cast("array<struct<w:string,n:int>>"), _count)
    vector = rows.withColumn("__tf", tf).withColumn("__v", F.map_from_entries(F.transform("__tf", lambda e: F.struct(e["w"].alias("k"), (e["n"] * F.try_element_at(idf, e["w"])).alias("v")))))
    vector = vector.withColumn("__norm", F.sqrt(F.aggregate(F.map_values("__v"), F.lit(0.0), lambda a, x: a + x * x))).drop("__w", "__tf")
    before = Window.partitionBy(*by).orderBy(*order)
    pair = vector.withColumns({"__pv": F.lag("__v").over(before), "__pn": F.lag("__norm").over(before)})
    dot = F.aggregate(F.map_entries("__v"), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(F.col("__pv"), e["key"]), F.lit(0.0)))
    return pair.select(id_, (1 - F.try_divide(dot, F.nullif(F.col("__norm") * F.col("__pn"), F.lit(0.0)))).alias("novelty"))


def _count(acc: Column, w: Column) -> Column:
    """Runs of equal words of a sorted array, counted."""
    last = F.try_element_at(acc, F.lit(-1))
    one = F.array(F.struct(w.alias("w"), F.lit(1).alias("n")))
    more = F.array(F.struct(w.alias("w"), (last["n"] + 1).alias("n")))
    return F.when(last["w"] == w, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), more)).otherwise(F.concat(acc, one)).cast("array<struct<w:string,n:int>>")
