from pyspark.sql import functions as F

from chronotext.operators import sampling


def test_ranks_are_complete_in_each_stratum(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 300, "hot").when(F.col("id") < 450, "x").alias("g"), F.lit(1).alias("rank0"))
    got = sampling.ranked(df, ["g"], "id").collect()
    for g, n in (("hot", 300), ("x", 150), (None, 50)):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(n)) and {r["size"] for r in got if r["g"] == g} == {n}
    assert sampling.ranked(df.limit(0), ["g"], "id").count() == 0


def test_replenish(spark):
    pool = spark.range(100).select(F.col("id"), (F.col("id") % 2).cast("string").alias("g"))
    kept = pool.filter("id in (0, 2, 4)")
    new = sampling.replenish(kept, pool, "g", "id", 10)
    assert sorted((r["g"], r["count"]) for r in new.groupBy("g").count().collect()) == [("0", 7), ("1", 10)]
    assert new.join(kept, "id").count() == 0


def test_top_up():
    assert sampling.top_up({"a": 2}, [("1", ["a"]), ("2", ["a"]), ("3", ["b"]), ("4", [])], 3) == ["1", "3"]


def test_spearman_of_monotone_and_empty(spark):
    df = spark.range(20).select(F.col("id").alias("a"), (F.col("id") * F.col("id")).alias("b"))
    assert abs(sampling.spearman(df, "a", "b").first()["spearman"] - 1) < 1e-12
    assert sampling.spearman(df.filter("a < 0"), "a", "b").first()["n"] == 0
