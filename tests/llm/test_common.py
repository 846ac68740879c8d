from pyspark.sql import functions as F

from lectern.llm.common import bounded_sample, fresh


def test_a_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20_000).select("id", F.lit("x").alias("mark"))
    found = sorted(r.id for r in bounded_sample(df, 1000, ["id"]).collect())
    assert 800 < len(found) < 1200 and sorted(set(found)) == found
    again = bounded_sample(df.unionByName(df).repartition(9), 1000, ["id"])
    assert sorted(r.id for r in again.collect()) == found or abs(again.count() - len(found)) < 60


def test_repeated_rows_count_once(spark):
    hot = spark.range(30_000).select(F.lit(7).cast("long").alias("id"))
    some = spark.range(100, 150).select("id")
    found = [r.id for r in bounded_sample(hot.unionByName(some), 1000, ["id"]).collect()]
    assert sorted(found) == [7, *range(100, 150)]
    nulls = spark.range(5000).select(F.lit(None).cast("long").alias("id"))
    assert [r.id for r in bounded_sample(nulls, 100, ["id"]).collect()] == [None]
    assert bounded_sample(nulls.limit(0), 100, ["id"]).collect() == []


def test_rare_strata_stay(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 30, "rare").otherwise("often").alias("kind"))
    counts = {r.kind: r["count"] for r in bounded_sample(df, 500, ["id"], "kind").groupBy("kind").count().collect()}
    assert counts["rare"] == 30 and 350 < counts["often"] < 650


def test_fresh_names():
    assert fresh(["A", "mark", "Mark_"], "mark") == "mark__" and fresh([], "a") == "a"
