"""Ranks and running sums by range partitions against plain Python."""

from pyspark.sql import functions as F

from folioscope.operators import atlas, passages, ranks


def test_running_sums_with_one_hot_value(spark):
    d = spark.range(0, 900, 1, 7).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40).alias("v"))
    found = ranks.running(d, [F.col("v"), F.col("id")], before=F.col("v"), n=F.lit(1)).collect()
    total = 0
    for i, r in enumerate(sorted(found, key=lambda r: (r["v"], r["id"]))):
        assert (r["before"], r["n"]) == (total, i)
        total += r["v"]


def test_ties_nulls_and_nothing(spark):
    d = spark.createDataFrame([(1,), (1,), (None,), (0,)], "v int")
    assert sorted((r["v"] is None, r["v"], r["rank"]) for r in ranks.numbered(d, [F.asc_nulls_last("v")]).collect() if r["v"] is not None) == [(False, 0, 1), (False, 1, 2), (False, 1, 3)]
    assert ranks.numbered(d.filter("v > 9"), [F.col("v")]).columns == ["v", "rank"]
    assert ranks.numbered(d.filter("v > 9"), [F.col("v")]).count() == 0


def test_floor_beyond_the_budget(spark):
    d = spark.createDataFrame([(i, "a" if i < 9 else "b", 10) for i in range(1, 12)], "rank int, source string, tokens int")
    kept = passages.select_within_budget(d, "source", "tokens", 30).collect()
    assert sorted(r["rank"] for r in kept) == [1, 2, 3, 9, 10]


def test_knots_are_values(spark):
    d = spark.createDataFrame([(x,) for x in [5, 1, 1, 1, 9, 7, 3]], "v int")
    assert [r["knot"] for r in atlas.knots(d, "v", 4).orderBy("i").collect()] == [1, 1, 5, 9]
