"""Percentiles of citations and temperatures of guesses at the borders of rounding."""

from pyspark.sql import functions as F

from folioscope.operators import trends
from folioscope.plans.impact import guess_temperatures
from folioscope.plans.trends import whole


def test_half_prices_round_to_even(spark):
    """As the SQL's cast does: 2.5 is 2 and goes before 3; ties by key."""
    o = spark.createDataFrame([(1, 2.5), (2, 2.0), (3, 3.5), (4, 3.6), (5, 2.4)], "o_orderkey long, o_totalprice double")
    got = trends.citation_percentile(o.select("o_orderkey", F.lit(1).alias("year"), whole(F.col("o_totalprice")).alias("cited")), "year", "cited", "o_orderkey")
    assert {r.o_orderkey: r.percentile for r in got.collect()} == {1: 0.0, 2: 25.0, 5: 50.0, 3: 75.0, 4: 100.0}


def test_temperatures_by_inner_products(spark, tmp_path):
    """The longer of two vectors of one direction is the warmer."""
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.9], 0), (2, [0.8, 0.0], 0), (3, [0.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.chunk_id: r.temperature for r in guess_temperatures(spark, str(tmp_path)).collect()}
    assert got[0] > got[1] > got[2] > got[3]
