"""Similarity joins, reading order, ramps and great circles on hand-made rows."""

from pyspark.sql import functions as F

from folioscope.operators import atlas, catalogue, similarity


def test_title_matches_find_every_pair(spark):
    titles = ["the cat sat on a mat", "a cat sat on the mat", "dogs bark at night", "dogs bark at noon", "", "one"]
    d = spark.createDataFrame(list(enumerate(titles)), "a int, title string")
    got = {(r.a, r.b) for r in similarity.title_matches(d, d.withColumnRenamed("a", "b"), "a", "b", 0.6, 9).collect()}
    words = [set(t.split()) for t in titles]
    assert got == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if x and y and len(x & y) >= 0.6 * len(x | y)}


def test_reading_order_and_auc(spark):
    w = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(1, " ".join(w), " ".join(w)), (2, " ".join(w), " ".join(w[30:] + w[:30])), (3, "a b", "a b")], "k int, a string, b string")
    got = {r.k: r.rho for r in similarity.reading_order(d, "k", "a", "b").collect()}
    assert got[1] == 1.0 and got[2] < 0.2 and 3 not in got
    r = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "s double, p boolean")
    assert similarity.auc(r, "s", "p").first().auc == 0.875


def test_slerp_and_ramp(spark):
    r = spark.range(1).select(atlas.slerp(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), 0.5).alias("m"), atlas.author_key(F.lit("O'Neil"), F.lit("Ann")).alias("k")).first()
    assert [round(x, 6) for x in r.m] == [0.707107, 0.707107] and r.k == "oneil/a"
    d = spark.createDataFrame([(1980.0,), (1989.0,), (1995.0,), (2000.0,)], "d double")
    assert [round(x.ramp, 3) for x in atlas.date_ramp(d, "d").orderBy("d").collect()] == [0.0, 0.05, 0.1, 0.55]
    assert atlas.knots(d, "d", 3).count() == 3


def test_rename_chain(spark):
    names = spark.createDataFrame([("a",), ("x",)], "name string")
    renames = spark.createDataFrame([("a", "b"), ("b", "c")], "old string, new string")
    assert {(r.name, r.current) for r in catalogue.rename_chain(names, renames).collect()} == {("a", "c"), ("x", "x")}
