"""Catalogue decisions and letters where many files share a name or a label."""

from pyspark.sql import functions as F

from folioscope.functions import texts
from folioscope.operators import catalogue


def test_intake_passes_no_lists_of_hashes_through_its_joins(spark):
    """One name holds every hash of the store: what goes along with an incoming file stays one flag."""
    columns = "name string, size long, hash string, stem string, doi string"
    store = spark.createDataFrame([("n", 1, "h1", "s", "d"), ("n", 2, "h2", "", ""), ("m", 3, None, "s", None), (None, 4, "h4", "", "")], columns)
    rows = [(1, "n", 1, "h1", "", ""), (2, "n", 9, "h9", "s", "d"), (3, "x", 2, "h2", "", ""), (4, "y", 9, "h9", "s", "d"), (5, "z", 9, "h9", None, "d"), (6, "z", 9, "h9", "t", ""), (7, None, 9, "h4", "t", ""), (8, "m", 3, None, "t", "")]
    got = catalogue.intake(spark.createDataFrame(rows, "id int, " + columns), store, "id")
    assert {r.id: r.decision for r in got.collect()} == {1: "dup-identical", 2: "collision", 3: "dup-content", 4: "dup-samepaper", 5: "needs-naming", 6: "promote", 7: "promote", 8: "collision"}
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_letters_behind_code_255(spark):
    files = spark.range(400).select(F.lit("s").alias("stem"), F.format_string("n%04d", "id").alias("name"))
    got = [r.letter for r in catalogue.renumbered(files, "stem", "name").orderBy("name").collect()]
    assert got == [chr(97 + i) for i in range(400)]
    codes = [65, 255, 256, 0xD7FF, 0xD800, 0x10F7FF, 0x10F800]
    d = spark.createDataFrame([(c,) for c in codes], "c int").select("c", texts.character(F.col("c")).alias("x"))
    assert [r.x for r in d.orderBy("c").collect()] == ["A", "\xff", "\u0100", "\ud7ff", "\ue000", "\U0010ffff", ""]
