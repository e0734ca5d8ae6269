"""Letters of papers that share a label, without an end."""

from pyspark.sql import functions as F

from folioscope.functions import citing


def test_letters_of_labels_without_end(spark):
    papers = spark.range(300).select(F.lit("L").alias("label"), F.lit("t").alias("title"), F.format_string("p%04d", "id").alias("name"))
    got = [r.letter for r in citing.letters(papers, "label", "title", "name", most=None).orderBy("name").collect()]
    assert got == [chr(97 + i) for i in range(300)]
    assert citing.letters(papers, "label", "title", "name").filter("letter != ''").count() == 26
