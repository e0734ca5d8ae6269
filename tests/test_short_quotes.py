"""Quotes without four whole inner words."""

from folioscope.plans import passages


def test_short_and_cut_quotes_are_located(spark, tmp_path):
    docs = {1: "xa b c d efg", 2: "one two three", 3: "a b", 4: "so xa b c d e fgh"}
    quotes = {"five": "a b c d e", "six": "a b c d e f", "three": "ne two thre", "one": "b"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(quotes.items()), "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.item_id) for r in passages.located_quotes(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((d, q) for d, t in docs.items() for q, x in quotes.items() if x in t)
