"""A source far behind the best passages has its floor."""

from folioscope.plans import passages


def test_every_source_has_its_floor(spark, tmp_path):
    rows = [(i, "edithon therein thingon", "hot") for i in range(600)] + [(1000 + i, "edithon " + "other words here " * 20, "cold") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = passages.passages_within_budget(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r.doc_id >= 1000] == [(1000, 601), (1001, 602)]
    assert len(got) == 502
