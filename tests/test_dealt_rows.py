"""Steps that follow the input's size: rows dealt from one file to many tasks, sums without sorts, bounded Python, words made once."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope import registry
from folioscope.operators import atlas, quotes, ranks, repair, trends

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_f21_plain_markdown_is_dealt(spark):
    assert registry.queries()["plain_markdown"](spark, SF).rdd.getNumPartitions() >= ranks.DEALT


def test_f20_repeated_edges_has_one_shuffle(spark):
    _, executed = plan(registry.queries()["repeated_edges"](spark, SF))
    assert executed.count("Exchange ") == 1 and f", {ranks.DEALT})" in executed


def test_f14_terms_are_summed_by_hash(spark):
    rows = [(2, 1999, "subjects", "Maths"), (1, 2001, "subjects", "MATHS"), (3, 2000, "subjects", ""), (3, 2000, "types", "Book"), (4, None, "subjects", "Maths")]
    found = trends.term_totals(spark.createDataFrame(rows, "seq long, year int, dim string, term string"))
    assert sorted(tuple(r) for r in found.select("dim", "key", "term", "first_year", "n").collect()) == [("subjects", "maths", "MATHS", 1999, 3), ("types", "book", "Book", 2000, 1)]


def test_f13_terms_of_a_null_cluster(spark):
    texts = spark.createDataFrame([(None, "aa bb"), ("x", "aa bb cc"), ("y", "aa dd"), ("y", None), ("z", "")], "cluster string, content string")
    found = atlas.cluster_terms(texts).collect()
    assert sorted({(r.cluster or "", r.term) for r in found}) == [("", "aa"), ("", "aa bb"), ("", "bb"), ("x", "aa"), ("x", "aa bb"), ("x", "bb"), ("y", "aa")]
    assert all(abs(sum(r.weight**2 for r in found if r.cluster == c) - 1) < 1e-9 for c in (None, "x", "y"))


def test_f10_pages_move_with_their_words(spark):
    assert quotes.opening(["so", "a", "b", "c", "d", "e", "f"], list("abcdexyz")) == 5
    assert quotes.opening(list("abc"), list("abc")) == 3 and quotes.opening(list("abc"), list("ab")) is None and quotes.opening(list("abx"), list("abc")) is None
    pages = spark.createDataFrame([(1, 1, "k a b c x"), (1, 2, "a b c d e"), (2, 1, "a b")], "doc int, page int, text string").select("doc", "page", F.split("text", " ").alias("words"))
    asked = spark.createDataFrame([(7, 1, "a b c d e"), (8, 2, "z b c")], "quote_id int, doc int, quote string")
    attempts = quotes._attempts(asked)
    found = quotes._first_pages(attempts, pages)
    assert [(r.quote_id, r.page) for r in found.collect()] == [(7, 2)]
    before, _ = plan(found)
    assert before.count("Generate explode") == 1  # a row for each first word that a page holds, not for each word


def test_f16_few_texts_at_once():
    n = 200
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "ids": [0, 1], "pieces": ["TEXT ", "none"], "text": f"a  text {i}"} for i in range(n)])
    out = list(repair._spans(iter([batch])))
    assert max(len(b) for b in out) <= 2 * repair._HELD and sum(len(b) for b in out) == 2 * n
    assert out[0].to_pylist()[:2] == [{"doc_id": 0, "piece_id": 0, "s": 3, "e": 7}, {"doc_id": 0, "piece_id": 1, "s": None, "e": None}]
