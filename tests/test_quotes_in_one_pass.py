"""Damaged quotes: pages are shuffled once and written nowhere; first pages are those that joins find."""

import random

from folioscope import registry
from folioscope.operators import quotes
from pyspark.sql import functions as F


def test_pages_are_dealt_once_and_words_made_once_a_side(spark):
    found = registry.queries()["damaged_quotes"](spark, "/root/testdata/sf0.001")
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in executed and executed.count("Exchange hashpartitioning") == 2  # by document, then what was found by quote
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("split(lower(text") == 2


def test_first_pages_as_joins_find_them(spark):
    rng = random.Random(6)
    pages = {d: {p: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))] for p in range(1, 6)} for d in range(5)}
    asked = [(n, n % 6, " ".join(rng.choice("abcdefghx") for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n\na b c d e f"]), rng.choice([None, 2, 4])) for n in range(80)]
    table = spark.createDataFrame([(d, p, w) for d, ps in pages.items() for p, w in ps.items()], "doc int, page int, words array<string>")
    attempts = quotes._attempts(spark.createDataFrame(asked, "quote_id int, doc int, quote string, hint_page int")).localCheckpoint()
    want = {(r.quote_id, r.attempt): r.page for r in quotes._first_pages(attempts, table).collect()}
    got = {(r.quote_id, r.attempt): quotes.first_page(pages.get(r.doc, {}), r.q, r.attempt, r.hint) for r in attempts.collect()}
    assert {k: p for k, p in got.items() if p is not None} == want and len(want) > 60


def test_empty_pages_other_documents_and_batches(spark):
    words = [f"w{i}" for i in range(60)]
    pages = spark.createDataFrame([(1, 1, words[:30]), (1, 2, words[30:]), (2, 1, []), (2, 2, None), (3, 1, words), (None, 1, words)], "doc long, page int, words array<string>")
    asked = spark.createDataFrame([("a", 1, " ".join(words[20:45])), ("b", 2, " ".join(words[:9])), ("c", 3, " ".join(words[50:])), ("d", None, " ".join(words)), ("e", 4, " ".join(words))], "quote_id string, doc int, quote string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r.quote_id: (r.page, [tuple(s) for s in r.spans], r.matched) for r in quotes.locate_roughly(asked, pages.orderBy(F.desc("page"))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == {"a": (1, [(1, 20, 29), (2, 0, 14)], 25), "c": (1, [(1, 50, 59)], 10)}
