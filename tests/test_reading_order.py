"""Two readings of a text: the plan deals the texts by key once, not their shingles."""

from folioscope.operators import similarity


def test_one_exchange_and_the_same_correlations(spark):
    words = [f"w{n}" for n in range(60)]
    rows = [(1, " ".join(words), " ".join(words)), (2, " ".join(words), " ".join(words[30:] + words[:30])), (3, " ".join(words[:20]), " ".join(words)), (4, "a b", None), (5, " ".join(words * 2), " ".join(words))]
    got = similarity.reading_order(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {r.id: (r.n, r.rho) for r in got.collect()}
    assert found[1] == (49, 1.0) and found[2][0] == 38 and found[2][1] < 0 and found[3] == (9, None)
    assert set(found) == {1, 2, 3}  # 5 says every shingle of the other text twice
