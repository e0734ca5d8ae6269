"""The retrieval scores against a plain version over whole texts."""

import pandas as pd

from folioscope.operators import passages
from folioscope.plans import passages as plans
from folioscope.sources.views import table

SF = "/root/testdata/sf0.001"


def runs(words):
    return {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}


def test_retrieval_scores_read_whole_texts(spark, tmp_path):
    items = table(spark, SF, "benchmark")
    passage = items.orderBy("item_id").first().text
    far = spark.createDataFrame([(9001, "word " * 900 + passage + " between " + passage), (9002, passage[:40])], "doc_id long, text string")
    table(spark, SF, "documents").select("doc_id", "text").unionByName(far).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect() if r.text}
    items = {r.item_id: r.text for r in table(spark, folder, "benchmark").collect()}
    chunks = [(d, s, runs(t[s : s + plans.CHUNK_CHARS].split(" "))) for d, t in docs.items() for s in range(0, max(len(t), 1), plans.CHUNK_STEP)]
    gold, got = [], []
    for q, t in items.items():
        for d, text in docs.items():
            at = text.find(t)
            while at >= 0:
                gold.append((q, d, at, at + len(t)))
                at = text.find(t, at + len(t))
        own = runs(t.split(" "))
        ranked = sorted((-len(own & k), d, s) for d, s, k in chunks if own & k)[: plans.TOP_CHUNKS]
        got += [(q, d, s, s + plans.CHUNK_CHARS) for _, d, s in ranked]
    assert gold and any(s > 2000 for _, _, s, _ in gold)
    frame = lambda rows: spark.createDataFrame(rows, "qid long, doc long, s int, e int")
    want, have = (d.toPandas() for d in (passages.retrieval_scores(frame(gold), frame(got)), plans.retrieval_scores(spark, folder)))
    order = sorted(want.columns)
    pd.testing.assert_frame_equal(*(x[order].sort_values(order).reset_index(drop=True) for x in (want, have)), check_dtype=False)
