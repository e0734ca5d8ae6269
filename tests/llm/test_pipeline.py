"""Each stage of the pipeline, and all of them, against a plain version; the queries' SQL; odd tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_near_copies import brute_kept
from test_operators import SCHEMA, TEXTS, brute_cut, check_packing, library, path  # noqa: F401

import corpus_pipeline
from folioscope.llm import quality, queries

SF = "/root/testdata/sf0.001"


def plain_stages(rows):
    """The texts by doc_id after each filtering stage."""
    kept = {i: c["cleaned"] for i, t in rows if (c := quality.clean(t))["kept"]}
    yield dict(kept)
    stays = brute_kept(kept)
    kept = {i: t for i, t in kept.items() if i in stays}
    yield dict(kept)
    cut = {int(i): raw for i, _, _, _, _, raw in brute_cut(kept.items())}
    yield {i: cut[i].decode("utf-8", "ignore") for i in kept}


def test_stages(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, want = docs.columns, plain_stages([(r.doc_id, r.text) for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        got = {r.doc_id: r.text for r in docs.collect()}
        texts = next(want)
        assert got == texts, name
        assert all(r.n_chars == len(r.text) for r in docs.select("text", "n_chars").collect())
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(rows, texts.items(), library, 2048)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)


def test_odd_tables(spark):
    """Null ids and texts, repeated rows, columns that stages use themselves; and an empty table."""
    good = "\n".join(f"Sentence{i} of{i} plain{i} text{i}, and{i} it{i} ends{i} well." for i in range(12))
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(TEXTS + TEXTS)] + [(3, good, "en", "s", 1)] * 2 + [(90, good + "\nHome | About | Contact", None, "s", 1), (None, good, None, "t", 2)]
    clash = ("kept", "n_words", "cleaned", "_key", "_spans", "n_removed", "fp")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in clash})
    (_, quality_stage), (_, simhash_stage), (_, suffix_stage), (_, packing_stage) = corpus_pipeline.STAGES
    cleaned = quality_stage(spark, docs, SF)
    assert cleaned.columns == docs.columns
    got = cleaned.filter(F.col("text").startswith("Sentence0")).collect()
    assert sorted((r.doc_id or -1, r.text, r.kept, r.n_words) for r in got) == [(-1, good, "own kept", "own n_words"), *[(3, good, "own kept", "own n_words")] * 2, (90, good, "own kept", "own n_words")]
    one = simhash_stage(spark, cleaned, SF)
    assert sorted((r.doc_id or -1) for r in one.filter(F.col("text").startswith("Sentence0")).collect()) == [-1, 3]
    cut = suffix_stage(spark, one, SF)
    assert cut.columns == docs.columns
    assert {(r.doc_id, r.text, r._key, r.n_removed) for r in cut.filter("lang = 's' or source in ('s', 't')").collect()} == {(None, good, "own _key", "own n_removed"), (3, "", "own _key", "own n_removed")}
    packed = packing_stage(spark, cut, SF)
    assert packed.select("doc_id").distinct().count() == cut.select("doc_id").distinct().count()
    empty = spark.createDataFrame([], SCHEMA)
    assert [stage(spark, empty, SF).count() for _, stage in corpus_pipeline.STAGES] == [0, 0, 0, 0]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    mine, theirs = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(str, mine[columns].values.tolist())) == sorted(map(str, theirs[columns].values.tolist()))
