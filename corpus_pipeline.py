"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Every stage takes all documents that the one before kept, and all but the last
return the columns of documents, with n_chars for the text as it is then:

``quality``   removes failed lines and the documents that the rules reject;
``simhash``   keeps one document (least doc_id) of each group of near-duplicates: fingerprints
              that differ in three bits or fewer (op2), joined by all pairs of similarity 0.8
              or more over five-word shingles, most of which lie further apart (near_copies.py);
``suffixes``  cuts out passages of 100 bytes and more that an earlier text holds,
              in whole characters; a text may become empty, its document stays;
``packing``   packs what is left into sequences of 2048 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import near_copies, packing, quality, suffix_dedup
from folioscope.llm.common import materialize
from folioscope.shipping import ship


def _with_text(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], text: str) -> DataFrame:
    """docs with the text that judge gives to (doc_id, text); other columns go along in one, so that none clashes with the judge's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    judged = judge(docs.select("doc_id", "text", F.struct(*others, F.lit(0)).alias("_others")))
    changed = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.length(text).cast("long")}
    return judged.select(*(changed.get(c, F.col("_others").getField(c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _with_text(docs, lambda d: quality.judge(d).filter("kept"), "cleaned")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_copies.keep_one(docs, fingerprints=True).select(docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _with_text(docs, lambda d: suffix_dedup.remove_repeats(d, with_text=False, as_text=True), "kept")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_tokens")


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("suffixes", suffix_stage), ("packing", packing_stage)]
#: Similarity of all pairs, suffix order and a tokenizer are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
