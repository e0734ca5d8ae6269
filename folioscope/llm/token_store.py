"""Operator 9: token ids in a binary store with one shared zstandard dictionary.

Layout of a store (two Parquet tables below one path, so that any file system
Spark can reach will do):

``dictionary``  one row: ``dict_hash`` (sha256 of the dictionary), ``dictionary``.
``blocks``      one row for each run of documents: ``part``, ``block`` (their order),
                ``first_doc``, ``last_doc``, ``dict_hash``, ``doc_ids``, ``n_tokens``,
                ``offsets`` (n + 1 of them, into ``payload``), ``payload``.

Every document is one zstandard frame of its ids (little-endian unsigned 32-bit,
with the end id), compressed alone with the shared dictionary, so one document is
read by its offsets alone. Documents lie in ascending doc_id order (nulls first,
then by a hash of the frame) over parts, blocks and offsets. Texts are encoded where
they are read, so only frames are moved and sorted.

Null texts count as empty: a document is then its end id only. Repeated rows are
kept. An empty table gives a store without blocks and an empty dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import discard, materialize
from folioscope.llm.tokens import encoder, slices

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many documents (least hash of the id), of so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 8192

_BLOCKS = "part int, block int, first_doc bigint, last_doc bigint, dict_hash string, doc_ids array<bigint>, n_tokens array<int>, offsets array<bigint>, payload binary"
_FRAMES = "doc_id bigint, place bigint, n int, frame binary"
_DOCS = "doc_id bigint, part int, block int, nth int, n_tokens bigint, ids binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the serialized ids of a bounded, deterministic sample."""
    ids = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    chosen = docs.filter(F.col("doc_id").isin([i for i in ids if i is not None])) if ids else docs.limit(0)
    sample = chosen.groupBy("doc_id").agg(F.min(F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS)).alias("text")).orderBy("doc_id")
    end = np.array([end_id], dtype="<u4").tobytes()
    samples = [x + end for x in encoder(tokenizer).encode([r.text for r in sample.collect()])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves serve
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3) -> None:
    """Encode docs (doc_id, text) and write a store to path."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)  # DICTIONARY_BYTES at most
    end = np.array([end_id], dtype="<u4").tobytes()

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(shared.value)
        compress = (zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)).compress
        encode, place = encoder(tokenizer).encode, TaskContext.get().partitionId() << 33
        for rows, texts in slices(batches, "text"):
            ids = [x + end for x in encode(texts)]
            counts = pa.array([len(x) // 4 for x in ids], pa.int32())
            places = pa.array(np.arange(place, place + len(ids)))
            place += len(ids)
            yield pa.RecordBatch.from_arrays([rows.column(0), places, counts, pa.array([compress(x) for x in ids], pa.binary())], _names(_FRAMES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        ids, counts, frames, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist()
            known = [x for x in ids if x is not None]
            values = [part, block, known[0] if known else None, known[-1] if known else None, digest, ids, counts, offsets, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _names(_BLOCKS))

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                frames.append(frame)
                ids.append(doc_id)
                counts.append(n)
                held += len(frame)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield row()
                    block, ids, counts, frames, held = block + 1, [], [], [], 0
        if ids:
            yield row()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pressed = materialize(plain.mapInArrow(press, _FRAMES), "token-frames")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"), F.col("place")]  # place: rows of one id may be many
    ordered = pressed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "frame")
    ordered.mapInArrow(pack, _BLOCKS).write.parquet(f"{path}/blocks")
    discard(pressed)


def _decode(blocks: DataFrame, dictionary: tuple[str, bytes], wanted: frozenset | None = None) -> DataFrame:
    digest, raw = dictionary

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(raw)
        press = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
        for batch in batches:
            for b in batch.to_pylist():
                if b["dict_hash"] != digest or hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError("a block was written with another dictionary")
                out, held = [], 0
                for i, doc_id in enumerate(b["doc_ids"]):
                    if wanted is None or doc_id in wanted:
                        x = press.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]])
                        if len(x) != 4 * b["n_tokens"][i]:
                            raise ValueError("a document's length is not what the index says")
                        out.append((doc_id, b["part"], b["block"], i, b["n_tokens"][i], x))
                        held += len(x)
                    if out and (held > 8 << 20 or i + 1 == len(b["doc_ids"])):
                        columns = list(zip(*out, strict=True))
                        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(_DOCS))
                        out, held = [], 0

    return blocks.mapInArrow(unpack, _DOCS)


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, bytes]]:
    first = spark.read.parquet(f"{path}/dictionary").first()
    return spark.read.parquet(f"{path}/blocks"), (first.dict_hash, bytes(first.dictionary))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a store: doc_id, part, block, nth (place in the block), n_tokens, ids (binary)."""
    blocks, dictionary = _open(spark, path)
    return _decode(blocks, dictionary)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents: only blocks whose id range holds one are read, only their own frames decompressed."""
    blocks, dictionary = _open(spark, path)
    inside = F.lit(False)
    for x in doc_ids:
        inside |= (F.col("first_doc") <= x) & (F.col("last_doc") >= x)
    return _decode(blocks.filter(inside), dictionary, frozenset(doc_ids))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block, nth, start: the ids of all documents before each, from the index alone."""
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    sums = blocks.withColumn("_n", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)"))
    parts = sums.groupBy("part").agg(F.sum("_n").alias("_n"))
    before = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_base"))
    placed = sums.join(F.broadcast(before), "part")  # one row a part
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = placed.withColumn("_base", F.col("_part_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    each = based.select("part", "block", "_base", F.posexplode("n_tokens").alias("nth", "_count"))
    earlier = Window.partitionBy("part", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("part", "block", "nth", (F.col("_base") + F.coalesce(F.sum("_count").over(earlier), F.lit(0))).alias("start"))
