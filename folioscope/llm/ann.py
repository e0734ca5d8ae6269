"""Operator 5: approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are made unit length by one more component (the largest inner product
is then the least angle), rotated at random to ``BITS`` directions and by a rotation
learned on a bounded sample (iterative quantization), and reduced to signs. Rows are
dealt into blocks of about ``BLOCK``; each block is indexed once, under each of the
``BITS / 8`` substrings of one byte of its codes, and written. A query probes all bytes
within a growing radius of each of its own bytes; at byte radius r that retrieves, by the
pigeonhole principle, every code within Hamming distance (r + 1) * substrings - 1.
Retrieved codes are verified by full distance, and once at least ``CANDIDATES`` (or
``SHARE``) of a block lie within the guaranteed radius, all within the least radius that
holds so many are reranked by the exact inner product of the original vectors in double
precision. Blocks' best are merged to each query's best.

All rows are indexed. The sample fits the rotation and the scale only; results differ
from brute force only where a neighbour's code is far from the query's, and with ``exact``
nowhere: then the radius grows until it holds every code.

How far the radius must grow depends on the vectors. Where they fill all directions
evenly, neighbours lie at angles of 60 degrees and more: half of BITS less a few, and at
such a radius any substring length leaves a quarter of each table to probe, which is most
rows in all. Bytes make those tables the cheapest; clustered vectors stop at radius 0 or 1.

Vectors take part if they are not null, zero, of another length than the most common
(the longest of equally common ones), nor hold nulls or non-finite components. Rows of
null id take no part. Of repeated ids the least vector (component by component) stands
for all. A query never meets its own id. Ties go to the smaller id. Fewer candidates
than ``k`` give all of them; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize

BITS = 128
BLOCK, QUERIES = 8192, 1024
#: Verified codes a query wants from a block: a share of its rows, and so many at least.
SHARE, CANDIDATES = 0.08, 400
#: The rotation is fitted on so many vectors (least hash of the id).
SAMPLE, ROUNDS = 4096, 20
_BYTES = np.arange(256, dtype=np.uint8)
_BY_DISTANCE = np.argsort(np.bitwise_count(_BYTES[:, None] ^ _BYTES), axis=1, kind="stable").astype(np.uint8)
#: How many bytes lie within each distance of a byte.
_BALL = [1, 9, 37, 93, 163, 219, 247, 255, 256]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part, one for each id."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return rows.limit(0)
    return rows.filter(F.size("v") == lengths[0].n).groupBy("id").agg(F.min("v").alias("v"))


def _unit(x: np.ndarray, scale: float) -> np.ndarray:
    """x / scale with the component that completes it to unit length."""
    x = x / scale
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def learn_rotation(sample: np.ndarray, scale: float, bits: int = BITS) -> np.ndarray:
    """A (d + 1) x bits projection: blocks of rotations, each fitted so that signs lose little of the sample."""
    x = _unit(sample, scale)
    d, random, out = x.shape[1], np.random.default_rng(11), []
    while sum(r.shape[1] for r in out) < bits:
        r, _ = np.linalg.qr(random.standard_normal((d, d)))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ v).T
        out.append(r)
    return np.hstack(out)[:, :bits]


def encode(x: np.ndarray, scale: float, rotation: np.ndarray, query: bool) -> np.ndarray:
    """Codes as rows of bytes. Queries need no completion: their length does not order candidates."""
    whole = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))]) if query else _unit(x, scale)
    return np.packbits(whole @ rotation > 0, axis=1)


class BlockIndex:
    """Codes of one block under each of their bytes: for a byte, the rows by its distance to theirs."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray | None = None):
        self.codes, self.substrings = codes, codes.shape[1]
        self.wide = np.ascontiguousarray(codes).view(np.uint64)
        self.rows = np.argsort(codes, axis=0, kind="stable").T.astype(np.uint32) if rows is None else rows
        self.edges = [np.searchsorted(codes[rows, s], np.arange(257)) for s, rows in enumerate(self.rows)]
        self.probed: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def probe(self, s: int, byte: int, radius: int) -> np.ndarray:
        """Rows whose s-th byte differs from byte in just ``radius`` bits."""
        if (s, byte) not in self.probed:
            near, edges = _BY_DISTANCE[byte], self.edges[s]
            sizes = (edges[1:] - edges[:-1])[near]
            ends = np.cumsum(sizes)
            at = np.arange(len(self.codes)) + np.repeat(edges[near] - (ends - sizes), sizes)
            self.probed[s, byte] = self.rows[s][at], np.concatenate([[0], ends[np.array(_BALL) - 1]])
        rows, reach = self.probed[s, byte]
        return rows[reach[radius] : reach[radius + 1]]

    def near(self, code: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of the nearest codes: all within a Hamming radius that holds ``wanted`` of them, or all."""
        n = len(self.codes)
        distance, seen = np.full(n, 255, dtype=np.uint8), np.zeros(n, dtype=bool)
        own, key = code.view(np.uint64), code.tolist()
        for radius in range(9):
            hit = np.zeros(n, dtype=bool)
            hit[np.concatenate([self.probe(s, key[s], radius) for s in range(self.substrings)])] = True
            hit &= ~seen
            found = np.flatnonzero(hit)
            seen |= hit
            distance[found] = np.bitwise_count(self.wide[found] ^ own).sum(axis=1)
            sure = min((radius + 1) * self.substrings - 1, 8 * self.substrings)
            counts = np.cumsum(np.bincount(distance, minlength=256)[:255])
            if counts[min(sure, 254)] >= wanted or radius == 8:
                return np.flatnonzero(distance <= np.searchsorted(counts, wanted))
        raise AssertionError("radius 8 reaches every byte")


_INDEX = "i int, n int, ids binary, vectors binary, codes binary, tables binary"


def build_index(rows: DataFrame, blocks: int, scale: float, rotation: np.ndarray) -> DataFrame:
    """One row a block: its ids, vectors, codes and the rows under each substring, all in order of id."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.array(group["v"].tolist(), dtype="<f8")
        codes = encode(x, scale, rotation, False)
        parts = group["id"].to_numpy("<i8"), x, codes, BlockIndex(codes).rows
        return pd.DataFrame([(group["i"].iloc[0], len(x), *(p.tobytes() for p in parts))], columns=[c.split()[0] for c in _INDEX.split(", ")])

    return rows.withColumn("i", _block(blocks, 1)).groupBy("i").applyInPandas(build, _INDEX)


def _block(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """Rows of vectors for which is_query (of ``id``) holds, with their k nearest others: query_id, rank, vec_id, score.

    The cost is queries x rows / blocks of codes and SHARE of that in inner products (all of it if exact), in blocks
    of bounded size: an index block meets a query block in one task.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, key, vector), "ann-vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id bigint, vec_id bigint, score double"
    if not facts.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], dtype=np.float64)
    scale, width = float(facts.norm), facts.width
    rotation = learn_rotation(sample, scale)
    n_blocks, q_blocks = -(-facts.n // BLOCK), -(-max(1, rows.filter(is_query).count()) // QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = materialize(build_index(rows, n_blocks, scale, rotation), "ann-index").withColumn("j", every(q_blocks))
    asked = rows.filter(is_query).withColumn("j", _block(q_blocks, 2)).withColumn("i", every(n_blocks))

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(queries) or not len(block):
            return none
        b = block.iloc[0]
        base_ids, base = np.frombuffer(b["ids"], dtype="<i8"), np.frombuffer(b["vectors"], dtype="<f8").reshape(b["n"], width)
        tables = BlockIndex(np.frombuffer(b["codes"], dtype=np.uint8).reshape(b["n"], -1), np.frombuffer(b["tables"], dtype=np.uint32).reshape(-1, b["n"]))
        q, q_ids = np.array(queries["v"].tolist(), dtype=np.float64), queries["id"].to_numpy()
        codes = encode(q, scale, rotation, True)
        wanted = b["n"] if exact else max(CANDIDATES, int(SHARE * b["n"]))
        out = []
        for i in range(len(q)):
            near = tables.near(codes[i], wanted)
            near = near[base_ids[near] != q_ids[i]]
            scores = (base[near] * q[i]).sum(axis=1)
            if len(near) > k:  # the k best and all that tie with the last
                best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                near, scores = near[best], scores[best]
            order = np.lexsort((base_ids[near], -scores))[:k]
            out.append((np.full(len(order), q_ids[i]), base_ids[near[order]], scores[order]))
        found, others, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": found, "vec_id": others, "score": scores})

    met = asked.groupBy("i", "j").cogroup(index.groupBy("i", "j")).applyInPandas(meet, schema)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
