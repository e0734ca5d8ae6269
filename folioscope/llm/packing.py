"""Operator 4: packing by cutting-stock column generation.

Documents are encoded once and cut into full sequences and one remainder. The
pieces' lengths make a histogram over size classes, multiples of 8 tokens, rounded
up, so a piece never outgrows its slot and loses 7 tokens at most. A linear program
over patterns (how many pieces of each class share one sequence) covers the
histogram; it starts from one pattern a class and a knapsack dynamic program
prices new ones, until the cover is within 0.1 % of what any cover needs. The
solution is rounded down, what is left is filled greedily, largest first, and the
k-th piece of a class takes the k-th slot of that class. The program sees the
histogram alone (capacity / 8 rows at most, whatever the input), never the pieces.

The order of the pieces in a class is (partition of the encoding stage, place in
it), taken from the written table, so it holds when tasks run again. Counts by
(partition, class) give each partition its first rank: no task sees a whole class.

Null texts are empty documents of the end id alone. Repeated rows and null ids
are packed like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import new_path
from folioscope.llm.tokens import encoder, slices

UNIT = 8


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity, each size any number of times."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sorted_sizes, sorted_prices = sizes[order], prices[order]
    fits = np.searchsorted(sorted_sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if n := fits[c]:
            worth = value[c - sorted_sizes[:n]] + sorted_prices[:n]
            best = worth.argmax()
            if worth[best] > value[c]:
                value[c], choice[c] = worth[best], best
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= sorted_sizes[choice[c]]
    return float(value[capacity]), pattern


def cover(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and amounts of a nearly optimal linear cover: revised simplex with columns generated by the knapsack.

    It ends within ``tolerance`` of a lower bound: the space that the pieces take, or the one that the prices imply.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost, inverse = np.ones(m), np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand
    least = sizes @ demand / capacity
    for _ in range(40 * m + 200):
        if cost @ amount <= least * (1 + tolerance):
            break
        dual = cost @ inverse
        if dual.min() < -1e-9:  # more of a class than there is does no harm: a column that takes one away is free
            column, price = np.zeros(m), 0.0
            column[dual.argmin()] = -1.0
        else:
            worth, column = knapsack(sizes, dual, capacity)
            price = 1.0
            if worth <= 1 + tolerance:
                break
        direction = inverse @ column
        ratios = np.full(m, np.inf)
        np.divide(amount, direction, out=ratios, where=direction > 1e-9)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        amount = np.maximum(amount - ratios[out] * direction, 0)
        amount[out] = ratios[out]
        basis[:, out], cost[out] = column, price
        row = inverse[out] / direction[out]
        inverse -= np.multiply.outer(direction, row)
        inverse[out] = row
    return [(basis[:, i].copy(), float(amount[i])) for i in range(m) if cost[i] == 1 and amount[i] > 1e-9]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each size in one sequence, number of such sequences) for a histogram of slot sizes; it fits exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    made: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, most: int) -> None:
        used = np.flatnonzero(pattern)
        times = min([most, *(left[used] // pattern[used])]) if len(used) else 0
        if times > 0:
            left[used] -= times * pattern[used]
            made.append(({int(sizes[i]): int(pattern[i]) for i in used}, int(times)))

    for pattern, amount in sorted(cover(sizes, left.astype(float), capacity), key=lambda x: -x[1]):
        use(np.rint(pattern).astype(np.int64), int(amount + 1e-6))
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        use(pattern, int(left.max()))
    return made


def slots(made: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, lo, hi, each, first): ranks lo <= k < hi of a size go to sequence first + (k - lo) div each."""
    rows, filled, first = [], Counter(), 0
    for pattern, times in made:
        for size, each in pattern.items():
            rows.append((size, filled[size], filled[size] + times * each, each, first))
            filled[size] += times * each
        first += times
    return rows


_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, size int, part int, place bigint, ids binary"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents, with their ids, from a table written once to the shared folder."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, placed = TaskContext.get().partitionId(), Counter()
        for rows, texts in slices(batches, "text"):
            out = []
            for doc_id, ids in zip(rows.column(0).to_pylist(), encoder(tokenizer).encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    size = -(-length // UNIT)
                    out.append((doc_id, start, length, n, size, part, placed[size], ids[4 * start : 4 * (start + length)]))
                    placed[size] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    spark = docs.sparkSession
    path = new_path(spark, "pieces")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """docs (doc_id, text) as pieces of sequences of at most ``capacity`` tokens, a multiple of 8.

    Columns: doc_id, start, length, doc_tokens, ids, ids_crc32,
    sequence_id, offset, sequence_tokens, padded_tokens.

    ``padded_tokens``: what the sequence takes, its own length at a power of two, else the capacity.
    Columns that a caller drops (``ids``, say) are not moved.
    """
    spark = docs.sparkSession
    pieces = cut(docs, tokenizer, end_id, capacity)
    counts = pieces.groupBy("part", "size").count()
    histogram = {r.size: r.n for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # capacity / UNIT rows at most
    made = plan(histogram, capacity // UNIT)
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "size", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    places = spark.createDataFrame(slots(made), "size int, lo bigint, hi bigint, each bigint, first bigint")
    ranked = pieces.withColumn("ids_crc32", F.crc32("ids")).join(bases, ["part", "size"]).withColumn("rank", F.col("base") + F.col("place"))
    # A few slots for each size class at most: bounded by the number of patterns, not by the input.
    s = F.broadcast(places).alias("s")
    r = ranked.alias("r")
    seated = r.join(s, (F.col("r.size") == F.col("s.size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    seated = seated.withColumn("sequence_id", F.expr("first + (rank - lo) div each"))
    own = Window.partitionBy("sequence_id")
    ahead = own.orderBy(F.col("length").desc(), "rank", "r.size").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("length").over(own)
    return seated.select(
        "doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
        total.alias("sequence_tokens"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(capacity)).alias("padded_tokens"),
    )
