"""Operator 11: hard negatives by coordinate pruning over length buckets.

Components become integers, so scores (inner products) are exact. Rows are ranked by length
and cut into buckets, each indexed once: its vectors, the greatest length and, for every
coordinate, the rows in order of that coordinate of their unit vectors. A search for scores
of at least a threshold t asks of a bucket an angle of at most acos(t / (anchor's length x
greatest length)); a bucket that would need a cosine above one is left out. A unit vector
within that angle of the anchor has, in each coordinate, a value within the same angle of the
anchor's own, which is a range of the sorted list. The ranges of the anchor's ``FOCUS``
largest coordinates are cut out; the shortest gives candidates and the others thin them; what
remains is verified by its inner product.

Thresholds rise as rows are found: rows at the ends of the first bucket's focus lists are
verified first, then the k-th best so far is the threshold. For negatives the threshold is
the least over an anchor's positives of what each still asks for, at least ``low`` percent of
the positive's score; the upper limit (``high`` percent) is applied to verified scores.

A block of anchors meets a few buckets in one task; tasks' best are merged by rank. The
result is exact. How much is pruned depends on the vectors: where they fill all directions
evenly the ranges span most values and nearly all rows are verified.

Rows take part if id, label and vector are not null and the vector is of the most common
length (the longest of equally common ones) and holds no null or non-finite component. Of
equal ids the least label, then least vector, stands for all. Ties go to the smaller id. An
anchor without others of its label gives no rows, nor does a positive with a score below 0.
Scores beyond 2^55 raise ValueError. Empty tables give an empty result; further columns are
left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.prefix import prefix_sums

#: Components of a bucket, buckets and anchors of a task.
BUCKET, BUCKETS, ANCHORS = 1 << 18, 2, 1024
#: Focus coordinates of an anchor; rows verified first at the end of each of their lists.
FOCUS, SEEDS = 6, 32
_SLACK = 1e-9


class Bucket:
    """Rows of alike length in order of each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: np.ndarray | None = None):
        self.ids, self.labels = ids, labels
        exact = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2**53
        self.vectors = vectors.astype(np.float64 if exact else np.int64)  # sums of integers below 2^53 are exact as doubles
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(lengths.max(initial=0))
        self.unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
        self.lists = np.argsort(self.unit, axis=0, kind="stable").T.astype(np.uint32) if lists is None else lists
        self.sorted: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        if f not in self.sorted:
            self.sorted[f] = self.unit[self.lists[f], f]
        return self.sorted[f]

    def scores(self, rows: np.ndarray | None, anchor: np.ndarray) -> np.ndarray:
        some = rows is not None and 2 * len(rows) < len(self.ids)
        found = (self.vectors[rows] if some else self.vectors) @ anchor.astype(self.vectors.dtype)
        return (found if some or rows is None else found[rows]).astype(np.int64)

    def ends(self, anchor: np.ndarray, focus: np.ndarray) -> np.ndarray:
        """Rows with the most of the anchor's sign in its focus coordinates."""
        return np.unique(np.concatenate([self.lists[f][-SEEDS:] if anchor[f] > 0 else self.lists[f][:SEEDS] for f in focus.tolist()]))

    def candidates(self, anchor: np.ndarray, length: float, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more; None for all."""
        if least <= 0:
            return None
        cosine = least / (length * self.longest) if length * self.longest > 0 else 2.0
        if cosine > 1 + _SLACK:
            return np.zeros(0, dtype=np.int64)
        angle, own = np.arccos(min(1.0, cosine)), np.arccos(np.clip(anchor[focus] / length, -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - _SLACK
        high = np.cos(np.maximum(0.0, own - angle)) + _SLACK
        ranges = []
        for f, a, b in zip(focus.tolist(), low.tolist(), high.tolist(), strict=True):
            values = self.values(f)
            i, j = np.searchsorted(values, [a, b + _SLACK])
            ranges.append((int(j - i), f, int(i), int(j), a, b))
        n, f, i, j, _, _ = min(ranges)
        if n == len(self.ids):
            return None
        rows = self.lists[f][i:j]
        for n, g, _, _, a, b in sorted(ranges)[1:]:
            if n < len(self.ids) and len(rows):
                x = self.unit[rows, g]
                rows = rows[(x >= a) & (x <= b)]
        return rows


class Best:
    """The k first of what has been found, higher scores first, then smaller ids."""

    def __init__(self, k: int, least: float = -np.inf):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        more = scores >= self.least
        more[more] = ~np.isin(ids[more], self.ids)  # seeds are met again
        scores, ids = np.concatenate([self.scores, scores[more]]), np.concatenate([self.ids, ids[more]])
        if len(scores) > self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


def _walk(buckets: list[Bucket], anchor: np.ndarray, least, take) -> None:
    """Hand the rows of each bucket that may score least() or more, with their scores, to take()."""
    length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
    focus = np.argsort(-np.abs(anchor), kind="stable")[:FOCUS]
    for nth, bucket in enumerate(buckets):
        if nth == 0:
            rows = bucket.ends(anchor, focus)
            take(bucket, rows, bucket.scores(rows, anchor))
        rows = bucket.candidates(anchor, length, focus, least())
        if rows is None or len(rows):
            take(bucket, rows, bucket.scores(rows, anchor))


def nearest_of_label(buckets: list[Bucket], own: int, label: str, anchor: np.ndarray, k: int) -> Best:
    best = Best(k)

    def take(bucket: Bucket, rows: np.ndarray | None, scores: np.ndarray) -> None:
        every = slice(None) if rows is None else rows
        fit = (bucket.labels[every] == label) & (bucket.ids[every] != own)
        best.add(scores[fit], bucket.ids[every][fit])

    _walk(buckets, anchor, lambda: best.least, take)
    return best


def nearest_below(buckets: list[Bucket], label: str, anchor: np.ndarray, positives: list[int], k: int, low: int, high: int) -> list[Best]:
    """For each positive's score, the k best of another label from low to high percent of it."""
    best = [Best(k, float(-(-low * p // 100))) for p in positives]
    open_ones = [(b, p) for b, p in zip(best, positives, strict=True) if low * p <= high * p]

    def take(bucket: Bucket, rows: np.ndarray | None, scores: np.ndarray) -> None:
        every = slice(None) if rows is None else rows
        fit = (bucket.labels[every] != label) & (scores >= min(b.least for b, _ in open_ones))
        scores, ids = scores[fit], bucket.ids[every][fit]
        for b, p in open_ones:
            inside = (low * p <= 100 * scores) & (100 * scores <= high * p)
            b.add(scores[inside], ids[inside])

    if open_ones:
        _walk(buckets, anchor, lambda: min(b.least for b, _ in open_ones), take)
    return best


def usable(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label (string), v (array of integers) of the rows that take part, one for each id."""
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine & (F.size("x") > 0))
    facts = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not facts:
        return rows.select("id", "label", F.col("x").cast("array<bigint>").alias("v")).limit(0)
    if (scale * facts[0].largest + 1) ** 2 * facts[0].n >= 2**55:
        raise ValueError(f"components up to {facts[0].largest} give scores beyond 64 bits")
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("long"))
    return rows.filter(F.size("x") == facts[0].n).groupBy("id").agg(F.min(F.struct("label", whole.alias("v"))).alias("s")).select("id", "s.label", "s.v")


_INDEX = "bucket bigint, n int, ids binary, labels array<string>, vectors binary, lists binary"


def build_index(rows: DataFrame, width: int) -> DataFrame:
    """One row a length bucket, longest vectors in bucket 0."""
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    ranked = prefix_sums(rows.withColumn("_length", length).withColumn("_one", F.lit(1)), [F.desc("_length"), F.col("id")], "_one", "length-ranks")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.array(group["v"].tolist(), dtype="<i8")
        made = Bucket(group["id"].to_numpy(), group["label"].to_numpy(), x)
        row = group["bucket"].iloc[0], len(x), made.ids.astype("<i8").tobytes(), group["label"].tolist(), x.tobytes(), made.lists.astype("<u4").tobytes()
        return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])

    return ranked.select("id", "label", "v", F.expr(f"_rank div {max(256, BUCKET // width)}").alias("bucket")).groupBy("bucket").applyInPandas(build, _INDEX)


def _read(rows: pd.DataFrame) -> list[Bucket]:
    found = []
    for r in rows.sort_values("bucket").itertuples():
        vectors, lists = np.frombuffer(r.vectors, dtype="<i8").reshape(r.n, -1), np.frombuffer(r.lists, dtype="<u4").reshape(-1, r.n)
        found.append(Bucket(np.frombuffer(r.ids, dtype="<i8"), np.array(r.labels, dtype=object), vectors, lists))
    return found


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows for which is_anchor (of ``id``) holds.

    Positives are an anchor's first rows of the same label; negatives are, for each of them, the first rows of other
    labels that score from ``low`` to ``high`` percent of the positive. The cost is anchors x rows of what pruning leaves.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, key, label, vector, scale), "negatives-rows")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts.n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    index = materialize(build_index(rows, facts.width), "negatives-index")
    n_groups = -(-index.count() // BUCKETS)
    anchors = rows.filter(is_anchor)
    n_blocks = -(-max(1, anchors.count()) // ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = index.withColumn("j", (F.col("bucket") % n_groups).cast("int")).withColumn("i", every(n_blocks))

    def meet(asked: DataFrame, schema: str, judge) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            buckets = _read(others)
            found = [row for a in mine.itertuples() for row in judge(buckets, a)] if buckets else []
            return pd.DataFrame(found, columns=names).astype("int64")

        placed = asked.withColumn("i", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_blocks)).cast("int")).withColumn("j", every(n_groups))
        return placed.groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInPandas(run, schema)

    def for_positives(buckets: list[Bucket], a) -> list[tuple]:
        best = nearest_of_label(buckets, a.id, a.label, np.array(a.v, dtype=np.int64), positives)
        return [(a.id, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]

    def for_negatives(buckets: list[Bucket], a) -> list[tuple]:
        known = [(int(p["positive_id"]), int(p["score"])) for p in a.positives]
        best = nearest_below(buckets, a.label, np.array(a.v, dtype=np.int64), [s for _, s in known], negatives, low, high)
        return [(a.id, p, i, s, t) for (p, s), b in zip(known, best, strict=True) for i, t in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    pairs = meet(anchors, "anchor_id bigint, positive_id bigint, score bigint", for_positives).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives)
    chosen = materialize(pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives")), "negatives-positives")
    found = meet(anchors.join(chosen, "id"), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint", for_negatives)
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
