"""Density clusters over a neighbour graph: spanning forest, single-linkage tree, condensed tree, noise to the nearest centroid (K2).

Every step is rounds of joins over tables in the checkpoint folder. Ids of points are not negative; a merge of
the single-linkage tree has the negative of its place among the forest's edges as its id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import numbered, settled

#: Edges that one task merges at a time.
BLOCK = 1 << 20
_TINY = 1e-9


def followed(pointers: DataFrame, node: str, to: str) -> DataFrame:
    """pointers (node, to) followed to their ends (a node without a row, or one that points to itself), by doubling: each round halves what is left of a chain."""
    now = settled(pointers.select(node, to))
    while True:
        step = now.select(F.col(node).alias("_n"), F.col(to).alias("_t"))
        ahead = now.join(step, F.col(to) == F.col("_n"), "left")
        after = settled(ahead.select(node, F.coalesce("_t", to).alias(to), (F.coalesce("_t", to) != F.col(to)).alias("_moved")))
        moved = not after.filter("_moved").isEmpty()
        now = after.drop("_moved")
        if not moved:
            return now


def reachability(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """Edges (a, b, w) with a < b of a neighbour graph (i, rank, j, dist): the greatest of their length and both ends' core distances.

    The core distance is that to the min_samples-th nearest, the point itself being the first.
    """
    neighbours = settled(neighbours)  # read more than once, and an exact graph compares all pairs
    core = neighbours.groupBy("i").agg(F.max(F.when(F.col("rank") <= min_samples - 1, F.col("dist"))).alias("core")).select("i", F.coalesce("core", F.lit(0.0)).alias("core"))
    pairs = neighbours.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("dist").alias("dist")).filter("a < b")
    ends = [core.withColumnsRenamed({"i": e, "core": f"core_{e}"}) for e in "ab"]
    met = pairs.join(ends[0], "a").join(ends[1], "b", "left")
    return met.select("a", "b", F.greatest("dist", "core_a", F.coalesce("core_b", F.lit(0.0))).alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of edges (a, b, w) by Boruvka's rounds; equal weights go by a, then b.

    In each round every component takes its least edge to another; of two that take the same edge one stays, the
    others point to what they took, and the pointers are followed to their ends. Components at least halve.
    """
    edges = settled(edges.select("a", "b", "w").distinct())
    names = settled(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("c", F.col("node")))
    forest = None
    while True:
        one, two = (names.withColumnsRenamed({"node": e, "c": f"c{e}"}) for e in "ab")
        edges = settled(edges.drop("ca", "cb").join(one, "a").join(two, "b").filter("ca != cb"))
        if edges.isEmpty():
            break
        sides = edges.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to")))).alias("s"), F.struct("w", "a", "b").alias("e"))
        least = settled(sides.groupBy("s.c").agg(F.min_by("s.to", "e").alias("to"), F.min("e").alias("e")))
        found = least.select("e.*").distinct()
        forest = settled(found if forest is None else forest.unionByName(found))
        back = least.select(F.col("c").alias("to"), F.col("to").alias("back"))
        pointers = least.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        ends = followed(pointers, "c", "to")
        names = settled(names.join(ends, "c", "left").select("node", F.coalesce("to", "c").alias("c")))
    return edges.select("a", "b", "w") if forest is None else forest.select("a", "b", "w")


def linkage(forest: DataFrame) -> DataFrame:
    """The single-linkage tree of a forest: merges (node, left, right, w, size).

    Edges are merged in order of weight, BLOCK of them in one task at a time; what a task reads of earlier blocks is
    the name and size of the two clusters that each edge joins.
    """
    ranked = settled(numbered(forest, [F.col("w"), F.col("a"), F.col("b")], "rank").withColumn("block", F.expr(f"(rank - 1) div {BLOCK}")))
    names = settled(forest.select(F.explode(F.array("a", "b")).alias("point")).distinct().select("point", F.col("point").alias("root"), F.lit(1).cast("long").alias("size")))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows, over, size, out = rows.sort_values("rank"), {}, {}, []

        def top(x: int) -> int:
            path = []
            while x in over:
                path.append(x)
                x = over[x]
            for p in path[:-1]:
                over[p] = x
            return x

        for rank, w, a, n, b, m in rows[["rank", "w", "root_a", "size_a", "root_b", "size_b"]].itertuples(index=False):
            size.setdefault(a, n)
            size.setdefault(b, m)
            left, right = top(a), top(b)
            over[left] = over[right] = -rank
            size[-rank] = size[left] + size[right]
            out.append((-rank, left, right, w, size[-rank], None))
        out += [(top(x), x, None, None, size[top(x)], True) for x in {*rows["root_a"], *rows["root_b"]}]  # where the clusters of before are now
        frame = pd.DataFrame(out, columns=["node", "left", "right", "w", "size", "moved"])
        return frame.astype({"right": "Int64", "moved": "boolean"})

    merges, blocks = None, ranked.agg(F.max("block")).first()[0]
    for block in range(0 if blocks is None else blocks + 1):
        one, two = (names.select(F.col("point").alias(e), F.col("root").alias(f"root_{e}"), F.col("size").alias(f"size_{e}")) for e in "ab")
        rows = ranked.filter(F.col("block") == block).join(one, "a").join(two, "b")
        done = settled(rows.groupBy("block").applyInPandas(merge, "node bigint, left bigint, right bigint, w double, size bigint, moved boolean"))
        found = done.filter("moved is null").drop("moved")
        merges = found if merges is None else merges.unionByName(found)
        if block < blocks:
            now = done.filter("moved").select(F.col("left").alias("root"), F.col("node").alias("_now"), F.col("size").alias("_size"))
            names = settled(names.join(now, "root", "left").select("point", F.coalesce("_now", "root").alias("root"), F.coalesce("_size", "size").alias("size")))
    if merges is None:
        return forest.sparkSession.createDataFrame([], "node bigint, left bigint, right bigint, w double, size bigint")
    return settled(merges)


def condensed(merges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, birth, size, stability) of at least min_size points, and points (point, cluster): the cluster each falls out of.

    Merges of at least min_size points whose smaller side is less only lose points; a run of them down to a split into
    two such sides, or to the last, is one cluster, named by the merge at its lower end.
    """
    lam = (1 / F.greatest("w", F.lit(_TINY))).alias("lam")
    sides = merges.select("node", "size", lam, F.explode(F.array("left", "right")).alias("child"))
    sizes = merges.select(F.col("node").alias("child"), F.col("size").alias("child_size"))
    sides = settled(sides.join(sizes, "child", "left").withColumn("child_size", F.coalesce("child_size", F.lit(1))))
    big, heavy = sides.filter(F.col("size") >= min_size), F.col("child_size") >= min_size
    kinds = settled(big.groupBy("node").agg(F.max("size").alias("size"), F.max("lam").alias("lam"), F.count_if(heavy).alias("n_heavy"), F.max(F.when(heavy, F.col("child"))).alias("heavy")))
    ends = followed(kinds.select("node", F.when(F.col("n_heavy") == 1, F.col("heavy")).otherwise(F.col("node")).alias("cluster")), "node", "cluster")
    owned = settled(kinds.join(ends, "node"))
    light = big.filter(~heavy).join(ends, "node").groupBy("cluster").agg(F.sum(F.col("child_size") * F.col("lam")).alias("fallen"))
    split = owned.filter("n_heavy = 2").select(F.col("node").alias("cluster"), (F.col("size") * F.col("lam")).alias("divided"))
    above = big.filter(heavy).join(kinds.filter("n_heavy = 2").select("node"), "node").select(F.col("child").alias("node"), F.col("node").alias("parent"), F.col("lam").alias("birth"))
    tops = owned.join(big.filter(heavy).join(kinds.filter("n_heavy = 1").select("node"), "node").select(F.col("child").alias("node")), "node", "left_anti")
    tops = tops.join(above, "node", "left").select("cluster", "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"), "size")
    total = F.coalesce("fallen", F.lit(0.0)) + F.coalesce("divided", F.lit(0.0))
    clusters = tops.join(light, "cluster", "left").join(split, "cluster", "left").select("cluster", "parent", "birth", "size", (total - F.col("size") * F.col("birth")).alias("stability"))
    small = sides.select(F.col("child").alias("node"), F.col("node").alias("up"), "size", "child_size").filter(~heavy)
    landed = followed(small.select("node", F.col("up")), "node", "up")  # the first merge above of min_size points has no row
    points = landed.filter("node >= 0").join(ends.withColumnRenamed("node", "up"), "up", "left").select(F.col("node").alias("point"), "cluster")
    return settled(clusters), points


def selected(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): the cluster at or above each that is worth more than what lies below it (excess of mass), null if none.

    A tree's only root is no choice; of several trees the roots are. What lies below a cluster has earlier merges, so clusters are
    weighed in order of their merges, those of BLOCK merges in one task at a time: the rounds do not follow the depth of the tree.
    """
    alone = clusters.filter("parent is null").limit(2).count() < 2
    ranked = settled(clusters.select("cluster", F.coalesce("parent", F.lit(0)).alias("parent"), "stability", F.expr(f"(-cluster - 1) div {BLOCK}").alias("block")))

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        below, out = {}, []
        for cluster, parent, stability, held in rows.sort_values("cluster", ascending=False)[["cluster", "parent", "stability", "held"]].itertuples(index=False, name=None):
            under = held + below.pop(cluster, 0.0)
            takes = stability >= under and not (alone and not parent)
            worth = stability if takes else under
            if parent:
                below[parent] = below.get(parent, 0.0) + worth
            out.append((cluster, parent, worth, takes))
        return pd.DataFrame(out, columns=["cluster", "parent", "worth", "takes"])

    done, blocks = None, ranked.agg(F.max("block")).first()[0]
    for block in range(0 if blocks is None else blocks + 1):
        rows = ranked.filter(F.col("block") == block)
        if done is None:
            rows = rows.withColumn("held", F.lit(0.0))
        else:
            earlier = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("held"))
            rows = rows.join(earlier, "cluster", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
        found = settled(rows.groupBy("block").applyInPandas(weigh, "cluster bigint, parent bigint, worth double, takes boolean"))
        done = found if done is None else done.unionByName(found)
    if done is None:
        return clusters.select("cluster", F.lit(None).cast("long").alias("chosen"))
    now = settled(done.select("cluster", F.nullif("parent", F.lit(0)).alias("up"), F.when(F.col("takes"), F.col("cluster")).alias("chosen")))
    while not now.filter("up is not null").isEmpty():  # the topmost choice at or above, by doubling
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("chosen").alias("_chosen"))
        now = settled(now.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_chosen", "chosen").alias("chosen")))
    return now.select("cluster", "chosen")


def nearest_centroid(points: DataFrame, centres: DataFrame, block: int = 4096) -> DataFrame:
    """point, cluster: the nearest of centres (cluster, centre) to each of points (point, embedding), ties to the lesser; block against block."""
    counted = lambda d: -(-max(1, d.count()) // block)
    n, m = counted(points), counted(centres)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = points.select("point", "embedding", F.pmod(F.xxhash64("point"), F.lit(n)).cast("int").alias("p")).withColumn("q", every(m))
    right = centres.select("cluster", "centre", F.pmod(F.xxhash64("cluster"), F.lit(m)).cast("int").alias("q")).withColumn("p", every(n))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"point": [], "cluster": [], "d": []}).astype({"point": "int64", "cluster": "int64", "d": "float64"})
        b = b.sort_values("cluster")
        x, y = np.array(a["embedding"].tolist()), np.array(b["centre"].tolist())
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in y], axis=1)
        at = d.argmin(axis=1)
        return pd.DataFrame({"point": a["point"].to_numpy(), "cluster": b["cluster"].to_numpy()[at], "d": d[np.arange(len(a)), at]})

    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "point bigint, cluster bigint, d double")
    return met.groupBy("point").agg(F.min(F.struct("d", "cluster")).alias("s")).select("point", F.col("s.cluster").alias("cluster"))


def density_clusters(chunks: DataFrame, neighbours: DataFrame, min_size: int, min_samples: int) -> DataFrame:
    """chunk_id, cluster (from 0, by least member), noise: clusters of a neighbour graph (i, rank, j, dist) over chunks (chunk_id, embedding).

    Trees of the graph's spanning forest that no edge joins count as joined at no density. Points that no cluster holds are
    noise and go to the cluster of the nearest centroid; where there is no cluster at all, cluster is -1.
    """
    merges = linkage(spanning_forest(reachability(neighbours, min_samples)))
    clusters, points = condensed(merges, min_size)
    labelled = points.join(selected(clusters), "cluster", "left").select("point", "chosen")
    placed = settled(chunks.select(F.col("chunk_id").alias("point"), "embedding").join(labelled, "point", "left"))
    order = placed.filter("chosen is not null").groupBy("chosen").agg(F.min("point").alias("first"))
    names = settled(numbered(order, [F.col("first")], "cluster").select("chosen", (F.col("cluster") - 1).alias("cluster")))
    held = placed.join(names, "chosen").select("point", "cluster", "embedding")
    centres = held.groupBy("cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("centre"))
    noise = placed.filter("chosen is null").select("point", "embedding")
    near = noise.join(nearest_centroid(noise, settled(centres)), "point", "left").select("point", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.lit(True).alias("noise"))
    return held.select("point", "cluster", F.lit(False).alias("noise")).unionByName(near).withColumnRenamed("point", "chunk_id")
