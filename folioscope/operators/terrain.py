"""The map's relief: blur as by a truncated Gaussian with mirrored borders, the voids between the peaks (K3, K7), tours of constellations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.atlas import cells
from folioscope.operators.ranks import settled


def gaussian_weights(sigma: float) -> list[float]:
    """Weights at the distances -r to r, r being four sigmas, rounded; their sum is one."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def blurred(grid: DataFrame, side: int, sigma: float) -> DataFrame:
    """grid (gx, gy, v; cells without a row are zero) blurred along both axes; beyond a border the map is mirrored.

    A cell sends its value, and that of its mirror images, to the cells around. A map has side x side cells however many points it shows.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    kernel = F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(weights)])
    turns = range(-(r // (2 * side) + 1), r // (2 * side) + 2)
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        images = F.array(*[e for t in turns for e in (F.col(axis) + 2 * side * t, -1 - F.col(axis) + 2 * side * t)])
        near = F.filter(images, lambda e: e.between(-r, side - 1 + r))
        sent = grid.select(other, "v", F.explode(near).alias("_e")).select(other, "v", "_e", F.explode(kernel).alias("k"))
        moved = sent.select((F.col("_e") + F.col("k.d")).cast("int").alias(axis), other, (F.col("v") * F.col("k.w")).alias("v"))
        grid = moved.filter(F.col(axis).between(0, side - 1)).groupBy(axis, other).agg(F.sum("v").alias("v"))
    return grid.select("gx", "gy", "v")


def relief(points: DataFrame, side: int, wide: float = 6.0, narrow: float = 2.0, reach: float = 10.0, share: float = 0.02) -> DataFrame:
    """gx, gy, v, occupied of all cells that a point of (x, y) lifts: log heights of a wide and, by 0.35, a narrow blur, the highest being one; occupied where points are about."""
    counts = settled(cells(points, "x", "y", side).groupBy("gx", "gy").agg(F.count("*").cast("double").alias("v")))
    both = blurred(counts, side, wide).unionByName(blurred(counts, side, narrow).withColumn("v", 0.35 * F.col("v")))
    raised = settled(both.groupBy("gx", "gy").agg(F.log1p(F.sum("v")).alias("h")))
    top = F.broadcast(raised.agg(F.max("h").alias("top")))  # one row
    about = blurred(counts.withColumn("v", F.lit(1.0)), side, reach).withColumnRenamed("v", "about")
    joined = raised.crossJoin(top).join(about, ["gx", "gy"], "full")
    return joined.select("gx", "gy", F.coalesce(F.col("h") / F.col("top"), F.lit(0.0)).alias("v"), (F.coalesce("about", F.lit(0.0)) > share).alias("occupied"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges (a, b), in both directions, reach), by rounds: the least of the neighbours' components, then two steps along the pointers."""
    now = settled(nodes.select("node", F.col("node").alias("component")))
    edges = settled(edges.select("a", "b").distinct())
    while True:
        near = edges.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        least = now.join(near, "node", "left").select("node", F.col("component").alias("_was"), F.least("component", F.coalesce("_m", "component")).alias("component"))
        up = least.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        after = settled(least.join(up, "component", "left").select("node", "_was", F.coalesce("_up", "component").alias("component")))
        still = after.filter("component != _was").isEmpty()
        now = after.drop("_was")
        if still:
            return now


def voids(heights: DataFrame, side: int, below: float = 0.10, least_area: int = 40, top: int = 10) -> DataFrame:
    """void (its least cell), area, x, y: the largest low regions of relief() that points surround, cells joined by their sides."""
    low = heights.filter((F.col("v") < below) & F.col("occupied")).select((F.col("gy") * side + F.col("gx")).alias("node"), "gx", "gy")
    low = settled(low)
    right = low.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).filter(F.col("b") % side != 0)
    down = low.select(F.col("node").alias("a"), (F.col("node") + side).alias("b"))
    pairs = right.unionByName(down).join(low.select(F.col("node").alias("b")), "b", "left_semi")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = low.join(connected(low, both), "node").groupBy(F.col("component").alias("void"))
    sized = found.agg(F.count("*").alias("area"), (F.avg("gx") / side).alias("x"), (F.avg("gy") / side).alias("y"))
    return sized.filter(F.col("area") >= least_area).orderBy(F.desc("area"), "void").limit(top)


def around(places: DataFrame, points: DataFrame, key: str, k: int = 12) -> DataFrame:
    """key, rank, chunk_id: the k points (chunk_id, x, y) nearest to each of a few places (key, x, y), such as voids() gives.

    One scan of the points; the k nearest are cut in each task before they meet.
    """
    at = F.broadcast(places.select(key, F.col("x").alias("_x"), F.col("y").alias("_y")))
    d = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    met = points.crossJoin(at).select(key, "chunk_id", F.round(d, 12).alias("_d"))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_d", "chunk_id")))
    return ranked.filter(F.col("rank") <= k).select(key, "rank", "chunk_id")


def tour(members: DataFrame, anchors: DataFrame, group: str, order: str = "seq") -> DataFrame:
    """group, step, seq: a way through each group's members (group, seq, x, y), from the one nearest to its anchor (group, x, y), always to the nearest not yet met.

    Equally near ones go by seq. Groups are constellations of a dozen members; each is one row while its way is found.
    """
    m = F.struct(F.col(order).alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    grouped = members.groupBy(group).agg(F.sort_array(F.collect_list(m)).alias("left")).join(anchors.select(group, F.col("x").alias("ax"), F.col("y").alias("ay")), group)

    def nearest(rest: Column, x: Column, y: Column) -> Column:
        return F.array_min(F.transform(rest, lambda p: F.struct((F.pow(p["x"] - x, 2) + F.pow(p["y"] - y, 2)).alias("d"), p["seq"].alias("seq"), p.alias("p"))))["p"]

    def step(acc: Column, _: Column) -> Column:
        here = F.element_at(acc["way"], -1)
        next_one = nearest(acc["rest"], here["x"], here["y"])
        return F.struct(F.concat(acc["way"], F.array(next_one)).alias("way"), F.filter(acc["rest"], lambda p: p["seq"] != next_one["seq"]).alias("rest"))

    first = grouped.withColumn("first", nearest(F.col("left"), F.col("ax"), F.col("ay")))
    start = F.struct(F.array("first").alias("way"), F.filter("left", lambda p: p["seq"] != F.col("first.seq")).alias("rest"))
    steps = F.when(F.size("left") > 1, F.sequence(F.lit(2), F.size("left"))).otherwise(F.array().cast("array<int>"))
    whole = first.select(group, F.aggregate(steps, start, step)["way"].alias("way"))
    return whole.select(group, F.posexplode("way").alias("_i", "p")).select(group, (F.col("_i") + 1).alias("step"), F.col("p.seq").alias(order))
