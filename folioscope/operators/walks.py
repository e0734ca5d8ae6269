"""Ways over the map: geodesics, stations, random walks, peaks, temperature bands (V7, V9, V10, the peaks of K8, T50)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.atlas import slerp
from folioscope.operators.ranks import settled
from folioscope.operators.search import cosine, norm

#: Upper ends of the bands of a temperature: fixed values.
BANDS = ((20, "freezing"), (40, "cold"), (55, "cool"), (70, "warm"), (85, "hot"))


def temperature_band(t: Column) -> Column:
    found = F.when(t < BANDS[0][0], BANDS[0][1])
    for end, label in BANDS[1:]:
        found = found.when(t < end, label)
    return found.when(t.isNotNull(), "scorching")


def geodesic(chunks: DataFrame, ends: DataFrame, steps: int = 11, pool: int = 12, keep: int = 5) -> DataFrame:
    """step, rank, chunk_id, file_path, score, x, y: what lies nearest along the great circle from a to b.

    chunks: chunk_id, file_path, embedding, x, y; ends: one row (a, b). Each step takes its ``pool`` nearest chunks
    and of them the best of ``keep`` files. All steps are searched in one scan, cut by group limits before the shuffle.
    """
    unit = lambda c: F.transform(c, lambda x: x / (norm(c) + 1e-9))
    way = ends.limit(1).select(unit("a").alias("a"), unit("b").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    way = way.select("step", slerp(F.col("a"), F.col("b"), F.col("step") / (steps - 1)).alias("q"))  # ``steps`` rows
    scored = chunks.crossJoin(F.broadcast(way)).withColumn("score", F.round(cosine("embedding", "q"), 9)).select("step", "chunk_id", "file_path", "score", "x", "y")
    first = lambda rows, by, k, name: rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))).filter(F.col(name) <= k)
    near = first(scored, ["step"], pool, "_near").drop("_near")
    return first(first(near, ["step", "file_path"], 1, "_best").drop("_best"), ["step"], keep, "rank")


def step_centres(hits: DataFrame) -> DataFrame:
    """step, x, y: the centre of a step's hits by the fourth power of their scores."""
    w = F.pow(F.greatest("score", F.lit(0.01)), F.lit(4))
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return hits.groupBy("step").agg(mean("x"), mean("y"))


def station(hits: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where a query's hits (chunk_id, score; a top-k) lie on the map: one row (x, y, top), none for fewer than three hits
    on it, and the hits with their weight (0.3 to 1)."""
    met = points.join(F.broadcast(hits.select("chunk_id", "score")), "chunk_id")
    ends = met.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count("*").alias("_n")).filter("_n >= 3")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    weighted = met.crossJoin(F.broadcast(ends)).withColumn("weight", 0.3 + 0.7 * (F.col("score") - F.col("_lo")) / span)
    w = F.col("weight") * F.col("weight")
    centre = weighted.agg(*((F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("x", "y")), F.min_by("chunk_id", F.struct(-F.col("score"), "chunk_id")).alias("top"))
    return centre.filter("top is not null"), weighted.groupBy("chunk_id").agg(F.max("weight").alias("weight"))


def signals(points: DataFrame, centre: DataFrame, hits: DataFrame, sigma: float = 0.16) -> DataFrame:
    """chunk_id, signal: how strongly each point hears a station, by distance and as a hit; 0 where there is no station."""
    at = F.broadcast(centre.select(F.col("x").alias("_x"), F.col("y").alias("_y")))
    near = F.exp(-(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)) / (sigma * sigma))
    heard = points.join(at, F.lit(True), "left").join(F.broadcast(hits), "chunk_id", "left")
    return heard.select("chunk_id", F.when(near.isNull(), 0.0).otherwise(F.least(F.lit(1.0), 0.62 * near + 0.5 * F.coalesce("weight", F.lit(0.0)))).alias("signal"))


#: What a walk's step weighs, fixed values: likeness, staying, going back, having been there and how soon that is forgotten, progress, a hit, temperature.
LIKENESS, STAY, BACK, SEEN, FORGET, PROGRESS, HIT, TEMPERATURE = 2.4, 4.0, 1.7, 1.25, 14.0, 2.7, 1.6, 0.5


def walk(graph: DataFrame, starts: DataFrame, steps: int, draw: Column, station: tuple[DataFrame, DataFrame, DataFrame] | None = None, bias: float = 0.0) -> DataFrame:
    """walk, step, node: random walks over a neighbour graph (i, rank, j, sim) from starts (walk, node), side by side.

    Each step is drawn among the node's neighbours by a softmax of likeness less what was met before (the sooner, the
    more) and, with a station (points, centre, hits as ``station`` takes and gives them), plus ``bias`` times the
    progress towards it. ``draw``: a number from 0 to 1 for a walk and step. A walk without neighbours ends.
    """
    if station is None:
        sides = graph.select("i", "rank", "j", "sim", F.lit(0.0).alias("gain"), F.lit(0.0).alias("hit"))
    else:
        points, centre, hits = station
        at = F.broadcast(centre.select(F.col("x").alias("_x"), F.col("y").alias("_y")))  # one row
        far = points.crossJoin(at).select(F.col("chunk_id").alias("j"), F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("d"))
        near = graph.join(far, "j").join(far.select(F.col("j").alias("i"), F.col("d").alias("e")), "i").join(hits.select(F.col("chunk_id").alias("j"), F.col("weight").alias("hit")), "j", "left")
        sides = near.select("i", "rank", "j", "sim", (F.col("e") - F.col("d")).alias("gain"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    lists = settled(sides.groupBy(F.col("i").alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "j", "sim", "gain", "hit"))).alias("near")))
    widest = F.greatest(F.lit(1e-6), F.array_max(F.transform("near", lambda c: F.abs(c["gain"]))))

    def worth(c: Column) -> Column:
        met = F.array_position("trail", c["j"])  # the last first; 0: never
        own = LIKENESS * c["sim"] - F.when(c["j"] == F.col("node"), STAY).otherwise(0.0) - F.when(c["j"] == F.col("previous"), BACK).otherwise(0.0)
        own = own - F.when(met > 0, SEEN * F.exp(-(met - 1) / FORGET)).otherwise(0.0)
        return (own + bias * PROGRESS * c["gain"] / widest + bias * HIT * c["hit"]) / TEMPERATURE

    now = starts.select("walk", F.lit(0).alias("step"), "node", F.lit(None).cast("long").alias("previous"), F.array("node").alias("trail"))
    out = now = settled(now)
    for _ in range(steps):
        weighed = now.join(lists, "node").withColumn("step", F.col("step") + 1).withColumn("w", F.transform("near", worth))
        shares = weighed.withColumn("w", F.transform("w", lambda v: F.exp(v - F.array_max("w"))))
        upto = F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.aggregate(F.slice("w", F.lit(1), n), F.lit(0.0), lambda a, x: a + x))
        drawn = shares.withColumn("upto", upto).withColumn("r", draw * F.element_at("upto", -1))
        chosen = F.least(F.size("near"), 1 + F.size(F.filter("upto", lambda x: x < F.col("r"))))
        taken = drawn.select("walk", "step", F.element_at("near", chosen)["j"].alias("to"), "node", "trail")
        now = settled(taken.select("walk", "step", F.col("to").alias("node"), F.col("node").alias("previous"), F.concat(F.array("to"), "trail").alias("trail")))
        out = out.unionByName(now)
    return out.select("walk", "step", "node")


def peaks(heights: DataFrame, side: int, least: float = 0.12, radius: float = 0.105, cap: int = 22) -> DataFrame:
    """rank, gx, gy, v: cells inside the map no lower than their eight neighbours, highest first, none within ``radius`` of a higher one.

    A map has side x side cells however many points it shows, so the fold over its maxima is bounded by the side.
    """
    deltas = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    around = heights.select("gx", "gy", "v", F.explode(deltas).alias("d")).groupBy((F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy")).agg(F.max("v").alias("m"))
    inner = heights.filter((F.col("v") >= least) & F.col("gx").between(1, side - 2) & F.col("gy").between(1, side - 2))
    maxima = inner.join(around, ["gx", "gy"], "left").filter(F.col("v") >= F.coalesce("m", F.lit(0.0)))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("h"), "gy", "gx")))
    far = lambda p, q: F.hypot((p["gx"] - q["gx"]) / (side - 1), (p["gy"] - q["gy"]) / (side - 1)) > radius
    none = F.array().cast("array<struct<h:double,gy:int,gx:int>>")
    chosen = F.aggregate("all", none, lambda acc, p: F.when((F.size(acc) < cap) & F.forall(acc, lambda q: far(p, q)), F.concat(acc, F.array(p))).otherwise(acc))
    return maxima.agg(listed.alias("all")).select(F.posexplode(chosen).alias("i", "p")).select((F.col("i") + 1).alias("rank"), "p.gx", "p.gy", (-F.col("p.h")).alias("v"))
