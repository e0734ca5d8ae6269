"""Clusters, maps and author tables over vectors and papers."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import kept, running
from folioscope.operators.search import cosine, norm, vector_search


def layout(chunks: DataFrame, k: int = 2) -> DataFrame:
    """chunks with pos (array of k): principal components, in place of a neighbour embedding, scaled to 0..1 by axis."""
    rows = chunks.withColumn("_v", array_to_vector("embedding"))
    placed = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("pos", vector_to_array("_p")).drop("_v", "_p")
    ends = placed.agg(*[f(F.col("pos")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [(F.col("pos")[i] - F.col(f"lo{i}")) / F.greatest(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(1e-12)) for i in range(k)]
    return placed.crossJoin(F.broadcast(ends)).withColumn("pos", F.array(*scaled)).select(*chunks.columns, "pos")


def clusters(chunks: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """chunks with cluster, by k-means, in place of density clustering: no noise to reassign."""
    rows = chunks.withColumn("_v", array_to_vector("embedding"))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def modal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value: each group's most frequent value that is not -1, the least of equals."""
    counts = rows.filter(F.col(value).cast("string") != "-1").groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).filter("_r = 1").select(group, value, "n")


def cluster_terms(texts: DataFrame, top: int = 15, min_df: int = 2) -> DataFrame:
    """cluster, rank, term, weight: words and pairs of words by class-based tf-idf (texts: cluster, content), each cluster's weights of length one."""
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    own = texts.select("cluster", words.alias("w"))
    after = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), after), F.slice("w", F.lit(2), after), lambda x, y: F.concat(x, F.lit(" "), y))
    each = own.select("cluster", F.explode(F.concat("w", pairs)).alias("term"))
    tf = each.groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    known = tf.withColumn("df", F.count("*").over(Window.partitionBy("term"))).filter(F.col("df") >= min_df)
    n = texts.agg(F.countDistinct("cluster").alias("n"))
    weighted = kept(known).crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    lengths = F.broadcast(weighted.groupBy("cluster").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length")).withColumnRenamed("cluster", "_own"))  # a row a cluster
    ranked = weighted.join(lengths, F.col("cluster").eqNullSafe(F.col("_own"))).withColumn("weight", F.col("x") / F.col("length")).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("weight", 9)), "term")))
    return ranked.filter(F.col("rank") <= top).select("cluster", "rank", "term", "weight")


def cells(points: DataFrame, x: str, y: str, side: int) -> DataFrame:
    """points with gx, gy: their cell of a grid over the unit square."""
    cell = lambda c: F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor(F.col(c) * side))).cast("int")
    return points.withColumn("gx", cell(x)).withColumn("gy", cell(y))


def heightmap(points: DataFrame, x: str, y: str, side: int, radius: int = 1) -> DataFrame:
    """gx, gy, v: log1p of the counts blurred by a separable binomial kernel; only cells near a point have a row."""
    counts = cells(points, x, y, side).groupBy("gx", "gy").agg(F.count("*").cast("double").alias("v"))
    weights = [1.0]
    for _ in range(2 * radius):
        weights = [a + b for a, b in zip([0.0, *weights], [*weights, 0.0], strict=True)]
    kernel = F.array(*[F.struct(F.lit(i - radius).alias("d"), F.lit(w / sum(weights)).alias("w")) for i, w in enumerate(weights)])
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        spread = counts.select(axis, other, "v", F.explode(kernel).alias("k")).select((F.col(axis) + F.col("k.d")).alias(axis), other, (F.col("v") * F.col("k.w")).alias("v"))
        counts = spread.filter(F.col(axis).between(0, side - 1)).groupBy(axis, other).agg(F.sum("v").alias("v"))
    return counts.select("gx", "gy", F.log1p("v").alias("v"))


def splat(points: DataFrame, x: str, y: str, side: int) -> DataFrame:
    """gx, gy, v: each point's unit weight shared by the four cell centres around it."""
    fx, fy = F.col(x) * side - 0.5, F.col(y) * side - 0.5
    corner = [F.struct((F.floor(fx) + i).cast("int").alias("gx"), (F.floor(fy) + j).cast("int").alias("gy"), ((fx - F.floor(fx) if i else 1 - (fx - F.floor(fx))) * (fy - F.floor(fy) if j else 1 - (fy - F.floor(fy)))).alias("w")) for i in (0, 1) for j in (0, 1)]
    each = points.select(F.explode(F.array(*corner)).alias("c")).select("c.*")
    inside = each.filter(F.col("gx").between(0, side - 1) & F.col("gy").between(0, side - 1))
    return inside.groupBy("gx", "gy").agg(F.sum("w").alias("v"))


def frontier(papers: DataFrame, side: int = 28, span: int = 8, least: int = 6, z_least: float = 2.5, top: int = 14) -> DataFrame:
    """Cells with more recent papers than the map's rate explains: gx, gy, n, recent_n, z. papers: px, py, year."""
    dated = cells(papers.filter("year is not null"), "px", "py", side)
    last = dated.agg(F.max("year").alias("hi"), F.count("*").alias("all_n"))
    marked = dated.crossJoin(F.broadcast(last)).withColumn("new", (F.col("year") > F.col("hi") - span).cast("long"))
    rate = F.broadcast(marked.agg((F.sum("new") / F.count("*")).alias("rate")))
    by = marked.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.sum("new").alias("recent_n")).filter(F.col("n") >= least).crossJoin(rate)
    expected = F.col("n") * F.col("rate")
    scored = by.withColumn("z", (F.col("recent_n") - expected) / F.sqrt(expected)).filter(F.col("z") >= z_least)
    return scored.orderBy(F.desc("z"), "gx", "gy").limit(top).select("gx", "gy", "n", "recent_n", F.round("z", 6).alias("z"))


def author_key(family: Column, given: Column) -> Column:
    """Letters of the family name, a slash, and the first initial."""
    return F.concat(F.regexp_replace(F.lower(family), r"[^\p{L}]", ""), F.lit("/"), F.lower(F.substring(F.regexp_replace(given, r"[^\p{L}]", ""), 1, 1)))


def authors(papers: DataFrame) -> DataFrame:
    """key, family, given (the longest seen), n_papers, first_year, last_year of each author of papers (family, given, filename, year)."""
    keyed = papers.withColumn("key", author_key(F.col("family"), F.col("given"))).withColumn("y", F.expr("try_cast(year as int)"))
    longest = F.max_by("given", F.struct(F.length("given"), "given"))
    return keyed.groupBy("key").agg(F.min("family").alias("family"), longest.alias("given"), F.countDistinct("filename").alias("n_papers"), F.coalesce(F.min("y"), F.lit(0)).alias("first_year"), F.coalesce(F.max("y"), F.lit(0)).alias("last_year"))


def crosstab(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


def slerp(a: Column, b: Column, t: Column | float) -> Column:
    """Between two unit vectors on their great circle; equal ones stay."""
    dot = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b)))
    w = F.acos(dot)
    t = t if isinstance(t, Column) else F.lit(t)
    p, q = F.sin((1 - t) * w) / F.sin(w), F.sin(t * w) / F.sin(w)
    return F.when(w < 1e-5, a).otherwise(F.zip_with(a, b, lambda x, y: p * x + q * y))


def arithmetic(chunks: DataFrame, plus: list[int], minus: list[int], k: int = 8, pool: int = 32) -> DataFrame:
    """Papers near the sum of some chunks' vectors less others': file_path, score; the inputs' own files are left out."""
    signed = chunks.filter(F.col("chunk_id").isin(plus + minus)).withColumn("s", F.when(F.col("chunk_id").isin(minus), -1.0).otherwise(1.0))
    summed = signed.select("s", F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.sum(F.col("s") * F.col("x")).alias("x"))
    query = summed.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.col("v.x").alias("q"))
    rest = chunks.join(signed.select("file_path").distinct(), "file_path", "left_anti")
    hits = vector_search(rest, query.select((F.transform("q", lambda x: x / (norm("q") + 1e-9))).alias("q")), pool)
    best = hits.groupBy("file_path").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "file_path").limit(k)


def date_ramp(rows: DataFrame, date: str, split: float = 1990, band: float = 0.1) -> DataFrame:
    """rows with ramp: the share of earlier dates, those before ``split`` within the first ``band``."""
    old = F.col(date) < split
    before = running(rows.filter(F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("_c")), [F.col(date)], _before=F.col("_c"))
    n = F.broadcast(before.agg(*(F.coalesce(F.sum(F.when(c, F.col("_c"))), F.lit(0)).alias(name) for name, c in (("_old", old), ("_new", ~old)))))  # one row
    early, late = F.col("_before") / F.nullif("_old", F.lit(0)), (F.col("_before") - F.col("_old")) / F.nullif("_new", F.lit(0))
    ramps = before.crossJoin(n).select(date, F.when(old, band * early).otherwise(band + (1 - band) * late).alias("ramp"))
    return rows.join(ramps, date, "left")


def knots(rows: DataFrame, value: str, n: int = 14) -> DataFrame:
    """i, knot: n values at even ranks, from the least to the greatest."""
    before = running(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")), [F.col(value)], _before=F.col("_c"))
    places = before.agg(F.sum("_c").alias("_n")).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1)))).alias("i", "_at"))
    met = before.join(F.broadcast(places), F.col("_at").between(F.col("_before"), F.col("_before") + F.col("_c") - 1))  # ``n`` rows
    return met.select("i", F.col(value).alias("knot"))
