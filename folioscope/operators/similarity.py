"""Similarity of titles and reading orders: J20 as Jaccard of distinct words, J21, T24, T25, DB11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import running


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct words that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def title_matches(left: DataFrame, right: DataFrame, key_l: str, key_r: str, least: float = 0.9, top: int = 3) -> DataFrame:
    """left and right (key, title): key_l, key_r, overlap of titles whose distinct words agree (Jaccard), the ``top`` of each left row.

    Prefix filtering: of a title's n words in order of rarity, the first n - ceil(least * n) + 1 hold one word of any title
    that agrees with it, so only these words join; every true pair is met and verified.
    """
    l, r = left.select(F.col(key_l).alias("l"), title_tokens(F.col("title")).alias("a")), right.select(F.col(key_r).alias("r"), title_tokens(F.col("title")).alias("b"))
    rarity = l.select(F.explode("a").alias("w")).unionByName(r.select(F.explode("b").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def prefixes(d: DataFrame, k: str, v: str) -> DataFrame:
        ranked = d.select(k, F.size(v).alias("size"), F.explode(v).alias("w")).join(rarity, "w").withColumn("p", F.row_number().over(Window.partitionBy(k).orderBy("n", "w")))
        return ranked.filter(F.col("p") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select(k, "w")

    pairs = prefixes(l, "l", "a").join(prefixes(r, "r", "b"), "w").select("l", "r").distinct()
    both = pairs.join(l, "l").join(r, "r")
    scored = both.withColumn("overlap", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).filter(F.col("overlap") >= least)
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("overlap"), "r"))).filter(F.col("_r") <= top)
    return best.select(F.col("l").alias(key_l), F.col("r").alias(key_r), "overlap")


def reading_order(texts: DataFrame, key: str, a: str, b: str, k: int = 12, least: int = 30) -> DataFrame:
    """key, n, rho: Spearman's correlation of the places of k-word shingles found once in each of two texts; fewer than ``least``: null."""

    whole = texts.select(key, F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("_t")).repartition(key)  # texts are dealt by key once, their shingles stay where they are
    split = lambda c: F.filter(F.split(F.lower(F.col("_t")[c]), r"\s+"), lambda x: x != "")
    both = whole.select(key, F.explode(F.array(*(F.struct(F.lit(c == "a").alias("a"), split(c).alias("w")) for c in "ab"))).alias("_s")).select(key, "_s.a", "_s.w")
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))
    each = both.filter(F.size("w") >= k).select(key, "a", F.posexplode(shingles).alias("at", "h"))
    place, times = (lambda own: F.min(F.when(own, F.col("at")))), (lambda own: F.count_if(own))
    found = each.groupBy(key, "h").agg(place(F.col("a")).alias("p"), place(~F.col("a")).alias("q"), times(F.col("a")).alias("n"), times(~F.col("a")).alias("m"))
    met = found.filter("n = 1 and m = 1").drop("n", "m")
    ranked = met.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("p"))).withColumn("j", F.row_number().over(Window.partitionBy(key).orderBy("q")))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.corr(F.col("i").cast("double"), F.col("j").cast("double")).alias("rho")).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """The area under the curve of a score: one row, by rank sums over distinct scores, ties counting half."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    below = running(by, [F.col("s")], below=F.col("n") - F.col("p"))
    part = below.withColumn("wins", F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    return part.agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum(F.col("n") - F.col("p")), F.lit(0))).alias("auc"))


def best_candidates(candidates: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """Of each key's candidates (confidence, seq) the surest, the first of equals, if it is sure enough."""
    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "seq")))
    return ranked.filter((F.col("_r") == 1) & (F.col("confidence") >= least)).drop("_r")
