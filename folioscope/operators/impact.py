"""Citation impact, authors' profiles and guesses by rank (A18, A20, A23-A25, W10, DB18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import running


def first_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def top_by_decade(works: DataFrame, year: str, cited: str, key: str, k: int = 5, least: int = 8) -> DataFrame:
    """decade, rank, key, cited: each decade's most cited works, where it has ``least`` works or more."""
    dated = works.filter(F.col(year).isNotNull()).withColumn("decade", (F.floor(F.col(year) / 10) * 10).cast("int"))
    full = dated.groupBy("decade").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("decade")
    return first_k(dated.join(F.broadcast(full), "decade", "left_semi"), ["decade"], [F.desc(cited), key], k).select("decade", "rank", key, cited)


def topic_impact(works: DataFrame, terms: str, percentile: str, cited: str, least: int = 8, k: int = 40) -> DataFrame:
    """term, n, mean_percentile, median_cited (the upper of two middles) of terms with ``least`` works or more."""
    each = works.select(F.explode(F.array_distinct(terms)).alias("term"), F.col(percentile).alias("p"), F.col(cited).alias("c"))
    ordered = each.withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy("c"))).withColumn("n", F.count("*").over(Window.partitionBy("term")))
    middle = F.max(F.when(F.col("i") == F.expr("n div 2 + 1"), F.col("c")))
    by = ordered.groupBy("term").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_percentile"), middle.alias("median_cited")).filter(F.col("n") >= least)
    return by.orderBy(F.desc("mean_percentile"), F.desc("n"), "term").limit(k)


def arrivals(by_year: DataFrame) -> DataFrame:
    """year, n: citations that came in each year, over all works (year, n)."""
    return by_year.groupBy("year").agg(F.sum("n").alias("n"))


def profile(papers: DataFrame, family: str, k: int = 14) -> DataFrame:
    """What an author's papers hold most: dimension, rank, value, n over keywords, journals and subjects."""
    mine = papers.filter(F.lower("family") == family.strip().lower())
    listed = lambda c: F.transform(c, lambda x: F.struct(F.lit(c).alias("dimension"), x.alias("value")))
    each = mine.select(F.explode(F.concat(listed("keywords"), listed("subjects"), F.array(F.struct(F.lit("journals").alias("dimension"), F.col("container_title").alias("value"))))).alias("x")).select("x.*")
    counts = each.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return first_k(counts, ["dimension"], [F.desc("n"), "value"], k)


def temperature(guesses: DataFrame, target: str, sim: str) -> DataFrame:
    """guesses with temperature: how near each is among all of its target's, 0 to 99, by rank of similarity."""
    counts = guesses.groupBy(target, sim).agg(F.count("*").alias("_c"))
    before = running(counts, [F.col(target), F.desc(sim)], _before=F.col("_c"))
    own = F.broadcast(before.groupBy(target).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_n")))  # a row a target
    above = (F.col("_before") - F.col("_first")) / F.col("_n")
    warm = before.join(own, target).select(target, sim, (F.round(F.pow(1 - above, F.lit(2.2)) * 990) / 10).alias("temperature"))
    return guesses.join(warm, [target, sim])
