"""Connected components of a table of links, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b: long) to (node, component): the least node reachable, for every node in a link.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): in each, every
    node hands its neighbours to the least of them. Each round writes its links to the
    shared folder, so lost executors cost one round. A node that links with a third of
    all others costs rows in proportion to its links, grouped by partial minima.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    for _ in range(rounds):
        both = _both_ways(now)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: a's neighbours are all smaller now; each of them and a itself go to the least
        large = materialize(large, "large-star")
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smaller, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").filter("a != b").distinct()
        after = materialize(small, "small-star")
        # stars: every node has one neighbour, which has none of its own
        loose = after.groupBy("a").count().filter("count > 1").limit(1).count() or after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        now = after
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
