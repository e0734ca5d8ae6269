"""Titles that agree by their sets of words (J20) and close matches of a rejected value."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import kept


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, free = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        met = free & places.get(c, 0)
        free = ((free + met) | (free - met)) & full
    return len(a) - free.bit_count()


def set_ratio(a: str, b: str) -> float:
    """0 to 100: how well two texts agree by their sets of words; 100 if one set holds the other.

    The words that both have are compared with either whole set, and what each has alone with the other's, by the share of
    characters that deletions and insertions leave; the best counts.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    gap = 1 if both else 0
    one, two = len(both) + gap + len(left), len(both) + gap + len(right)
    apart = len(left) + len(right) - 2 * common_subsequence(left, right)
    ratios = [100 - 100 * apart / (one + two)]
    if both:
        ratios += [100 - 100 * (gap + len(rest)) / (len(both) + whole) for rest, whole in ((left, one), (right, two))]
    return max(ratios)


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def _grams(words: str) -> Column:
    """Runs of three characters of each word between spaces."""
    own = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, own)))


def _rarest(rows: DataFrame, counts: DataFrame, items: str, size: Column) -> DataFrame:
    """(key, k): of each row's items, rarest first, those before which less than ``size`` characters, or items, lie."""
    each = rows.select("key", size.alias("_most"), F.explode(items).alias("k")).join(counts, "k")
    weight = F.length("k") + 1 if items == "words" else F.lit(1)
    before = F.coalesce(F.sum(weight).over(Window.partitionBy("key").orderBy("n", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("_before", before).filter(F.col("_before") <= F.col("_most")).select("key", "k")


def title_set_matches(left: DataFrame, right: DataFrame, key_l: str, key_r: str, least: float = 90.0, top: int = 3) -> DataFrame:
    """left and right (key, title): key_l, key_r, ratio of titles that agree by ``set_ratio``, the ``top`` of each left row, first by ratio, then key.

    No pair that reaches ``least`` is lost. Let s = 1 - least / 100. If what one title has alone is at most s of it and
    the shared words, its rarest words that exceed 2 s of its characters hold a shared one: they meet all words of the
    other side (titles with and without subtitle). Otherwise what both have alone differs by few characters; each changes
    three runs of three characters at most, so some of a title's rarest runs, as many as may have changed and one more,
    are in the other: they meet all runs. Candidates are then verified.
    """
    s = 1 - least / 100
    sides = [d.select(F.col(k).alias("key"), _words(F.col("title")).alias("words")).withColumn("runs", _grams("words")).filter(F.size("words") > 0) for d, k in ((left, key_l), (right, key_r))]
    l, r = (kept(d) for d in sides)
    chars = F.aggregate("words", F.lit(-1), lambda n, w: n + F.length(w) + 1)
    pairs = None
    for items, size in (("words", 2 * s * chars + 1), ("runs", 3 * s * (chars + chars * (1 + s) / (1 - s)))):
        counts = kept(l.select(F.explode(items).alias("k")).unionByName(r.select(F.explode(items).alias("k"))).groupBy("k").agg(F.count("*").alias("n")))
        every = [d.select("key", F.explode(items).alias("k")) for d in (l, r)]
        met = [_rarest(l, counts, items, size).withColumnRenamed("key", "l").join(every[1].withColumnRenamed("key", "r"), "k").select("l", "r")]
        if items == "words":  # either side may be the one that the other holds
            met.append(_rarest(r, counts, items, size).withColumnRenamed("key", "r").join(every[0].withColumnRenamed("key", "l"), "k").select("l", "r"))
        for m in met:
            pairs = m if pairs is None else pairs.unionByName(m)
    text = lambda d, k: d.select(F.col("key").alias(k), F.array_join("words", " ").alias(f"t{k}"))
    both = pairs.distinct().join(text(l, "l"), "l").join(text(r, "r"), "r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["l", "r"]].assign(ratio=[set_ratio(x, y) for x, y in zip(b["tl"], b["tr"], strict=True)])

    kinds = [d.schema[k].dataType.simpleString() for d, k in ((left, key_l), (right, key_r))]
    scored = both.mapInPandas(run, f"l {kinds[0]}, r {kinds[1]}, ratio double").filter(F.col("ratio") >= least)
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("ratio"), "r"))).filter(F.col("_r") <= top)
    return best.select(F.col("l").alias(key_l), F.col("r").alias(key_r), "ratio")


def close_matches(asked: DataFrame, pool: DataFrame, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """value, rank, match: of pool (match), the n likest each asked value by Ratcliff and Obershelp's ratio of ``cutoff`` or more, the greater of equals first.

    An asked value that nothing is like gets the first n values that hold it, whatever the letter case. asked holds what
    users typed, pool a facet's distinct values; each block of one meets each block of the other. Pairs whose lengths or
    counts of characters cannot reach the cutoff are not compared.
    """
    block = 2048
    cell = lambda d, c: (-(-max(1, d.count()) // block), c)
    asked, pool = kept(asked.select("value").filter("value is not null").distinct()), kept(pool.select("match").filter("match is not null").distinct())
    (na, _), (np_, _) = cell(asked, "value"), cell(pool, "match")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = asked.withColumn("p", F.pmod(F.xxhash64("value"), F.lit(na)).cast("int")).withColumn("q", every(np_))
    b = pool.withColumn("q", F.pmod(F.xxhash64("match"), F.lit(np_)).cast("int")).withColumn("p", every(na))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        m = SequenceMatcher()
        for value in x["value"]:
            m.set_seq2(value)  # the side whose characters are kept by place
            for match in y["match"]:
                m.set_seq1(match)
                if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and (ratio := m.ratio()) >= cutoff:
                    out.append((value, match, ratio))
                elif value.lower() in match.lower():
                    out.append((value, match, -1.0))
        return pd.DataFrame(out, columns=["value", "match", "ratio"]).astype({"ratio": "float64"})

    met = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(meet, "value string, match string, ratio double")
    best = F.max("ratio").over(Window.partitionBy("value"))
    fit = met.withColumn("_best", best).filter((F.col("ratio") >= 0) | (F.col("_best") < 0))
    order = Window.partitionBy("value").orderBy(F.desc("ratio"), F.when(F.col("ratio") >= 0, F.col("match")).desc_nulls_last(), "match")
    return fit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("value", "rank", "match", F.greatest("ratio", F.lit(0.0)).alias("ratio"))
