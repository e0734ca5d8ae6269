"""Words on pages by their boxes: lines, the gutter between two columns, columns of line numbers.

words: page, x0, y0, x1, y1, word, block, line. What is gathered into one row is a page's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where between the edges a gutter lies and how wide it is, as shares of the page's width.
BAND, LEAST_GUTTER = (0.42, 0.58), 0.035
#: Words of a page, and of each of two columns, at least; the share of words that may cross a gutter at most.
LEAST_WORDS, LEAST_SIDE, CROSSING = 40, 15, 0.03
#: Numbers that make a column, the share of the width that is margin, points between numbers of one column, the share that must not fall.
LEAST_NUMBERS, MARGIN, APART, RISING = 8, 0.15, 20, 0.7


def _share(part: float, width: float) -> float:
    """A share of the width in decimals, as the SQL has it: 0.035 of 600 is 21, where binary fractions give a little more."""
    return round(part * width, 9)


def text_lines(words: DataFrame) -> DataFrame:
    """page, line (from 1, downwards), text: words whose tops lie within 0.6 of the middle height (3 at least) of a line's first word are one line."""
    facts = words.groupBy("page").agg(F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"), F.array_sort(F.collect_set("y0")).alias("tops"))
    middle = F.col("h")[F.floor(F.size("h") / 2).cast("int")]
    facts = facts.withColumn("tol", F.greatest(0.6 * F.when(middle != 0, middle).otherwise(8.0), F.lit(3.0)))
    starts = F.aggregate("tops", F.array().cast("array<double>"), lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > F.col("tol")), F.concat(acc, F.array(y))).otherwise(acc))
    rows = words.join(facts.select("page", starts.alias("starts")), "page")
    rows = rows.withColumn("n", F.size(F.filter("starts", lambda y: y <= F.col("y0"))))
    listed = F.sort_array(F.collect_list(F.struct("x0", "y0", "word")))
    return rows.groupBy("page", F.col("n").alias("line")).agg(F.array_join(F.transform(listed, lambda w: w["word"]), " ").alias("text"))


def gutters(words: DataFrame, width: float) -> DataFrame:
    """page, gutter, gap: the middle of the widest gap between words' centres in the band about the page's middle, the leftmost of equals; narrower ones are none."""
    centre = (F.col("x0") + F.col("x1")) / 2
    pairs = words.select("page", centre.alias("b")).withColumn("a", F.lag("b").over(Window.partitionBy("page").orderBy("b")))
    inside = pairs.filter((F.col("a") >= _share(BAND[0], width)) & (F.col("b") <= _share(BAND[1], width)))
    best = inside.groupBy("page").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("p"))
    found = best.select("page", ((F.col("p.a") + F.col("p.b")) / 2).alias("gutter"), (F.col("p.b") - F.col("p.a")).alias("gap"))
    return found.filter((F.col("gap") > 0) & (F.col("gap") >= _share(LEAST_GUTTER, width)))


def without_line_numbers(words: DataFrame, width: float) -> DataFrame:
    """words without columns of line numbers: numbers alone on their lines, one below the other at a margin, that mostly do not fall.

    Columns are islands along the page's width; a number within a line of words is never one of them.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    alone = F.count("*").over(Window.partitionBy("page", "block", "line")) == 1
    marked = words.withColumn("_alone", alone & F.col("word").rlike("^[0-9]+$")).withColumn("_c", centre)
    across = Window.partitionBy("page", "_alone").orderBy("_c", "y0")
    far = F.coalesce(F.col("_c") - F.lag("_c").over(across) > APART, F.lit(True))
    island = marked.withColumn("_far", far.cast("int")).withColumn("_island", F.sum("_far").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy("page", "_alone", "_island").orderBy("y0", "_c")
    number = F.col("word").try_cast("decimal(38,0)")
    steps = island.withColumn("_rises", F.when(F.col("_alone"), (number >= F.lag(number).over(down)).cast("int")))
    whole = Window.partitionBy("page", "_alone", "_island")
    n, mean = F.count("*").over(whole), F.avg("_c").over(whole)
    column = F.col("_alone") & (n >= LEAST_NUMBERS) & ((mean < _share(MARGIN, width)) | (mean > _share(1 - MARGIN, width))) & (F.sum("_rises").over(whole) >= RISING * (n - 1))
    return steps.withColumn("_column", column).filter(~F.col("_column")).select(words.columns)


def in_columns(words: DataFrame, width: float) -> DataFrame:
    """words with part: 1 and 2 for the columns of pages that have two, else 0.

    A page of two columns has a gutter that few words cross and enough words, and enough on either side of it.
    """
    met = words.join(gutters(words, width).select("page", "gutter"), "page", "left")
    page, left = Window.partitionBy("page"), (F.col("x0") + F.col("x1")) / 2 < F.col("gutter")
    n, on_left = F.count("*").over(page), F.sum(left.cast("int")).over(page)
    crossing = F.sum(((F.col("x0") < F.col("gutter")) & (F.col("gutter") < F.col("x1"))).cast("int")).over(page)
    two = F.col("gutter").isNotNull() & (n >= LEAST_WORDS) & (crossing <= CROSSING * n) & (on_left >= LEAST_SIDE) & (n - on_left >= LEAST_SIDE)
    return met.withColumn("part", F.when(two, F.when(left, 1).otherwise(2)).otherwise(0)).select(*words.columns, "part")


def reading_order(words: DataFrame, width: float) -> DataFrame:
    """page, part, line, text: pages without line numbers, the left column's lines before the right one's."""
    placed = in_columns(without_line_numbers(words, width), width).withColumn("page", F.struct("page", "part"))
    return text_lines(placed).select("page.page", "page.part", "line", "text")
