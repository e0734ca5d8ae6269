"""Running sums over a whole ordered table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize


def prefix_sums(df: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """df in order with _start (sizes before the row), _rank (rows before it) and _total (of all sizes).

    Range partitions are written once, with their number, so what follows sees the same
    rows however often tasks run. Each partition's total gives its base, a running sum
    inside it the rest; the bases (one row a partition of the shuffle) are broadcast.
    """
    order = [*order, F.col("_nth")]  # rows that are equal in order, however many, may lie in several partitions
    numbered = df.withColumn("_nth", F.monotonically_increasing_id())
    parts = materialize(numbered.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = parts.groupBy("_part").agg(F.sum(size).alias("_sum"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"), F.sum("_sum").over(whole).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(F.broadcast(bases), "_part")
        .withColumn("_start", F.col("_base") + F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        .withColumn("_rank", F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_part", "_base", "_first", "_nth")
    )
