"""Ranks and running sums over whole tables: by range partitions and their totals, never by a window over all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kept(rows: DataFrame) -> DataFrame:
    """rows, written once to the checkpoint folder that driver and executors share (``spark.checkpoint.dir``)."""
    context = SparkSession.active().sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()


def settled(rows: DataFrame) -> DataFrame:
    """kept(), for rounds: without the sizes that the plan estimated, which a checkpoint inherits and each round's joins would multiply."""
    held, spark = kept(rows), SparkSession.active()
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.toJavaRDD(), held._jdf.schema()), spark)


#: Partitions that rows are dealt into at least, whatever the tasks that read them.
DEALT = 120


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by hash of their keys in many partitions of a fixed number: a small file is read by one task, and adaptive execution would join partitions until each core has one."""
    least = int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, DEALT), *keys)


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with, for each name in ``sums``, the sum of its expression over all rows before them in ``order`` (0 for the first).

    The range partitions are written once, so that their numbers hold whatever is computed again;
    rows equal in order may lie in several of them. What is broadcast is a row a partition.
    """
    order = [*order, F.col("_nth")]
    size = {name: f"_size_{name}" for name in sums}
    sized = rows.withColumns({size[n]: e for n, e in sums.items()} | {"_nth": F.monotonically_increasing_id()})
    placed = kept(sized.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(c) for c in size.values()))
    bases = totals.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_base{c}") for c in size.values()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(bases), "_part")
    found = joined.withColumns({n: F.col(f"_base{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in size.items()})
    return found.select(*rows.columns, *sums)


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in ``order``, from 1."""
    return running(rows, order, **{name: F.lit(1)}).withColumn(name, F.col(name) + 1)
