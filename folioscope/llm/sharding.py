"""Operator 8: contiguous shards of near equal bytes from global prefix sums.

Rows are range-partitioned by key; each partition's total gives its base by a
prefix sum over the totals (one row a partition), the running sum inside a
partition does the rest, and the line of bytes is cut at equal targets. A row
goes to the shard in which its middle byte lies, so no shard misses the target
by more than the largest row at either end.

Null keys come first. Rows of equal key are ordered by ``ties``; rows equal in
these too are interchangeable. Null sizes count as zero. A table of no bytes
goes to shard 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.prefix import prefix_sums


def assign_shards(df: DataFrame, n_shards: int = 40, key: str = "doc_id", size: str = "size", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with shard (int), slot (long, gapless in the shard), start (bytes before the row).

    Select only what must travel with the rows: every column of df is moved once
    by the range partitioning and once by the running sums.
    """
    stay = [c for c in df.columns if c not in ("shard", "slot", "start")]
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate((key, *ties))]
    sized = df.select(F.struct(*(F.col(f"`{c}`") for c in stay)).alias("_row"), *keys, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    order = [F.col(f"_key{i}").asc_nulls_first() for i in range(len(keys))] + [F.col("_size")]
    middle = F.expr(f"least({n_shards - 1}, (2 * _start + _size) * {n_shards} div (2 * _total))")
    placed = prefix_sums(sized, order, "_size", "shard-parts").withColumn("_shard", F.when(F.col("_total") > 0, middle).otherwise(F.lit(0)).cast("int"))
    firsts = placed.groupBy("_shard").agg(F.min("_rank").alias("_shard_first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "_shard").select(*(F.col("_row")[c].alias(c) for c in stay), F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_shard_first")).alias("slot"), F.col("_start").alias("start"))
