"""Structured Streaming counterparts of ingest and presence (ST1, ST5, ST6), and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def content_keyed(docs: DataFrame) -> DataFrame:
    """Documents with their content id; repeats within the stream are dropped by it."""
    return docs.withColumn("content_id", F.concat(F.lit("doc-"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).dropDuplicates(["content_id"])


def append_new(known: Callable[[], DataFrame | None], path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose key the store lacks; data is written before any status."""

    def write(batch: DataFrame, number: int) -> None:
        store = known()
        fresh = batch if store is None else batch.join(store.select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def presence(heartbeats: DataFrame, ttl: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """user_id, window, last_seen: who was present in each ttl."""
    return heartbeats.withWatermark("ts", late).groupBy(F.window("ts", ttl), "user_id").agg(F.max("ts").alias("last_seen"))


def tumbling(events: DataFrame, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; on a stream, late rows beyond the watermark are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
