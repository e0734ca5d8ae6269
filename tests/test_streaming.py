"""The streaming path: bounded files through memory sinks."""

from pyspark.sql import functions as F

from folioscope.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), events.schema, 1)
    query = ingest.tumbling(stream, "1 day", "event_type", late="60 days").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    rows = lambda d: sorted((str(r.start), r.event_type, r.n) for r in d.collect())
    assert rows(spark.table("days")) == rows(ingest.tumbling(events, "1 day", "event_type"))


def test_ingest_drops_repeats_and_known(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    known = ingest.content_keyed(docs.filter("doc_id = 3"))
    stream = ingest.content_keyed(ingest.file_stream(spark, str(tmp_path / "in"), docs.schema))
    query = stream.writeStream.foreachBatch(ingest.append_new(lambda: known, store, "content_id")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert sorted(r.text or "" for r in spark.read.parquet(store).collect()) == ["", "a"]
