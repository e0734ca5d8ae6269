"""Streams with state: stopped and started again from their checkpoint they give what one batch gives."""

import pytest

from folioscope.streaming import state


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


EVENTS = "content_id string, run long, seq long, event string"
RUNS = [
    [("a", 1, 1, "seen"), ("b", 1, 2, "seen"), ("a", 1, 3, "processing"), ("a", 1, 4, "processed"), ("b", 1, 5, "parsing"), ("c", 1, 6, "seen"), ("c", 1, 7, "failed")],
    [("a", 2, 1, "seen"), ("b", 2, 2, "seen"), ("c", 2, 3, "seen"), ("d", 2, 4, "seen"), ("b", 2, 5, "processing"), ("b", 2, 6, "processed"), ("d", 2, 7, "analyzing")],
    [("d", 3, 1, "seen"), ("a", 3, 2, "seen")],
]
WANT = {
    ("a", 1, "pending", "new"), ("b", 1, "pending", "new"), ("a", 1, "processing", "reported"), ("a", 1, "processed", "reported"), ("b", 1, "parsing", "reported"), ("c", 1, "pending", "new"), ("c", 1, "failed", "reported"),
    ("b", 2, "pending", "stranded"), ("d", 2, "pending", "new"), ("b", 2, "processing", "reported"), ("b", 2, "processed", "reported"), ("d", 2, "analyzing", "reported"), ("d", 3, "pending", "stranded"),
}


def run_to_end(query):
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_statuses_survive_restarts(spark, tmp_path):
    every = [e for r in RUNS for e in r]
    batch = state.statuses(spark.createDataFrame(every, EVENTS)).collect()
    assert {tuple(r) for r in batch} == WANT and len(batch) == len(WANT)
    for rows in RUNS:  # each run is a stream of its own over the same checkpoint
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.statuses(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
        run_to_end(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start())
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {tuple(r) for r in got} == WANT and len(got) == len(WANT)


def test_presence_ages_out_over_a_restart(spark, tmp_path):
    beats = "chat_id string, user_id string, ts timestamp, typing boolean"
    at = lambda s: f"2024-01-01 00:00:{s:02d}" if s < 60 else f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    parts = [
        [("x", "ann", at(0), True), ("x", "ann", at(5), True), ("x", "bob", at(3), True), ("x", "bob", at(4), False), ("y", "ann", at(6), True)],
        [("x", "ann", at(30), True), ("z", "eve", at(40), True)],
        [("z", "zoe", at(300), True)],
        [("z", "zoe", at(600), True)],
    ]
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "chat_id string, user_id string, ts string, typing boolean").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.presence_changes(spark.readStream.schema(beats).parquet(str(tmp_path / "in")), late="1 second")
        run_to_end(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start())
    base = 1704067200000
    got = {(r.chat_id, r.user_id, (r.at_ms - base) / 1000, r.present) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {("x", "ann", 0, True), ("x", "ann", 13, False), ("x", "bob", 3, True), ("x", "bob", 4, False), ("y", "ann", 6, True), ("y", "ann", 14, False), ("x", "ann", 30, True), ("x", "ann", 38, False), ("z", "eve", 40, True), ("z", "eve", 48, False), ("z", "zoe", 300, True), ("z", "zoe", 308, False), ("z", "zoe", 600, True)}
    assert got - {("z", "zoe", 608, False)} == want
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert {r.user_id for r in state.present_at(changes, base + 3500, "x", "ann").collect()} == {"bob"}
    assert {r.user_id for r in state.present_at(changes, base + 4000, "x", "").collect()} == {"ann"}
    assert state.present_at(changes, base + 20_000, "x", "").collect() == []
