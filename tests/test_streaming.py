"""Streams give what batches give."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliate.operators.classify import classify
from foliate.plans.lifts import pages
from foliate.streaming.events import heartbeats, latest_state, sessions, windowed_counts
from foliate.streaming.heartbeat import live_progress
from foliate.streaming.pages import classify_arrivals


def events(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, 7, at, "created"), (2, 7, at + timedelta(seconds=95), "progress"), (3, 7, at + timedelta(seconds=100), "completed"), (4, 7, at + timedelta(hours=3), "cancelled"), (5, 8, at, "progress")]
    return spark.createDataFrame(rows, "event_id long, task_id long, ts timestamp, kind string")


def test_batch_semantics(spark):
    rows = events(spark)
    assert {(r.task_id, r.status) for r in latest_state(rows).collect()} == {(7, "completed"), (8, "processing")}
    assert {r.event_id: r.heartbeats for r in heartbeats(rows).collect()} == {1: 0, 2: 3, 3: 0, 5: 0}
    assert sessions(rows).filter("task_id = 7").count() == 2
    assert windowed_counts(rows, "1 hour", "30 minutes").agg(F.sum("events")).first()[0] == 10


def test_arriving_pages_are_classified_once(spark, tmp_path):
    source, out, checkpoints = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = pages(spark, "/root/testdata/sf0.001").withColumns({"width": F.lit(600.0), "height": F.lit(1000.0)})
    rows.repartition(5).write.parquet(source)
    seen = []
    for _ in range(2):
        classify_arrivals(spark, source, out, checkpoints, then=lambda batch, n: seen.append(n)).awaitTermination()
    made = spark.read.parquet(out)
    assert len(seen) == len(set(seen)) >= 2
    expected = classify(rows).select("doc_id", "page_type").exceptAll(made.select("doc_id", "page_type"))
    assert made.count() == rows.count() and expected.count() == 0


def test_live_progress_ends_with_the_task(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).select("event_id", "task_id", "ts", "kind").coalesce(1).sortWithinPartitions("event_id").write.parquet(source)
    stream = spark.readStream.schema("event_id long, task_id long, ts timestamp, kind string").parquet(source)
    query = live_progress(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    rows = lambda: [r.kind for r in spark.sql("select * from live where task_id = 7 order by n").collect()]
    for _ in range(60):
        if len(rows()) >= 3:
            break
        time.sleep(0.5)
    query.stop()
    assert rows() == ["created", "progress", "completed"]


def test_windows_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark).write.parquet(source)
    stream = spark.readStream.schema("event_id long, task_id long, ts timestamp, kind string").parquet(source)
    query = windowed_counts(stream, "1 hour", late="10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {(r.start, r.kind, r.events) for r in windowed_counts(events(spark)).collect()}
    assert {(r.start, r.kind, r.events) for r in spark.sql("select * from counted").collect()} == batch
