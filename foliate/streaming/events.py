"""Task events as streams: heartbeats, latest states, windows. The same functions run on batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def latest_state(events: DataFrame) -> DataFrame:
    """Each task's state: a terminal one if it ever had one, the first of those; else what came last."""
    at = F.struct("ts", "event_id")
    ended = F.min_by(F.when(F.col("kind").isin(*TERMINAL), F.col("kind")), F.when(F.col("kind").isin(*TERMINAL), at))
    made = events.groupBy("task_id").agg(F.max_by("kind", at).alias("last_kind"), ended.alias("ended"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    state = F.coalesce("ended", F.when(F.col("last_kind").isin("created", "progress"), "processing").otherwise(F.col("last_kind")))
    return made.select("task_id", state.alias("status"), "last_ts", "events")


def heartbeats(events: DataFrame, seconds: int = 30) -> DataFrame:
    """For each event of a task the heartbeats due in the silence before it: one for each full `seconds`.

    Events behind a task's first terminal one are not sent, and no heartbeat either.
    """
    order = Window.partitionBy("task_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    ended = F.coalesce(F.max(F.col("kind").isin(*TERMINAL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = events.withColumns({"gap_": gap, "ended_": ended}).filter("ended_ = 0")
    return made.withColumn("heartbeats", F.coalesce(F.floor(F.col("gap_") / (seconds * 1_000_000)), F.lit(0))).drop("gap_", "ended_")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and sums of `value` by tumbling or sliding window and kind; `late` is the watermark on streams."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Bursts of each task's events, apart by `gap` or more."""
    rows = events.withWatermark("ts", late) if late else events
    made = rows.groupBy(F.session_window("ts", gap).alias("w"), "task_id").agg(F.count("*").alias("events"))
    return made.select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def rejects_as_events(checked: DataFrame, ts: Column) -> DataFrame:
    """A created event for each accepted request; rejected ones never become tasks."""
    return checked.filter("status_code = 200").select(F.col("request_id").alias("task_id"), ts.alias("ts"), F.lit("created").alias("kind"))


def cancelled(events: DataFrame, tasks: DataFrame, ts: Column) -> DataFrame:
    """A cancel event at ts for each task (task_id) that is known and has not ended; others have nothing to cancel."""
    running = latest_state(events).filter(~F.col("status").isin(*TERMINAL)).select("task_id")
    return tasks.select("task_id").distinct().join(running, "task_id", "left_semi").select("task_id", ts.alias("ts"), F.lit("cancelled").alias("kind"))


def notify(states: DataFrame, make, **call) -> DataFrame:
    """task_id, delivered and error of ended tasks (task_id, status, callback_url): each state is posted to its address once.

    make gives a plug-in with post(url, payload); call: retries, wait and timeout of each post. Tasks without an address are
    left out. Materialise the result before using it twice.
    """
    import pandas as pd

    from foliate.operators.recognize import tried

    def run(frames):
        plug = make()
        for frame in frames:
            made = [tried(plug.post, url, {"task_id": int(task), "status": status}, **call) for task, status, url in zip(frame["task_id"], frame["status"], frame["callback_url"], strict=True)]
            yield pd.DataFrame({"task_id": frame["task_id"], "delivered": [m[1] is None for m in made], "error": [m[1] for m in made]})

    ended = states.filter(F.col("status").isin(*TERMINAL) & F.col("callback_url").isNotNull())
    return ended.select("task_id", "status", "callback_url").mapInPandas(run, "task_id long, delivered boolean, error string")
