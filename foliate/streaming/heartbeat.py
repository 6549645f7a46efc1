"""Heartbeats of silent tasks on a live stream: a processing-time timer for each task that has not ended."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliate.streaming.events import TERMINAL

OUTPUT = "task_id long, kind string, n long"


def live_progress(events: DataFrame, seconds: int = 30) -> DataFrame:
    """events (task_id, kind) of a stream as they come, and a heartbeat for each `seconds` of silence; a terminal event
    ends a task, and what comes after it is dropped. State is a count for each running task."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, ended = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            state.update((sent + 1, False))
            state.setTimeoutDuration(seconds * 1000)
            yield pd.DataFrame({"task_id": [key[0]], "kind": ["heartbeat"], "n": [sent + 1]})
            return
        kinds = [k for frame in frames for k in frame["kind"]] if not ended else []
        stop = next((k + 1 for k, kind in enumerate(kinds) if kind in TERMINAL), None)
        kinds = kinds[:stop]
        state.update((sent + len(kinds), ended or stop is not None))
        state.setTimeoutDuration(seconds * 1000)
        if kinds:
            yield pd.DataFrame({"task_id": key[0], "kind": kinds, "n": range(sent + 1, sent + len(kinds) + 1)})

    return events.groupBy("task_id").applyInPandasWithState(run, OUTPUT, "n long, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
