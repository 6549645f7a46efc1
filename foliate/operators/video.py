"""Recordings by plug-ins: fetched, cut into frames and audio, understood by a model that sees several pictures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators.media import chunk_starts, frame_times
from foliate.operators.recognize import tried


class Fetcher(Protocol):
    """Stores what is behind an address: path, title, uploader and duration (seconds), each None if unknown."""

    def fetch(self, url: str) -> dict: ...


class Grabber(Protocol):
    def frame(self, path: str, second: int) -> bytes: ...

    def audio(self, path: str, start: int, seconds: int) -> bytes: ...


class Viewer(Protocol):
    def reply_to_many(self, prompt: str, images: list[bytes]) -> str: ...


#: What a model is asked about the frames of a recording.
UNDERSTAND = "These pictures are frames of one recording, in order, taken at {times} seconds. Describe what happens, topic by topic, as Markdown."


def fetch(urls: DataFrame, make: Callable[[], Fetcher], **call) -> DataFrame:
    """video_id, url, path, title, uploader, duration and error of urls (video_id, url); a failure stands in its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plug = make()
        for frame in frames:
            rows = []
            for video_id, url in zip(frame["video_id"], frame["url"], strict=True):
                found, error, _ = tried(plug.fetch, url, **call)
                found = found or {}
                rows.append([video_id, url, found.get("path"), found.get("title"), found.get("uploader"), found.get("duration"), error])
            yield pd.DataFrame(rows, columns=["video_id", "url", "path", "title", "uploader", "duration", "error"], dtype=object)

    return urls.select("video_id", "url").mapInPandas(run, "video_id long, url string, path string, title string, uploader string, duration double, error string")


def _cuts(rows: DataFrame, make: Callable[[], Grabber], column: str, grab: Callable, **call) -> DataFrame:
    """rows (video_id, path, second) with `column` and error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plug = make()
        for frame in frames:
            made = [tried(grab, plug, path, int(second), **call) for path, second in zip(frame["path"], frame["second"], strict=True)]
            yield frame.assign(**{column: [m[0] for m in made], "error": [m[1] for m in made]})

    return rows.mapInPandas(run, f"video_id long, path string, second int, {column} binary, error string")


def frames(recordings: DataFrame, make: Callable[[], Grabber], interval: int = 30, most: int = 20, **call) -> DataFrame:
    """video_id, path, second, image and error of the key frames of recordings (video_id, path, duration)."""
    rows = recordings.filter(F.col("path").isNotNull()).select("video_id", "path", F.explode(frame_times(F.col("duration"), interval, most).cast("array<int>")).alias("second"))
    return _cuts(rows, make, "image", lambda plug, path, second: plug.frame(path, second), **call)


def audio_chunks(recordings: DataFrame, make: Callable[[], Grabber], seconds: int = 600, **call) -> DataFrame:
    """video_id, index, start, audio and error of the audio chunks of recordings, as transcribe() takes them."""
    rows = recordings.filter(F.col("path").isNotNull()).select("video_id", "path", F.explode(chunk_starts(F.col("duration"), seconds).cast("array<int>")).alias("second"))
    made = _cuts(rows, make, "audio", lambda plug, path, second: plug.audio(path, second, seconds), **call)
    return made.select("video_id", F.floor(F.col("second") / seconds).cast("long").alias("index"), F.col("second").alias("start"), "audio", "error")


def understand(shots: DataFrame, make: Callable[[], Viewer], prompt: str = UNDERSTAND, **call) -> DataFrame:
    """video_id, understanding and error from the frames of each recording (as many as frames() takes, so a bounded row).

    Frames that failed are left out; a recording without any is an error.
    """
    listed = shots.filter(F.col("image").isNotNull()).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("second", "image"))).alias("shots"))
    listed = shots.select("video_id").distinct().join(listed, "video_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plug = make()
        for part in parts:
            rows = []
            for video_id, found in zip(part["video_id"], part["shots"], strict=True):
                if found is None:
                    rows.append([video_id, None, "no frames"])
                    continue
                times = ", ".join(str(s["second"]) for s in found)
                text, error, _ = tried(plug.reply_to_many, prompt.replace("{times}", times), [bytes(s["image"]) for s in found], **call)
                rows.append([video_id, text, error])
            yield pd.DataFrame(rows, columns=["video_id", "understanding", "error"], dtype=object)

    return listed.mapInPandas(run, "video_id long, understanding string, error string")
