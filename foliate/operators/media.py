"""Audio and video: chunks, key frames, transcripts and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import strip


def duration_of(probe: Column) -> Column:
    """A probe's answer in seconds; null where it isn't a number."""
    return probe.try_cast("double")


def frame_times(duration: Column, interval: int = 30, most: int = 20) -> Column:
    """Seconds of the key frames: 0, interval, .. below the duration, `most` at most; none without a duration."""
    last = F.least(F.ceil(duration / interval).cast("int") - 1, F.lit(most - 1))
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * interval)).otherwise(F.array().cast("array<int>"))


def chunk_starts(duration: Column, seconds: int = 600) -> Column:
    """Seconds at which audio chunks start: one chunk for unknown or short durations; no empty last chunk."""
    n = F.ceil(duration / seconds).cast("int")
    return F.when(duration.isNull() | (duration <= seconds), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * seconds))


def transcripts(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Non-blank segments (key, index, text) of each recording, in order, with blank lines between."""
    rows = segments.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda s: s["text"]), "\n\n")
    return rows.groupBy(key).agg(joined.alias("transcript"), F.count("*").alias("segments"))


#: Words of the two documents' heads. Fixed values.
UNKNOWN, AUDIO, VIDEO, SOURCE, UPLOADER, LENGTH, MINUTES, SECONDS, FRAMES = "未知", "音频转录", "视频理解", "> 视频来源：", "> UP主：", "> 时长：", "分", "秒", "> 分析帧数："


def _head(title: Column, kind: str, url: Column, uploader: Column, duration: Column) -> list[Column]:
    unknown = F.lit(UNKNOWN)
    whole = F.coalesce(duration, F.lit(0)).cast("int")
    return [
        F.concat(F.lit("# "), F.coalesce(title, unknown), F.lit(f" — {kind}")), F.lit(""), F.concat(F.lit(SOURCE), url), F.concat(F.lit(UPLOADER), F.coalesce(uploader, unknown)),
        F.concat(F.lit(LENGTH), F.floor(whole / 60).cast("string"), F.lit(MINUTES), (whole % 60).cast("string"), F.lit(SECONDS)),
    ]


def audio_markdown(url: Column, title: Column, uploader: Column, duration: Column, transcript: Column) -> Column:
    lines = [*_head(title, AUDIO, url, uploader, duration), F.lit(""), F.lit("---"), F.lit(""), transcript, F.lit("")]
    return F.concat_ws("\n", *lines)


def video_markdown(url: Column, title: Column, uploader: Column, duration: Column, frames: Column, understanding: Column) -> Column:
    lines = [*_head(title, VIDEO, url, uploader, duration), F.concat(F.lit(FRAMES), frames.cast("string")), F.lit(""), F.lit("---"), F.lit(""), understanding, F.lit("")]
    return F.concat_ws("\n", *lines)
