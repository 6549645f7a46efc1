"""Plug-ins that look at pixels and sound: layout detectors, and speech models; deterministic stand-ins for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from foliate.schema import LAYOUT_BLOCKS


class Detector(Protocol):
    """Regions of a page picture: (class id, (x1, y1, x2, y2), confidence) each."""

    def detect(self, image: bytes | None, width: int, height: int) -> list[tuple[int, tuple[int, int, int, int], float]]: ...


class Transcriber(Protocol):
    def transcribe(self, audio: bytes | None, start: int) -> str: ...


class StripDetector:
    """A stand-in without a model: the page cut into three strips, title, text and picture."""

    def detect(self, image: bytes | None, width: int, height: int) -> list[tuple[int, tuple[int, int, int, int], float]]:
        third = height // 3
        return [(k, (0, k * third, width, (k + 1) * third), 0.9 - k / 10) for k in range(3)]


DETECTORS: dict[str, Callable[[], Detector]] = {"strips": StripDetector}


def detector(name: str) -> Callable[[], Detector]:
    if name not in DETECTORS:
        raise ValueError(f"unknown layout engine {name!r}; known: {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name]


def detect(pages: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """Layout rows of page pictures (doc_id, page_number, width, height, image if there is one), one detector a task.

    Pictures go to the plug-in and no further: the result holds boxes alone. A page that the detector fails on becomes one
    text region of confidence 1, so that a model still reads all of it, and no other page is lost.
    """
    from foliate.schema import BLOCK_TYPES

    names = [part.split()[0] for part in ("doc_id", "page_number", "pos", "block_type", "bbox", "confidence", "reading_order", "column_id")]
    image = "image" in pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = make()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    regions = found.detect(r.image if image else None, int(r.width), int(r.height))
                except Exception:  # noqa: BLE001
                    regions = [(BLOCK_TYPES.index("text"), (0, 0, int(r.width), int(r.height)), 1.0)]
                for pos, (kind, box, confidence) in enumerate(regions):
                    name = BLOCK_TYPES[kind] if 0 <= kind < len(BLOCK_TYPES) else "text"
                    rows.append([r.doc_id, r.page_number, pos, name, dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)), float(confidence), 0, None])
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("doc_id", "page_number", "width", "height", *(["image"] if image else [])).mapInPandas(run, LAYOUT_BLOCKS)


def transcribe(chunks: DataFrame, make: Callable[[], Transcriber]) -> DataFrame:
    """Segments (video_id, index, text, error) of audio chunks (video_id, index, start, audio if there is one)."""
    audio = "audio" in chunks.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows.append([r.video_id, r.index, model.transcribe(r.audio if audio else None, int(r.start)), None])
                except Exception as problem:  # noqa: BLE001
                    rows.append([r.video_id, r.index, None, str(problem)])
            yield pd.DataFrame(rows, columns=["video_id", "index", "text", "error"], dtype=object)

    return chunks.select("video_id", "index", "start", *(["audio"] if audio else [])).mapInPandas(run, "video_id long, index long, text string, error string")
