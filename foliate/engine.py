"""The facade: the verbs of the service as functions that return DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import fields

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate import config as C
from foliate.functions import geometry as G
from foliate.operators import cache as K
from foliate.operators import images as I
from foliate.operators import media as V
from foliate.operators import recognize as R
from foliate.operators import video as W
from foliate.operators.assemble import MarkdownConfig
from foliate.operators.classify import DetectionConfig, classify, estimate, page_types, within_budget
from foliate.operators.detect import detect, detector, transcribe
from foliate.operators.layout import LayoutConfig, clean_layout
from foliate.plans.convert import convert
from foliate.plans.pages import PagePlan, convert_pages
from foliate.sources.documents import check_requests, parse_files, read_files
from foliate.sources.pdf import PDF_PAGES, pdf_parser
from foliate.sources.sinks import zipped
from foliate.streaming import events as E


class Engine:
    """Engine(spark, settings): files, classify, estimate, convert, convert_pages, convert_files, layout, detect, audio, video,
    check, and the verbs of tasks: validate, status, cancel, notify, archive. submit runs any of them in the background."""

    def __init__(self, spark: SparkSession, settings: dict | None = None):
        self.spark = spark
        self.settings = C.merge(C.DEFAULTS, settings or {})
        self._progress: Callable[..., None] | None = None
        self._pool: ThreadPoolExecutor | None = None
        if wrong := C.validate(self.settings):
            raise ValueError("; ".join(wrong))

    def set_progress_callback(self, call: Callable[..., None] | None) -> None:
        """call(stage), or call(stage, done, total) where pages are counted."""
        self._progress = call

    def _report(self, stage: str, *counts: int) -> None:
        if self._progress:
            self._progress(stage, *counts)

    def submit(self, verb: str, *args, **more) -> Future:
        """A verb in the background; its future gives the DataFrame, or the error."""
        self._pool = self._pool or ThreadPoolExecutor(4)
        return self._pool.submit(getattr(self, verb), *args, **more)

    @property
    def detection(self) -> DetectionConfig:
        s = self.settings["pdf_detection"]
        return DetectionConfig(s["force_mode"], s["text_quality_threshold"], s["min_text_chars"], tuple(s["formula_font_patterns"]))

    @property
    def layout_config(self) -> LayoutConfig:
        s = self.settings["layout"]
        return LayoutConfig(s["confidence_threshold"], tuple(s["discard_types"]), merge_adjacent_text=s["merge_adjacent_text"], detect_columns=s["detect_columns"], detect_reading_order=s["detect_reading_order"])

    @property
    def markdown(self) -> MarkdownConfig:
        known = {f.name for f in fields(MarkdownConfig)}
        return MarkdownConfig(**{k: v for k, v in self.settings["markdown"].items() if k in known})

    @property
    def ttl(self) -> dict[str, int]:
        s = self.settings["cache"]
        return {"layout": s["layout_cache_ttl_hours"] * 3600, "vlm": s["vlm_cache_ttl_days"] * 86400, "document": s["document_cache_ttl_days"] * 86400}

    @property
    def calls(self) -> dict:
        """What recognize() takes. The limit on concurrent calls holds for a task."""
        s = self.settings["vlm"]
        return {"retries": s["max_retries"], "timeout": s["timeout"], "concurrent": s["max_concurrent"]}

    def recognizer(self) -> Callable[[], R.Recognizer]:
        """The model of the settings: an endpoint if an address is set, else the stand-in."""
        s = self.settings["vlm"]
        if not s["api_base_url"]:
            return R.EchoRecognizer
        given = (s["api_base_url"], s["api_key"], s["model"], s["temperature"], s["timeout"])
        return lambda: R.ChatRecognizer(*given)

    def plan(self, recognizer: Callable | None = None, layout_engine: str | Callable = "strips") -> PagePlan:
        s, n = self.settings["vlm"], self.settings["native_extract"]
        make = detector(layout_engine) if isinstance(layout_engine, str) else layout_engine
        return PagePlan(
            self.detection, self.layout_config, self.markdown, make, recognizer or self.recognizer(), s["batch_regions"], s["max_regions_per_batch"], s["max_region_distance"], s["complexity_threshold"], s["vlm_downsample_ratio"],
            self.calls, n["garbled_text_threshold"], tuple(n["formula_font_patterns"]),
        )

    def files(self, folder: str, pattern: str = "*.pdf", recursive: bool = False, parser=pdf_parser, schema: str = PDF_PAGES) -> DataFrame:
        self._report("read")
        return parse_files(read_files(self.spark, folder, pattern, recursive), parser, schema)

    def classify(self, pages: DataFrame) -> DataFrame:
        self._report("classify")
        return classify(pages, self.detection)

    def estimate(self, pages: DataFrame, *keys: str) -> DataFrame:
        self._report("estimate")
        made = estimate(classify(pages, self.detection), *keys, max_regions=self.settings["vlm"]["max_regions_per_batch"])
        return within_budget(made, self.settings["cost_control"]["budget_limit_yuan"])

    def validate(self, pages: DataFrame) -> DataFrame:
        """Pages of each type: what a conversion would do, without doing it."""
        self._report("validate")
        return page_types(classify(pages, self.detection))

    def layout(self, blocks: DataFrame, width: DataFrame | int = 600) -> DataFrame:
        """width: that of all pages, or a table of pages (doc_id, page_number, width)."""
        self._report("layout")
        return clean_layout(blocks, self.layout_config, width)

    def preprocess(self, pages: DataFrame) -> DataFrame:
        s = self.settings["preprocessing"]
        made = I.preprocess(pages, s["enable_rotation_correction"], s["enable_deskew"], s["enable_inversion_detection"])
        return made.withColumn("skew_angle", I.deskew(F.col("skew"), s["deskew_threshold_degrees"])) if s["enable_deskew"] else made

    def splits(self, height: Column) -> Column:
        s = self.settings["render"]
        return G.splits(height, s["max_page_height_px"], s["split_height"], s["split_overlap"])

    def rendered(self, points: Column) -> Column:
        return G.rendered(points, self.settings["render"]["render_dpi"])

    def crops(self, blocks: DataFrame, page_width: int, page_height: int) -> DataFrame:
        s = self.settings["image_extraction"]
        return I.crop_manifest(blocks, page_width, page_height, s["format"], s["min_size"], s["padding"])

    def cached(self, requests: DataFrame, entries: DataFrame, tier: str, now: float) -> tuple[DataFrame, DataFrame]:
        """(hits, misses) by entries that still hold."""
        return K.split_cached(requests, entries, tier, now, self.ttl)

    def recognize(self, requests: DataFrame) -> DataFrame:
        self._report("recognize")
        return R.recognize(requests, self.recognizer(), **self.calls)

    def convert(self, blocks: DataFrame, heights: DataFrame | None = None) -> DataFrame:
        self._report("convert")
        return convert(blocks, heights, config=self.markdown)

    def convert_pages(self, pages: DataFrame, recognizer: Callable | None = None, layout_engine: str | Callable = "strips", images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
        """doc_id and markdown of pages, from the text layer or a model; see plans.pages."""
        if self._progress:
            total = pages.count()
            self._report("convert", 0, total)
        made = convert_pages(pages, self.plan(recognizer, layout_engine), images, tables)
        if self._progress:
            self._report("convert", total, total)
        return made

    def convert_files(self, folder: str, recursive: bool = False, recognizer: Callable | None = None, layout_engine: str | Callable = "strips") -> DataFrame:
        """doc_id, path, markdown and error of the PDF files of a folder; a file that can't be read has an error alone."""
        pages = self.files(folder, recursive=recursive)
        pages = pages.withColumn("doc_id", F.xxhash64("path")).persist(StorageLevel.DISK_ONLY)  # each file is parsed once
        good = pages.filter("error is null").drop("error", "path", "md5")
        made = self.convert_pages(good, recognizer, layout_engine)
        about = pages.groupBy("doc_id", "path").agg(F.max("error").alias("error"))
        return about.join(made, "doc_id", "left").select("doc_id", "path", "markdown", "error")

    def detect(self, pages: DataFrame, engine: str = "strips") -> DataFrame:
        self._report("detect")
        return detect(pages, detector(engine))

    def audio(self, recordings: DataFrame, segments: DataFrame) -> DataFrame:
        """video_id and markdown of recordings (video_id, url, title, uploader, duration) with a transcript."""
        self._report("audio")
        rows = recordings.join(V.transcripts(segments), "video_id")
        return rows.select("video_id", V.audio_markdown(*(F.col(c) for c in ("url", "title", "uploader", "duration", "transcript"))).alias("markdown"))

    def video(self, recordings: DataFrame) -> DataFrame:
        """video_id and markdown of recordings that a model has understood (column understanding)."""
        self._report("video")
        s = self.settings["video"]
        frames = F.size(V.frame_times(F.col("duration"), s["frame_interval_seconds"], s["max_key_frames"]))
        return recordings.select("video_id", V.video_markdown(*(F.col(c) for c in ("url", "title", "uploader", "duration")), frames, F.col("understanding")).alias("markdown"))

    def watch(self, urls: DataFrame, fetcher: Callable[[], W.Fetcher], grabber: Callable[[], W.Grabber], viewer: Callable[[], W.Viewer] | None = None, transcriber: Callable | None = None) -> DataFrame:
        """video_id and markdown of what is behind urls (video_id, url): seen by `viewer`, or heard by `transcriber`."""
        s, tries = self.settings["video"], {"retries": self.settings["vlm"]["max_retries"]}
        recordings = W.fetch(urls, fetcher, **tries)
        if transcriber:
            chunks = W.audio_chunks(recordings, grabber, s["audio_chunk_seconds"], **tries).filter("error is null")
            return self.audio(recordings, transcribe(chunks, transcriber).filter("error is null"))
        shots = W.frames(recordings, grabber, s["frame_interval_seconds"], s["max_key_frames"], **tries)
        return self.video(recordings.drop("error").join(W.understand(shots, viewer, **tries).filter("error is null"), "video_id"))

    def check(self, requests: DataFrame) -> DataFrame:
        s = self.settings["api"]
        return check_requests(requests, s["max_file_size_mb"], s["max_pages"], s["async_threshold_pages"])

    def status(self, events: DataFrame) -> DataFrame:
        return E.latest_state(events)

    def cancel(self, events: DataFrame, tasks: DataFrame, ts: Column) -> DataFrame:
        return E.cancelled(events, tasks, ts)

    def notify(self, states: DataFrame, make: Callable) -> DataFrame:
        return E.notify(states, make, retries=self.settings["vlm"]["max_retries"], timeout=self.settings["vlm"]["timeout"])

    def archive(self, results: DataFrame) -> DataFrame:
        return zipped(results)

    def describe(self) -> str:
        """The settings as JSON, with the key masked."""
        shown = C.merge(self.settings, {"vlm": {"api_key": "***"}} if self.settings["vlm"]["api_key"] else {})
        return json.dumps(shown, indent=2, ensure_ascii=False)
