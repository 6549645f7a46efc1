"""From pages to Markdown: classified, read from the text layer or recognised, combined, converted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.geometry import box
from foliate.operators import blocks as B
from foliate.operators import dispatch as D
from foliate.operators import layout as L
from foliate.operators import recognize as R
from foliate.operators.assemble import MarkdownConfig
from foliate.operators.classify import DetectionConfig, classify, route_pages
from foliate.operators.detect import Detector, StripDetector, detect
from foliate.operators.images import crop_manifest
from foliate.plans.convert import convert
from foliate.schema import BOX

IMAGES = f"doc_id long, page_number int, nth int, width int, height int, bbox {BOX}"
TABLES = f"doc_id long, page_number int, nth int, bbox {BOX}, cells array<array<string>>"


@dataclass(frozen=True)
class PagePlan:
    """The settings of all steps; models are made once in each task."""

    detection: DetectionConfig = DetectionConfig()
    layout: L.LayoutConfig = L.LayoutConfig()
    markdown: MarkdownConfig = MarkdownConfig()
    detector: Callable[[], Detector] = StripDetector
    recognizer: Callable[[], R.Recognizer] = R.EchoRecognizer
    batched: bool = True
    max_regions: int = 5
    max_distance: int = 500
    complexity: int = 15
    ratio: float = 0.7
    call: dict = field(default_factory=dict)  # retries, wait, concurrent, timeout of recognize()
    garbled: float = 0.05
    fallback_fonts: tuple[str, ...] = B.FALLBACK_FONTS


def page_spans(pages: DataFrame) -> DataFrame:
    """A row for each span of the pages' text layer, with its line's number and box."""
    rows = pages.select(*L.PAGE, F.posexplode("spans").alias("pos", "s")).select(*L.PAGE, "pos", "s.*")
    line = Window.partitionBy(*L.PAGE, "line")
    return rows.withColumn("bbox", box(F.min("x1").over(line), F.min("y1").over(line), F.ceil(F.max("x2").over(line)), F.ceil(F.max("y2").over(line))))


def native_scan(pages: DataFrame, images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Blocks of native pages from their spans (text, font, size, flags, x1, x2, y1, y2, line), pictures and tables."""
    spark = pages.sparkSession
    spans = page_spans(pages)
    lines = B.text_lines(spans).join(spans.select(*L.PAGE, "line", "bbox").distinct(), [*L.PAGE, "line"])
    images = spark.createDataFrame([], IMAGES) if images is None else images
    tables = spark.createDataFrame([], TABLES) if tables is None else tables
    made = B.native_blocks(lines, images, tables)
    order = Window.partitionBy(*L.PAGE).orderBy("branch", "nth")
    return made.withColumn("pos", F.row_number().over(order) - 1).drop("branch", "nth")


def ask(batched: DataFrame, pages: DataFrame, plan: PagePlan) -> DataFrame:
    """Answered requests of batched regions, with the page's picture if there is one."""
    requests = D.requests(batched, plan.ratio)
    if "image" in pages.columns:
        requests = requests.join(pages.select(*L.PAGE, "image"), list(L.PAGE), "left")
    return R.recognize(requests, plan.recognizer, **plan.call).drop("image")


def scan(pages: DataFrame, plan: PagePlan = PagePlan()) -> DataFrame:
    """Blocks of scanned and mixed pages: detected, cleaned, recognised in requests, pictures by the names of their crops."""
    sizes = pages.select(*L.PAGE, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *(["image"] if "image" in pages.columns else []))
    regions = L.clean_layout(detect(sizes, plan.detector), plan.layout, sizes)
    regions = regions.persist(StorageLevel.DISK_ONLY)
    batched = D.batches(regions, plan.max_regions, plan.max_distance, plan.complexity) if plan.batched else D.single_requests(regions)
    places = batched.select(*L.PAGE, "request_id", "region_num", "pos", "reading_order", F.col("bbox").alias("box_"))
    answered = ask(batched, sizes, plan).persist(StorageLevel.DISK_ONLY)  # each request is asked once
    read = R.recognized_blocks(answered).join(places, [*L.PAGE, "request_id", "region_num"])
    read = read.select(*L.PAGE, "pos", "block_type", F.col("box_").alias("bbox"), "reading_order", "content", "content_type", F.lit(None).cast("string").alias("image_path"), "source")
    crops = crop_manifest(regions, 1 << 30, 1 << 30).filter("block_type = 'image'")
    pictures = crops.select(*L.PAGE, "pos", "block_type", "bbox", "reading_order", F.lit("").alias("content"), F.lit("text").alias("content_type"), F.concat(F.lit("images/"), F.col("filename")).alias("image_path"), F.lit("vlm").alias("source"))
    return read.unionByName(pictures)


def fallback(pages: DataFrame, plan: PagePlan = PagePlan()) -> DataFrame:
    """Blocks of mixed pages' formulas and garbled lines, read by a model."""
    spans = page_spans(pages)
    lines = B.text_lines(spans).join(spans.select(*L.PAGE, "line", "bbox").distinct(), [*L.PAGE, "line"]).withColumnRenamed("line", "pos")
    regions = B.fallback_regions(spans, lines, plan.garbled, plan.fallback_fonts)
    kind: Column = F.when(F.col("reason") == "formula", "formula").otherwise("text")
    requests = regions.withColumn("prompt", D.prompt(kind, F.col("bbox")))
    if "image" in pages.columns:
        requests = requests.join(pages.select(*L.PAGE, "image"), list(L.PAGE), "left")
    made = B.fallback_blocks(R.recognize(requests, plan.recognizer, **plan.call))
    return made.withColumns({"reading_order": F.lit(0), "content_type": F.when(F.col("block_type") == "formula", "latex").otherwise("text"), "image_path": F.lit(None).cast("string")})


def convert_pages(pages: DataFrame, plan: PagePlan = PagePlan(), images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """doc_id and markdown of pages (doc_id, page_number, text, width, height, spans, image_ratio, image if there is one).

    Native pages come from their text layer, scanned ones from a model, mixed ones from a model with a fallback beside it. What
    is classified and recognised stays on the executors' disks, so that no page is classified and nothing asked twice.
    """
    routed = route_pages(classify(pages, plan.detection)).persist(StorageLevel.DISK_ONLY)
    of = lambda branch: routed.filter(F.col("branch") == branch)
    native_only = lambda rows: None if rows is None else rows.join(of("native").select(*L.PAGE), list(L.PAGE), "left_semi")
    native = native_scan(of("native"), native_only(images), native_only(tables))
    blocks = B.combine(native, scan(of("scan"), plan), fallback(of("fallback"), plan)).withColumn("column_id", F.lit(0))
    heights = pages.select("doc_id", "page_number", F.col("height").cast("int").alias("height"))
    return convert(blocks, heights, "y", plan.markdown)
