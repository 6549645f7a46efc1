"""From regions to recognition requests: routing, batches, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.geometry import scale
from foliate.operators.layout import PAGE
from foliate.schema import RECOGNIZED

#: Prompts by key; {x1} to {y2} are a region's corners, {regions_description} the list of a batch.
PROMPTS = {
    "text": "Transcribe the text in the region from ({x1}, {y1}) to ({x2}, {y2}) exactly. Keep its paragraphs. Answer with the text alone.",
    "title": "Transcribe the heading in the region from ({x1}, {y1}) to ({x2}, {y2}). Answer with plain text without # marks.",
    "table": "Transcribe the table in the region from ({x1}, {y1}) to ({x2}, {y2}) as a Markdown pipe table, cell by cell.",
    "formula": "Transcribe the formula in the region from ({x1}, {y1}) to ({x2}, {y2}) as LaTeX between $$ marks.",
    "caption": "Transcribe the caption in the region from ({x1}, {y1}) to ({x2}, {y2}).",
    "image_alt": "Describe the picture in the region from ({x1}, {y1}) to ({x2}, {y2}) in one sentence.",
    "list": "Transcribe the list in the region from ({x1}, {y1}) to ({x2}, {y2}) as a Markdown list.",
    "code": "Transcribe the code in the region from ({x1}, {y1}) to ({x2}, {y2}) in a fenced block, indentation included.",
    "reference": "Transcribe the references in the region from ({x1}, {y1}) to ({x2}, {y2}), one entry a line.",
    "batch": "Transcribe each of these regions. Put its tag on a line of its own before its content.\n{regions_description}",
    "full_page": "Transcribe the whole page as Markdown in reading order.",
}

#: Region types with a prompt of their own name, but for pictures; all others use that for text.
PROMPT_KEYS = {t: t for t in ("text", "title", "table", "formula", "caption", "list", "code", "reference")} | {"image": "image_alt"}


def _choice(block_type: Column, templates: dict[str, str]) -> Column:
    choice = F.lit(templates["text"])
    for kind, key in PROMPT_KEYS.items():
        choice = F.when(block_type == kind, F.lit(templates[key])).otherwise(choice)
    return choice


def prompt(block_type: Column, bbox: Column, custom: dict[str, str] | None = None, context: str = "") -> Column:
    """A region's prompt; custom templates replace those of their keys, context stands before."""
    out = _choice(block_type, PROMPTS | (custom or {}))
    for corner in ("x1", "y1", "x2", "y2"):
        out = F.replace(out, F.lit("{" + corner + "}"), bbox[corner].cast("string"))
    return F.concat(F.lit(context + "\n\n"), out) if context else out


def batch_prompt(regions: Column, custom: dict[str, str] | None = None) -> Column:
    """The prompt of a request with several regions (array of struct bbox, block_type), numbered from 1."""

    def line(r: Column, k: Column) -> Column:
        corner = lambda a, b: F.concat(F.lit("("), r["bbox"][a].cast("string"), F.lit(", "), r["bbox"][b].cast("string"), F.lit(")"))
        return F.concat(F.lit("[REGION_"), (k + 1).cast("string"), F.lit("] type="), r["block_type"], F.lit(", box="), corner("x1", "y1"), F.lit(" to "), corner("x2", "y2"))

    template = (PROMPTS | (custom or {}))["batch"]
    return F.replace(F.lit(template), F.lit("{regions_description}"), F.array_join(F.transform(regions, line), "\n"))


def route_regions(blocks: DataFrame) -> DataFrame:
    """A row for each region and way it goes: crop for pictures, recognize, and table_crop beside it for tables."""
    kind = F.col("block_type")
    ways = F.when(kind == "image", F.array(F.lit("crop"))).when(kind == "table", F.array(F.lit("recognize"), F.lit("table_crop"))).when(kind.isin(*RECOGNIZED), F.array(F.lit("recognize"))).otherwise(F.array().cast("array<string>"))
    return blocks.withColumn("route", F.explode(ways))


def batches(blocks: DataFrame, max_regions: int = 5, max_distance: int = 500, complexity: int = 15) -> DataFrame:
    """blocks of types that are recognised, with request_id (from 0 on each page) and region_num (from 1).

    Neighbours in order of type and upper edge share a request while the type stays, the distance is small and there is
    room. Pages of many regions use smaller batches and half the distance; one or two texts alone are one request.
    """
    page = Window.partitionBy(*PAGE)
    order = page.orderBy("block_type", "bbox.y1", "pos")
    made = blocks.filter(F.col("block_type").isin(*RECOGNIZED)).withColumns({"n_": F.count("*").over(page), "plain_": F.min(F.col("block_type").isin("text", "title").cast("int")).over(page)})
    simple = (F.col("n_") <= 2) & (F.col("plain_") == 1)
    room = F.when(F.col("n_") > complexity, min(max_regions, 3)).otherwise(max_regions)
    near = F.when(F.col("n_") > complexity, max_distance // 2).otherwise(max_distance)
    made = made.withColumns({"type_": F.lag("block_type").over(order), "bottom_": F.lag("bbox.y2").over(order)})
    breaks = F.when(simple, 0).when(F.col("type_").isNull() | (F.col("type_") != F.col("block_type")) | (F.abs(F.col("bbox.y1") - F.col("bottom_")) >= near), 1).otherwise(0)
    made = made.withColumn("run_", F.sum(breaks).over(order))
    place = F.row_number().over(Window.partitionBy(*PAGE, "run_").orderBy("block_type", "bbox.y1", "pos")) - 1
    by_pos = F.row_number().over(page.orderBy("pos")) - 1
    made = made.withColumns({"place_": F.when(simple, by_pos).otherwise(place), "chunk_": F.when(simple, F.lit(0)).otherwise(F.floor(place / room)).cast("int")})
    made = made.withColumn("request_id", F.dense_rank().over(page.orderBy("run_", "chunk_")) - 1)
    number = F.when(simple, F.col("place_")).otherwise(F.col("place_") - F.col("chunk_") * room) + 1
    return made.withColumn("region_num", number.cast("int")).drop("n_", "plain_", "type_", "bottom_", "run_", "place_", "chunk_")


def single_requests(blocks: DataFrame) -> DataFrame:
    """As batches, with a request for each region, in list order."""
    order = Window.partitionBy(*PAGE).orderBy("pos")
    return blocks.filter(F.col("block_type").isin(*RECOGNIZED)).withColumns({"request_id": F.row_number().over(order) - 1, "region_num": F.lit(1)})


def requests(batched: DataFrame, ratio: float = 0.7) -> DataFrame:
    """A row for each request: its regions in order, boxes scaled down with the picture, and its prompt."""
    r = min(float(ratio), 1.0)
    region = F.struct("region_num", (scale(F.col("bbox"), r) if r < 1 else F.col("bbox")).alias("bbox"), "block_type")
    made = batched.groupBy(*PAGE, "request_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    one = F.element_at("regions", 1)
    text = F.when(F.size("regions") == 1, prompt(one["block_type"], one["bbox"])).otherwise(batch_prompt(F.col("regions")))
    return made.withColumns({"downsample_ratio": F.lit(r), "prompt": text})
