"""Cleaning detected regions: suppression, columns, merging of text, reading order.

Greedy, order-bound steps are folds over a page's regions inside generated code; a page is the unit, never the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.geometry import box, containment, iou
from foliate.schema import BLOCK_TYPES, MARGINAL

PAGE = ("doc_id", "page_number")


@dataclass(frozen=True)
class LayoutConfig:
    confidence_threshold: float = 0.5
    discard_types: tuple[str, ...] = MARGINAL
    iou_threshold: float = 0.5
    containment_threshold: float = 0.7
    gap_threshold: int = 20
    merge_adjacent_text: bool = True
    detect_columns: bool = True
    detect_reading_order: bool = True


def class_name(class_id: Column) -> Column:
    """A detector's class id as a region type; unknown ids are text."""
    names = F.array(*map(F.lit, BLOCK_TYPES))
    return F.when((class_id >= 0) & (class_id < len(BLOCK_TYPES)), F.get(names, class_id.cast("int"))).otherwise("text")


def confident(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Regions of enough confidence whose type is not discarded."""
    return blocks.filter((F.col("confidence") >= config.confidence_threshold) & ~F.col("block_type").isin(*config.discard_types))


def _listed(blocks: DataFrame, order: Column, rest: tuple[str, ...]) -> DataFrame:
    """A row for each page with its regions in order."""
    return blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(order.alias("rank_"), "pos", "bbox", "block_type", "confidence", *rest))).alias("blocks"))


def _rows(pages: DataFrame) -> DataFrame:
    made = pages.select(*PAGE, F.explode("blocks").alias("b"))
    return made.select(*PAGE, *(F.col(f"b.{f.name}").alias(f.name) for f in made.schema["b"].dataType.fields if f.name != "rank_"))


def suppress(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Greedy suppression by confidence, ties in list order: a region goes if one that stays overlaps it too much."""
    pages = _listed(blocks, -F.col("confidence"), tuple(c for c in blocks.columns if c not in (*PAGE, "pos", "bbox", "block_type", "confidence")))

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: (iou(b["bbox"], k["bbox"]) > config.iou_threshold) | (containment(b["bbox"], k["bbox"]) > config.containment_threshold))
        return F.when(clash, kept).otherwise(F.array_append(kept, b))

    return _rows(pages.withColumn("blocks", F.aggregate("blocks", F.slice("blocks", 1, 0), step)))


def column_gaps(blocks: DataFrame, width: Column | int = 600) -> DataFrame:
    """The widest uncovered run of each page's middle, at least a twentieth of the width: gap_start and gap_end, else null.

    A run counts from the middle's left edge (30 %) and only if a box closes it before the right edge (70 %).
    """
    w = width if isinstance(width, Column) else F.lit(width)
    lo, hi = (w * 3 / 10).cast("int"), (w * 7 / 10).cast("int")
    least = (w / 20).cast("int")
    edges = blocks.select(*PAGE, "pos", F.greatest(F.lit(0), F.col("bbox.x1")).alias("a"), F.least(w, F.col("bbox.x2")).alias("b"), lo.alias("lo"), hi.alias("hi"), least.alias("least")).filter("a < b")
    before = Window.partitionBy(*PAGE).orderBy("a", "b", "pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.coalesce(F.max("b").over(before), F.lit(0)), F.col("lo"))
    gaps = edges.withColumn("gap_start", start).filter("a < hi and a > gap_start and a - gap_start >= least")
    best = gaps.groupBy(*PAGE).agg(F.max(F.struct((F.col("a") - F.col("gap_start")).alias("size"), (-F.col("gap_start")).alias("first"), F.col("a").alias("gap_end"))).alias("g"))
    return best.select(*PAGE, (-F.col("g.first")).alias("gap_start"), F.col("g.gap_end").alias("gap_end"))


def assign_columns(blocks: DataFrame, width: Column | int = 600) -> DataFrame:
    """blocks with column_id: 0 left and 1 right of the page's gap by the box's centre, null on pages of one column."""
    w = width if isinstance(width, Column) else F.lit(width)
    several = blocks.groupBy(*PAGE).agg(F.count("*").alias("n_")).filter("n_ > 1").drop("n_")
    gaps = column_gaps(blocks, w).join(several, list(PAGE), "left_semi")
    middle = (F.col("bbox.x1") + F.col("bbox.x2")) / 2
    column = F.when(F.col("gap_start").isNotNull(), F.when((middle >= 0) & (middle <= F.col("gap_start")), 0).when((middle >= F.col("gap_end")) & (middle <= w), 1).otherwise(0))
    return blocks.drop("column_id").join(gaps, list(PAGE), "left").withColumn("column_id", column.cast("int")).drop("gap_start", "gap_end")


def merge_text(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Text regions of a column merged where the next begins 0 to gap_threshold below and shares over half its width.

    Other regions come first, then merged ones: pos is the new place in the list, on all pages.
    """
    column = F.coalesce("column_id", F.lit(0))
    item = F.struct(column.alias("c"), F.col("bbox.y1").alias("y"), "pos", "bbox", "confidence", "column_id")
    is_text = F.col("block_type") == "text"
    other = F.struct("pos", "bbox", "block_type", "confidence", "column_id")
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.when(is_text, item))).alias("texts"), F.array_sort(F.collect_list(F.when(~is_text, other))).alias("others"), F.array_sort(F.collect_list(other)).alias("all"))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        a, n = last["bbox"], b["bbox"]
        gap = n["y1"] - a["y2"]
        shared = F.least(a["x2"], n["x2"]) - F.greatest(a["x1"], n["x1"])
        narrow = F.least(a["x2"] - a["x1"], n["x2"] - n["x1"])
        joins = (last["c"] == b["c"]) & (gap >= 0) & (gap <= config.gap_threshold) & (2 * shared > narrow)
        merged = F.struct(last["c"].alias("c"), last["y"].alias("y"), last["pos"].alias("pos"), box(F.least(a["x1"], n["x1"]), a["y1"], F.greatest(a["x2"], n["x2"]), n["y2"]).alias("bbox"), F.least(last["confidence"], b["confidence"]).alias("confidence"), last["column_id"].alias("column_id"))
        return F.when(joins, F.array_append(F.slice(done, 1, F.size(done) - 1), merged)).otherwise(F.array_append(done, b))

    folded = F.aggregate(F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))), F.slice("texts", 1, 1), step)
    as_other = F.transform(folded, lambda t: F.struct(t["pos"], t["bbox"], F.lit("text").alias("block_type"), t["confidence"], t["column_id"]))
    made = F.when(F.size("texts") <= 1, F.col("all")).otherwise(F.concat("others", as_other))
    return pages.select(*PAGE, F.posexplode(made).alias("pos", "b")).select(*PAGE, "pos", "b.bbox", "b.block_type", "b.confidence", "b.column_id")


def reading_order(blocks: DataFrame, mode: str = "column") -> DataFrame:
    """reading_order from 0 on: by column and vertical centre, or (mode "y") by the upper edge; ties in list order."""
    centre = (F.col("bbox.y1") + F.col("bbox.y2")) / 2
    keys = [F.coalesce("column_id", F.lit(0)), centre] if mode == "column" else [F.col("bbox.y1")]
    return blocks.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*keys, "pos")) - 1)


def clean_layout(blocks: DataFrame, config: LayoutConfig = LayoutConfig(), width: DataFrame | int = 600) -> DataFrame:
    """Raw detections (doc_id, page_number, pos, block_type, bbox, confidence) to ordered regions.

    width: that of all pages, or a table of pages (doc_id, page_number, width); where it has none, 600 holds.
    """
    kept = suppress(confident(blocks, config).select(*PAGE, "pos", "bbox", "block_type", "confidence"), config)
    # From here on the list is in order of confidence.
    kept = kept.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("confidence"), "pos")) - 1)
    if not config.detect_columns:
        kept = kept.withColumn("column_id", F.lit(None).cast("int"))
    elif isinstance(width, DataFrame):
        kept = kept.join(width.select(*PAGE, F.col("width").alias("width_")), list(PAGE), "left")
        kept = assign_columns(kept.fillna(600, ["width_"]), F.col("width_")).drop("width_")
    else:
        kept = assign_columns(kept, width)
    kept = merge_text(kept, config) if config.merge_adjacent_text else kept
    return reading_order(kept) if config.detect_reading_order else kept.withColumn("reading_order", F.lit(0))


def blocks_per_page(blocks: DataFrame, *keys: str) -> DataFrame:
    return blocks.groupBy(*(keys or PAGE)).agg(F.count("*").alias("blocks"))
