"""Blocks of native pages, fallback regions, and deduplication within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.geometry import containment
from foliate.functions.markdown import cells_table
from foliate.functions.text import UNASSIGNED, has_formula_font, share, strip
from foliate.operators.layout import PAGE

FALLBACK_FONTS = ("CMMI", "CMBX", "Cambria Math")


def text_lines(spans: DataFrame) -> DataFrame:
    """Lines from spans (doc_id, page_number, line, pos, text, size, font, flags): size and font of the last span, bold
    (bit 4) and italic (bit 1) if any span is; blank lines are left out."""
    by_pos = F.struct("pos", "text", F.coalesce("size", F.lit(12.0)).alias("size"), F.coalesce("font", F.lit("")).alias("font"))
    lines = spans.groupBy(*PAGE, "line").agg(
        F.array_sort(F.collect_list(by_pos)).alias("s"),
        F.max((F.col("flags").bitwiseAND(16) > 0).cast("int")).alias("bold"), F.max((F.col("flags").bitwiseAND(2) > 0).cast("int")).alias("italic"),
    )
    last = F.element_at("s", -1)
    text = strip(F.array_join(F.transform("s", lambda x: F.coalesce(x["text"], F.lit(""))), ""))
    return lines.select(*PAGE, "line", text.alias("text"), last["size"].alias("font_size"), last["font"].alias("font_name"), (F.col("bold") == 1).alias("is_bold"), (F.col("italic") == 1).alias("is_italic")).filter("text <> ''")


def heading(size: Column, bold: Column) -> Column:
    """Lines of native text that are titles: bold above 14 points, or anything above 16."""
    return F.when((bold & (size > 14)) | (size > 16), "title").otherwise("text")


def embedded_images(images: DataFrame) -> DataFrame:
    """A row for each place of each embedded picture (rects: array of boxes)."""
    return images.withColumn("bbox", F.explode("rects")).drop("rects")


def table_cells(raw: Column) -> Column:
    """Extracted rows with null cells as empty ones."""
    return F.transform(raw, lambda r: F.transform(r, lambda c: F.coalesce(c.cast("string"), F.lit(""))))


def native_blocks(lines: DataFrame, images: DataFrame, tables: DataFrame, min_size: int = 50) -> DataFrame:
    """Blocks of native pages: text lines in order, then pictures that are large enough, then tables (both at order 0).

    lines: text_lines with bbox; images: page keys, nth (from 1), width, height, bbox; tables: page keys, nth, bbox, cells.
    """
    empty = F.lit(None).cast("string")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line")) - 1
    texts = lines.select(*PAGE, F.lit(0).alias("branch"), F.col("line").alias("nth"), heading(F.col("font_size"), F.col("is_bold")).alias("block_type"), "bbox", number.alias("reading_order"), F.col("text").alias("content"), F.lit("text").alias("content_type"), empty.alias("image_path"))
    large = images.filter((F.col("width") >= min_size) & (F.col("height") >= min_size))
    path = F.concat(F.lit("images/page"), F.col("page_number").cast("string"), F.lit("_fig"), F.col("nth").cast("string"), F.lit(".png"))
    pictures = large.select(*PAGE, F.lit(1).alias("branch"), "nth", F.lit("image").alias("block_type"), "bbox", F.lit(0).alias("reading_order"), F.lit("").alias("content"), F.lit("text").alias("content_type"), path.alias("image_path"))
    grids = tables.select(*PAGE, F.lit(2).alias("branch"), "nth", F.lit("table").alias("block_type"), "bbox", F.lit(0).alias("reading_order"), cells_table(table_cells(F.col("cells"))).alias("content"), F.lit("markdown_table").alias("content_type"), empty.alias("image_path"))
    return texts.unionByName(pictures).unionByName(grids).withColumn("source", F.lit("native"))


def fallback_regions(spans: DataFrame, lines: DataFrame, garbled: float = 0.05, patterns: tuple[str, ...] = FALLBACK_FONTS) -> DataFrame:
    """Regions of mixed pages that a model shall read: blocks with formula fonts, then lines of garbled text; of equal
    boxes on a page the first reason stays. spans: pos, font, bbox (of the block); lines: pos, text, bbox."""
    formula = spans.filter(has_formula_font(F.array("font"), patterns)).select(*PAGE, F.lit(0).alias("kind"), "pos", "bbox", F.lit("formula").alias("reason"))
    broken = lines.filter(share(F.col("text"), UNASSIGNED) > garbled).select(*PAGE, F.lit(1).alias("kind"), "pos", "bbox", F.lit("garbled_text").alias("reason"))
    return first_reasons(formula.unionByName(broken).withColumn("order_", F.struct("kind", "pos")), *PAGE, "bbox").drop("kind")


def first_reasons(regions: DataFrame, *keys: str) -> DataFrame:
    """Of regions (order_, ...) that agree in keys the first one by order_."""
    rest = [c for c in regions.columns if c not in (*keys, "order_")]
    return regions.groupBy(*keys).agg(F.min_by(F.struct(*rest), "order_").alias("first_")).select(*keys, *(F.col(f"first_.{c}").alias(c) for c in rest))


def fallback_blocks(answered: DataFrame) -> DataFrame:
    """Blocks of fallback regions with a model's reply or error: formulas stay formulas, the rest is text."""
    kind = F.when(F.col("reason") == "formula", "formula").otherwise("text")
    failed = F.col("error").isNotNull()
    return answered.select(*PAGE, "pos", kind.alias("block_type"), "bbox", F.when(failed, F.concat(F.lit("[OCR_FAILED: page "), F.col("page_number").cast("string"), F.lit("]"))).otherwise(F.col("reply")).alias("content"), F.when(failed, "error").otherwise("vlm_fallback").alias("source"))


def combine(native: DataFrame, scanned: DataFrame, fallback: DataFrame) -> DataFrame:
    """All branches' blocks, in this order, with `pos` as their place in the document's list."""
    tagged = [f.withColumn("part_", F.lit(k)) for k, f in enumerate((native, scanned, fallback))]
    every = tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("part_", "page_number", "pos")) - 1).drop("part_")


def deduplicate(blocks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Of two blocks on a page where one mostly covers the other, the one with less content goes; in list order, ties
    against the later, and a block that has gone rules out nothing.

    Only pairs that overlap are gathered; pages without any pass straight through.
    """
    a = blocks.select(*PAGE, F.col("pos").alias("i"), F.col("bbox").alias("bi"), F.length(F.coalesce("content", F.lit(""))).alias("li"))
    b = blocks.select(*PAGE, F.col("pos").alias("j"), F.col("bbox").alias("bj"), F.length(F.coalesce("content", F.lit(""))).alias("lj"))
    pairs = a.join(b, list(PAGE)).filter((F.col("i") < F.col("j")) & (containment(F.col("bi"), F.col("bj")) > threshold))
    listed = pairs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("i", "j", (F.col("li") >= F.col("lj")).alias("first")))).alias("pairs"))
    loser = lambda p: F.when(p["first"], p["j"]).otherwise(p["i"])
    gone = F.aggregate("pairs", F.array().cast("array<int>"), lambda s, p: F.when(F.array_contains(s, p["i"]) | F.array_contains(s, p["j"]), s).otherwise(F.array_append(s, loser(p))))
    return blocks.join(listed.select(*PAGE, F.explode(gone).alias("pos")), [*PAGE, "pos"], "left_anti")
