"""Pictures: render sizes, preprocessing rules, crops and their manifests, alternative texts. Pixels stay in plug-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.geometry import area, padded
from foliate.functions.text import strip
from foliate.operators.layout import PAGE


def rotation(width: Column, height: Column, angle: Column | None = None) -> Column:
    """Degrees to turn a page by: a detector's quarter turn if there is one, else 90 for pages much wider than high."""
    wide = F.when(width > F.lit(1.3) * height, 90).otherwise(0)
    return wide if angle is None else F.when(angle.isin(90, 180, 270), angle).when(angle.isNotNull(), 0).otherwise(wide)


def deskew(angle: Column, least: float = 0.5, most: float = 10.0) -> Column:
    """The angle to straighten by: none where it is unknown, small or implausibly large."""
    return F.when(angle.isNull() | (F.abs(angle) < least) | (F.abs(angle) > most), F.lit(0.0)).otherwise(angle)


def inverted(luminance: Column, dark: float = 100.0) -> Column:
    return F.coalesce(luminance < dark, F.lit(False))


def preprocess(pages: DataFrame, rotate: bool = True, straighten: bool = True, invert: bool = True) -> DataFrame:
    """pages (width, height, skew, luminance) with what is to be done, in this order, and the size after it."""
    turn = rotation(F.col("width"), F.col("height")) if rotate else F.lit(0)
    made = pages.withColumns({"rotation": turn, "skew_angle": deskew(F.col("skew")) if straighten else F.lit(0.0), "is_inverted": inverted(F.col("luminance")) if invert else F.lit(False)})
    across = F.col("rotation").isin(90, 270)
    return made.withColumns({"out_width": F.when(across, F.col("height")).otherwise(F.col("width")), "out_height": F.when(across, F.col("width")).otherwise(F.col("height"))})


def crop_manifest(blocks: DataFrame, page_width: int, page_height: int, fmt: str = "png", min_size: int = 50, padding: int = 5) -> DataFrame:
    """File names and padded boxes of a page's picture and table crops.

    Pictures are numbered before small ones are left out, so numbers may miss; tables have no least size.
    """
    rows = blocks.filter(F.col("block_type").isin("image", "table"))
    number = F.row_number().over(Window.partitionBy(*PAGE, "block_type").orderBy("pos"))
    stem = F.when(F.col("block_type") == "image", "_fig").otherwise("_table")
    name = F.concat(F.lit("page"), F.col("page_number").cast("string"), stem, number.cast("string"), F.lit("." + fmt.lower()))
    rows = rows.withColumn("filename", name)
    large = (F.col("bbox.x2") - F.col("bbox.x1") >= min_size) & (F.col("bbox.y2") - F.col("bbox.y1") >= min_size)
    return rows.filter(large | (F.col("block_type") == "table")).withColumn("crop", padded(F.col("bbox"), F.lit(page_width), F.lit(page_height), padding))


def embedded_manifest(images: DataFrame, fmt: str = "png", min_size: int = 50) -> DataFrame:
    """File names of embedded pictures (page keys, nth, width, height) that are large enough."""
    name = F.concat(F.lit("page"), F.col("page_number").cast("string"), F.lit("_fig"), F.col("nth").cast("string"), F.lit("." + fmt.lower()))
    return images.filter((F.col("width") >= min_size) & (F.col("height") >= min_size)).withColumn("filename", name)


def listing(manifest: DataFrame) -> DataFrame:
    """A document's pictures by file name, as one array."""
    kinds = F.lower(F.substring_index("filename", ".", -1)).isin("png", "jpg", "jpeg")
    return manifest.filter(kinds).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("filename", "width", "height"))).alias("images"))


def described(pictures: DataFrame, make, **call) -> DataFrame:
    """alt_texts with the texts of pictures that need a model: its answer, stripped, or the page reference if it fails.

    pictures: the rows of alt_texts, with image (the page's picture) if there is one; call: what recognize() takes.
    """
    from foliate.operators.dispatch import prompt
    from foliate.operators.recognize import recognize

    asked = recognize(pictures.filter("needs_model").withColumn("prompt", prompt(F.lit("image"), F.col("bbox"))), make, **call)
    other = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(", Figure"))
    answered = asked.withColumn("alt_text", F.coalesce(F.nullif(strip(F.col("reply")), F.lit("")), other)).drop("prompt", "reply", "error", "attempts")
    return pictures.filter("not needs_model").unionByName(answered)


def alt_texts(blocks: DataFrame, page_area: float, near: int = 50, large: float = 0.1) -> DataFrame:
    """Pictures with alt_text and needs_model: "caption" if the page has a caption close above or below, a model's work
    if the picture is large, else a page reference."""
    pictures = blocks.filter("block_type = 'image'")
    captions = blocks.filter("block_type = 'caption'").select(*PAGE, F.col("bbox").alias("cap"))
    close = F.least(F.abs(F.col("cap.y1") - F.col("bbox.y2")), F.abs(F.col("bbox.y1") - F.col("cap.y2"))) < near
    captioned = pictures.join(captions, list(PAGE)).filter(close).select(*PAGE, "pos").distinct().withColumn("captioned", F.lit(True))
    made = pictures.join(captioned, [*PAGE, "pos"], "left").withColumn("captioned", F.coalesce("captioned", F.lit(False)))
    big = (F.lit(page_area) > 0) & (area(F.col("bbox")) / F.lit(float(page_area)) > large)
    text = F.when(F.col("captioned"), "caption").when(big, "").otherwise(F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(", Figure")))
    return made.withColumns({"alt_text": text, "needs_model": ~F.col("captioned") & big}).drop("captioned")
