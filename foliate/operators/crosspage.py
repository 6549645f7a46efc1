"""Elements that go on over a page break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.markdown import merged_content, table_columns
from foliate.functions.text import rstrip

#: The last character of a paragraph that ends. Fixed values.
TERMINATORS = ".。!！?？"


def candidates(blocks: DataFrame, heights: DataFrame | None = None, bottom: float = 0.90, top: float = 0.10, default_height: int = 3000) -> DataFrame:
    """Pairs of blocks of one type: low on a page, and high on the next one, by the first page's height.

    blocks: doc_id, page_number, pos, block_type, bbox, content, ...; heights: doc_id, page_number, height. An equi-join
    on document, page and type; the positions are filtered on each side before it.
    """
    if heights is None:
        low, high = (blocks.withColumn("h_", F.lit(float(default_height))) for _ in range(2))
    else:
        known = heights.select("doc_id", F.col("page_number").alias("page_number"), F.col("height").cast("double").alias("h_"))
        low = blocks.join(known, ["doc_id", "page_number"], "left").fillna(float(default_height), ["h_"])
        before = known.withColumn("page_number", F.col("page_number") + 1)  # a top block is judged by the page before it
        high = blocks.join(before, ["doc_id", "page_number"], "left").fillna(float(default_height), ["h_"])
    one = low.filter(F.col("bbox.y2") > F.col("h_") * bottom).select("doc_id", "block_type", F.col("page_number").alias("page1"), F.col("pos").alias("pos1"), F.col("content").alias("content1"))
    two = high.filter(F.col("bbox.y1") < F.col("h_") * top).select("doc_id", "block_type", (F.col("page_number") - 1).alias("page1"), F.col("pos").alias("pos2"), F.col("content").alias("content2"))
    return one.join(two, ["doc_id", "block_type", "page1"])


def classified(pairs: DataFrame) -> DataFrame:
    """Candidates that merge, with merge_type: tables of as many columns, texts that don't end, all formulas."""
    last = F.right(rstrip(F.col("content1")), F.lit(1))
    open_ended = (last != "") & ~F.contains(F.lit(TERMINATORS), last)
    kind = (
        F.when((F.col("block_type") == "table") & (table_columns(F.col("content1")) == table_columns(F.col("content2"))), "table")
        .when((F.col("block_type") == "text") & open_ended, "paragraph")
        .when(F.col("block_type") == "formula", "formula")
    )
    return pairs.withColumn("merge_type", kind).filter("merge_type is not null")


def merge_pages(blocks: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """blocks with each pair that merges as one block in the first one's place; several pairs of a block give several.

    `seq` orders what stands on equal page and reading order: merged blocks first, then the others as they were.
    """
    pairs = classified(candidates(blocks, heights))
    merged = pairs.select("doc_id", F.col("pos1").alias("pos"), "pos2", merged_content(F.col("merge_type"), F.col("content1"), F.col("content2")).alias("new_"))
    rest = ("image_path", "confidence", "validation_passed", "validation_warning")
    lost = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in rest if c in blocks.columns}
    first = blocks.join(merged, ["doc_id", "pos"]).withColumns({"content": F.col("new_"), "seq": F.struct(F.lit(0).alias("o"), F.col("pos").cast("long").alias("a"), F.col("pos2").cast("long").alias("b")), **lost}).drop("new_", "pos2")
    used = pairs.select("doc_id", F.explode(F.array("pos1", "pos2")).alias("pos"))
    others = blocks.join(used, ["doc_id", "pos"], "left_anti").withColumn("seq", F.struct(F.lit(1).alias("o"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return first.unionByName(others)
