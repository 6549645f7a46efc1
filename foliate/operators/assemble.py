"""Documents as Markdown: one ordered aggregation for each document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.markdown import block_markdown, title_level
from foliate.functions.text import rstrip
from foliate.schema import MARGINAL


@dataclass(frozen=True)
class MarkdownConfig:
    page_separator: str = "\n\n---\n\n"
    include_page_markers: bool = True
    include_source_markers: bool = True
    title_level_strategy: str = "auto"
    discard_header_footer: bool = True


def title_levels(blocks: DataFrame, strategy: str = "auto") -> DataFrame:
    """Titles of blocks with their level among the document's titles."""
    titles = blocks.filter("block_type = 'title'")
    height = F.col("bbox.y2") - F.col("bbox.y1")
    spans = titles.groupBy("doc_id").agg(F.min(height).alias("least_"), F.max(height).alias("most_"))
    return titles.join(spans, "doc_id").withColumn("level", title_level(height, F.col("least_"), F.col("most_"), strategy)).drop("least_", "most_")


def page_before(body: str, i: Column) -> Column:
    """The page of the block before the one at i in an array of blocks; 0 before the first."""
    return F.when(i > 0, F.get(body, i - 1)["page_number"]).otherwise(F.lit(0))


def joined_references(refs: str, between: str) -> Column:
    """The contents of an ordered array of reference blocks as one text."""
    return F.array_join(F.transform(refs, lambda r: r["content"]), between)


def assemble(blocks: DataFrame, config: MarkdownConfig = MarkdownConfig()) -> DataFrame:
    """doc_id and markdown of each document of blocks (doc_id, page_number, reading_order, seq, block_type, bbox, content,
    image_path): by page and order, ties by seq; page and source markers; references at the end.

    Heights, order and text meet in a single aggregation, so blocks move once.
    """
    height = F.col("bbox.y2") - F.col("bbox.y1")
    is_title = F.col("block_type") == "title"
    item = F.struct("page_number", "reading_order", "seq", "block_type", F.coalesce("content", F.lit("")).alias("content"), "image_path", height.alias("height"))
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("b"), F.min(F.when(is_title, height)).alias("least"), F.max(F.when(is_title, height)).alias("most"))
    body = F.filter("b", lambda x: (x["block_type"] != "reference") & (~x["block_type"].isin(*MARGINAL) if config.discard_header_footer else F.lit(True)))
    docs = docs.withColumns({"body": body, "refs": F.filter("b", lambda x: x["block_type"] == "reference")})

    def piece(x, i):
        before = page_before("body", i)
        turned = x["page_number"] != before
        marker = F.concat(F.lit("<!-- Page "), x["page_number"].cast("string"), F.lit(" -->\n\n")) if config.include_page_markers else F.lit("")
        page = F.when(turned, F.concat(F.when(before > 0, F.lit(config.page_separator)).otherwise(F.lit("")), marker)).otherwise(F.lit(""))
        source = F.concat(F.lit("<!-- Source: page "), x["page_number"].cast("string"), F.lit(", block "), x["reading_order"].cast("string"), F.lit(" -->\n")) if config.include_source_markers else F.lit("")
        md = block_markdown(x["block_type"], x["content"], x["image_path"], title_level(x["height"], F.col("least"), F.col("most"), config.title_level_strategy))
        return F.concat(page, F.when(md == "", F.lit("")).otherwise(F.concat(source, md, F.lit("\n\n"))))

    text = F.array_join(F.transform("body", piece), "")
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("\n\n## References\n\n"), joined_references("refs", "\n\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(rstrip(F.concat(text, refs)), F.lit("\n")).alias("markdown"))
