"""The flagship plan: regions and native lines to Markdown, as one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from foliate.operators.assemble import MarkdownConfig, assemble
from foliate.operators.blocks import deduplicate
from foliate.operators.crosspage import merge_pages
from foliate.operators.layout import reading_order


def convert(blocks: DataFrame, heights: DataFrame | None = None, order: str = "column", config: MarkdownConfig = MarkdownConfig()) -> DataFrame:
    """doc_id and markdown from recognised blocks: deduplicated, ordered, merged over page breaks, assembled."""
    return assemble(merge_pages(reading_order(deduplicate(blocks), order), heights), config)
