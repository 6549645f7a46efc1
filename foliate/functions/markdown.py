"""Blocks and tables as Markdown, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.text import lstrip, rstrip, strip

SEPARATOR_LINE = r"^\|[\s\-|:]+\|$"


def cells_table(cells: Column) -> Column:
    """Rows of cells as a pipe table whose first row is the head; null cells are empty, no rows give no text."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    head = F.element_at(cells, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(row(head), rule), body), "\n")).otherwise(F.lit(""))


def table_columns(table: Column) -> Column:
    """Columns by the pipes of a table's first line."""
    first = F.substring_index(strip(table), "\n", 1)
    return F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1


def _lines(table: Column) -> Column:
    return F.filter(F.split(strip(table), "\n"), lambda x: strip(x) != "")


def concat_tables(one: Column, two: Column) -> Column:
    """The second table's rows below the first's, without its head if it has one and rows behind it."""
    lines = _lines(two)
    headed = (F.size(lines) > 2) & F.coalesce(F.get(lines, F.lit(1)).rlike(SEPARATOR_LINE), F.lit(False))
    data = F.when(headed, F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(lines)
    return F.when(F.size(lines) == 0, one).otherwise(F.array_join(F.concat(_lines(one), data), "\n"))


def merged_content(kind: Column, one: Column, two: Column) -> Column:
    """Content of a block that goes on over a page break: kind is table, paragraph or formula."""
    return (
        F.when(kind == "table", concat_tables(one, two))
        .when(kind == "paragraph", F.concat(rstrip(one), F.lit(" "), lstrip(two)))
        .otherwise(F.concat(rstrip(one), F.lit("\n"), lstrip(two)))
    )


def content_type(block_type: Column) -> Column:
    return F.when(block_type == "table", "markdown_table").when(block_type == "formula", "latex").otherwise("text")


def title_level(height: Column, least: Column, most: Column, strategy: str = "auto") -> Column:
    """Level 1 to 4 by a title's height among the document's titles; 2 if they are all alike or the strategy is flat."""
    if strategy == "flat":
        return F.lit(2)
    ratio = (height - least) / (most - least)
    return F.when(most == least, 2).when(ratio > 0.75, 1).when(ratio > 0.5, 2).when(ratio > 0.25, 3).otherwise(4)


def block_markdown(block_type: Column, content: Column, image_path: Column, level: Column) -> Column:
    """A block's Markdown; empty where it has neither content nor image."""
    text = strip(F.coalesce(content, F.lit("")))
    path = F.coalesce(image_path, F.lit(""))
    fenced = lambda fence: F.when(text.startswith(fence), text).otherwise(F.concat(F.lit(fence + "\n"), text, F.lit("\n" + fence)))
    return (
        F.when(text == "", F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("![](images/"), F.substring_index(path, "/", -1), F.lit(")"))))
        .when(block_type == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(block_type == "image", F.concat(F.lit("!["), text, F.lit("]("), path, F.lit(")")))
        .when(block_type == "formula", fenced("$$"))
        .when(block_type == "caption", F.concat(F.lit("*"), text, F.lit("*")))
        .when(block_type == "code", fenced("```"))
        .otherwise(text)
    )
