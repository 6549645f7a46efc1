"""Reading documents and checking requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """path, name (the stem), md5 and content of files in a folder, flat or recursive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select("path", name.alias("name"), F.md5("content").alias("md5"), "length", "content")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Single pictures as scanned documents of one page."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.substring_index("path", ".", -1))
    return files.filter(kind.isin("png", "jpg", "jpeg", "tif", "tiff", "webp")).select("path", F.md5("content").alias("md5"), F.lit(1).alias("page_number"), F.lit("scanned").alias("page_type"), F.col("content").alias("image"))


def parse_files(files: DataFrame, parser: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Pages of files by a plug-in parser; a file that it fails on gives one row with its error, and no more."""
    out = f"path string, md5 string, {schema}, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in out.split(", ") if " " in part]
        for frame in frames:
            rows = []
            for path, md5, content in zip(frame["path"], frame["md5"], frame["content"], strict=True):
                try:
                    rows += [{"path": path, "md5": md5, "error": None} | page for page in parser(bytes(content))]
                except Exception as problem:  # noqa: BLE001
                    rows.append({"path": path, "md5": md5, "error": str(problem)})
            yield pd.DataFrame([[row.get(n) for n in names] for row in rows], columns=names, dtype=object)

    return files.select("path", "md5", "content").mapInPandas(run, out)


def page_text_parser(content: bytes) -> list[dict]:
    """A plain parser for UTF-8 text with form feeds between pages."""
    return [{"page_number": k + 1, "text": t} for k, t in enumerate(content.decode("utf-8").split("\f"))]


def check_requests(requests: DataFrame, max_mb: float = 100, max_pages: int = 200, sync_pages: int = 10) -> DataFrame:
    """requests (filename, size_mb, pages) with status_code and mode; whatever fails first decides, before any task exists."""
    code: Column = (
        F.when(F.col("filename").isNull() | ~F.lower("filename").endswith(".pdf"), 415).when(F.col("size_mb") > max_mb, 413).when(F.col("pages") > max_pages, 400).otherwise(200)
    )
    made = requests.withColumn("status_code", code)
    return made.withColumn("mode", F.when(F.col("status_code") != 200, "rejected").when(F.col("pages") <= sync_pages, "sync").otherwise("async"))
