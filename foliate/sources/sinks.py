"""Writing results."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Directories that a large result is dealt over.
SHARDS = 64


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))


def write_markdown(docs: DataFrame, folder: str, name: str = "markdown") -> None:
    """doc_id and Markdown as a table, dealt over SHARDS directories by the hash of doc_id: for any number of documents."""
    sharded(docs.select("doc_id", F.col(name).alias("markdown"))).write.mode("overwrite").partitionBy("shard").parquet(folder)


def put(folder: str, name: str, data: bytes) -> None:
    """Writes folder/name whole or not at all, so that a task may run twice."""
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), folder.removeprefix("file://")) if folder.startswith(("/", "file://")) else fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")


def write_files(docs: DataFrame, folder: str, name: str = "markdown") -> int:
    """folder/<doc_id>/document.md for each document, in a folder that all executors reach; for few documents. Returns how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["markdown"], strict=True):
                put(f"{folder}/{doc_id}", "document.md", (text or "").encode())
            yield frame[["doc_id"]]

    return docs.select("doc_id", F.col(name).alias("markdown")).mapInPandas(run, "doc_id long").count()


def zipped(results: DataFrame) -> DataFrame:
    """doc_id and archive (a ZIP file: document.md, metadata.json, images/<name>) of results (doc_id, markdown, metadata,
    images: array of struct filename, content). Equal results give equal archives."""

    def archive(markdown: str | None, metadata: str | None, images) -> bytes:
        files = [("document.md", (markdown or "").encode()), ("metadata.json", (metadata or "{}").encode())]
        files += [(f"images/{i['filename']}", bytes(i["content"] or b"")) for i in (images if images is not None else [])]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
            for name, data in files:
                packed.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [archive(*row) for row in zip(frame["markdown"], frame["metadata"], frame["images"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "archive": made})

    return results.select("doc_id", "markdown", "metadata", "images").mapInPandas(run, "doc_id long, archive binary")


def metadata_json(*columns: str) -> Column:
    """The named columns as one JSON object, empty ones included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_metadata(docs: DataFrame, folder: str, *columns: str) -> None:
    sharded(docs.select("doc_id", metadata_json(*columns).alias("metadata"))).write.mode("overwrite").partitionBy("shard").parquet(folder)


def write_entries(entries: DataFrame, folder: str) -> None:
    """Cache entries, appended, by tier."""
    entries.write.mode("append").partitionBy("tier").parquet(folder)


def image_results(images: Column, task_id: Column) -> Column:
    """Pictures (array of struct filename, width, height) with the address that serves them."""
    address = lambda i: F.concat(F.lit("/api/v1/files/"), task_id, F.lit("/images/"), i["filename"])
    return F.transform(images, lambda i: F.struct(i["filename"].alias("filename"), address(i).alias("url"), F.coalesce(i["width"], F.lit(0)).alias("width"), F.coalesce(i["height"], F.lit(0)).alias("height")))
