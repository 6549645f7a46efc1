"""Pages that arrive as files: classified as they come, with bounded batches for back-pressure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliate.operators.classify import DetectionConfig, classify
from foliate.schema import PAGES


def read_pages(spark: SparkSession, folder: str, files_at_once: int = 3) -> DataFrame:
    """A stream of page rows from Parquet files."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def classify_arrivals(spark: SparkSession, folder: str, out: str, checkpoints: str, config: DetectionConfig = DetectionConfig(), then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Classifies all files that are there and appends the result to `out`; `then` is called with each batch.

    Restarts go on where the checkpoint ends; each file's rows are written once.
    """
    made = classify(read_pages(spark, folder), config).drop("spans")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(batch, number)

    return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
