"""The corpus pipeline: quality rules, toxicity, near duplicates, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.jaccard import near_filter
from foliate.llm.packing import pack
from foliate.llm.quality import quality_filter
from foliate.llm.queries import byte_bpe
from foliate.llm.shared import new_folder, remainder
from foliate.llm.toxicity import toxicity_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with thresholds for each language and source; null texts fail them."""
    return quality_filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; labels of held-out documents are not learnt from. Without labels all stay."""
    return toxicity_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of least doc_id, null last."""
    return near_filter(docs, words=5, num=80, den=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 2048 tokens; only longer documents are cut."""
    return pack(docs, byte_bpe())


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Tokenizer, classifier and packing plan have no SQL; tests/llm compares run() with a brute-force version, document by document.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each one's result written as Parquet to the shared folder and read again by the next.

    Texts of any length go through whole, repeated rows are documents of their own up to the near duplicates, which keep one
    of them, columns may have any names, and an empty table gives an empty result. The stages' files stay in the shared folder,
    since the last stage's result is read from them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
