"""From raw documents to packed training sequences, in stages that each write a table.

A stage reads what its predecessor kept; all but the last return documents with their columns, the last one
returns where every piece of every document lies. A lost executor or a rerun costs one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from counterscope.llm.exact_dup import drop_exact_duplicates
from counterscope.llm.mixing import mixed
from counterscope.llm.near_dup import drop_near_duplicates
from counterscope.llm.packing import default_ranks, pack_documents
from counterscope.llm.quality import drop_low_quality
from counterscope.llm.shared import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line chain finds good; it learns from the labels table."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that differ in white space only."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicate texts."""
    return drop_near_duplicates(docs, percent=85)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the source weights; one taken twice is in two rows."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    return pack_documents(docs, capacity=1024, ranks=default_ranks())


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Neither the classifier nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
