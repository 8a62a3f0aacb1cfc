"""The training-data pipeline: quality filter, near-duplicate removal, source mixing, sequence packing.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Stages hand over through Parquet in the shared checkpoint folder.

Edge cases are those of the operators; a null doc_id survives quality, near-duplicates and mixing, and is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.cluster import ship_package
from tessella.llm import mixing, near_dups, packing, quality
from tessella.llm.common import settle


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id."""
    ship_package(spark)
    return near_dups.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    ship_package(spark)
    return packing.pack(docs, "word_bpe_49k.json", 1, 4096)


STAGES = [("quality_classifier", quality_filter), ("minhash_near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", sequence_packing)]

#: SQL can express neither the scores nor the samples nor the random rounding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
