"""From raw documents to packed token sequences, in five stages.

Each stage takes all that the one before has kept, from a Parquet table on shared storage, and its decisions
take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import mixing, packing, quality, shingles, spans
from strandloom.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by a Jaccard similarity of five-word shingles of 0.8 or more, one document stays."""
    return shingles.representatives(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that stand in an earlier document's span go; the documents stay."""
    return spans.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, the last time perhaps in part."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids stands in sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("mixture", mixture),
    ("packing", packed),
]

#: Neither fingerprints, nor token ids, nor the divergence's medians can be had from SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
