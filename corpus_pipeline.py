"""Corpus pipeline: the stages of the training-data operators, in order.

Each stage works on all rows its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histspark.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from histspark.llm.common import drop, stored, tables_of

#: Shingle words and similarity (as a fraction) of the near-duplicate stage.
SHINGLE, NUM, DEN = 5, 80, 100


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents it predicts as 0 go. A null doc_id is scored and judged by its text too."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the row with the smallest doc_id stays."""
    return jaccard_join.representatives(docs, SHINGLE, NUM, DEN)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again. When it is there, the
    stage before it and the tables the stage worked with are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tables_of(spark) as tables:
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = stored(docs, f"stage-{i}")
                drop(spark, tables[:-1])
                del tables[:-1]
    return docs
