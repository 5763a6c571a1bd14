"""The corpus pipeline: quality classifier, near-dedup, benchmark
decontamination, mixing of sources, token output.

Each stage takes the documents that its predecessor kept; ``run`` writes them
to the shared folder between the stages, so a lost executor costs one stage's
work at most.  The last stage returns one row per document of the mix from the
token files (doc_id, start, n_tokens, ids_crc32).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrubline.llm import decontamination, mixing, near_dedup, quality, token_output
from scrubline.llm._common import compact, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on ``labels``) keeps."""
    return compact(quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component."""
    return compact(near_dedup.distinct_documents(docs), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any ``benchmark`` item."""
    return compact(decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return compact(mixing.mixed_documents(docs), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    return token_output.token_table(docs.select("doc_id", "text"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("tokens", token_stage)]

#: The classifier, the components and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
