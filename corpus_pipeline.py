"""A corpus pipeline of five stages: documents in, token digests out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import stages
from strandline.llm.common import scratch_path, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stages.quality_stage),
    ("line_dedup", stages.line_stage),
    ("near_dedup", stages.near_stage),
    ("decontaminate", stages.decontaminate_stage),
    ("bpe", stages.bpe_stage),
]

# The classifier, SimHash and BPE stages have no SQL form; tests/llm/test_llm_pipeline.py holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
