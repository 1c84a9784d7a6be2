"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the rows it keeps.

All but the last return the columns of ``docs``; nulls, repeated rows and extra columns are handled as the
operators say.  Only the classifier's labels and the benchmark are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontam, linededup, neardup, quality
from strandline.llm.common import table
from strandline.llm.queries import tokenizer_paths

# Texts whose fingerprints differ in so few bits are candidates beside those that share a band of shingle hashes.
NEAR_BITS = 6


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it is trained on labelled documents of the table itself."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of boilerplate lines; n_chars, where there is one, follows the text."""
    out = linededup.remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, verified similarity of 0.8 or more), the one with
    the smallest id.  Documents that the line stage emptied are equal, so one of them stays."""
    return neardup.keep_one(docs, bits=NEAR_BITS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(docs, **tokenizer_paths(), digests=True)
