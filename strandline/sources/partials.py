"""Stored partial counts: each batch adds its own, and a report sums them without reading the corpus again.

A partial is a count for each (metric, key) of one batch, in the batch's own folder, so a batch that comes again replaces
what it wrote and counts once.  Counts add up in any order.  ``compact`` turns many batches into one.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import cut_lineage
from strandline.sources.sinks import read_table

SCHEMA = "metric string, key string, n long, seen array<string>, batch string"


def counts(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, key, n) of one pass: ``metrics`` are columns of one key or of an array of keys for each row; null keys are not counted."""
    def keys(name: str, c: Column) -> Column:
        kind = df.select(c.alias("c")).schema["c"].dataType.typeName()
        each = c.cast("array<string>") if kind == "array" else F.array(c.cast("string"))
        return F.transform(F.coalesce(each, F.array().cast("array<string>")), lambda k: F.struct(F.lit(name).alias("metric"), k.alias("key")))
    long = df.select(F.inline(F.concat(*[keys(name, c) for name, c in metrics.items()])))
    return long.where(F.col("key").isNotNull()).groupBy("metric", "key").agg(F.count("*").alias("n"))


def store(partial: DataFrame, path: str, batch: str) -> None:
    """Write the counts (metric, key, n) of ``batch``; a repeated batch replaces itself, a compacted one changes nothing."""
    done = read_table(partial.sparkSession, path)
    if done is not None and not done.where(F.array_contains("seen", batch)).isEmpty():
        return
    out = partial.select("metric", "key", F.col("n").cast("long").alias("n"), F.lit(None).cast("array<string>").alias("seen"), F.lit(batch).alias("batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(metric, key, n) over all stored batches."""
    rows = read_table(spark, path)
    if rows is None:
        return spark.createDataFrame([], "metric string, key string, n long")
    return rows.where(F.col("metric").isNotNull()).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """All batches as one, written to the new folder ``target``; it knows which batches it holds, so they cannot be added again."""
    names = read_table(spark, path).select(F.explode(F.coalesce("seen", F.array("batch"))).alias("b")).distinct()
    seen = names.agg(F.array_sort(F.collect_set("b")).alias("seen"))  # the batches' names
    sums = cut_lineage(merged(spark, path), "partials").select("metric", "key", "n", F.lit(None).cast("array<string>").alias("seen"))
    mark = seen.select(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("n"), "seen")
    sums.unionByName(mark).withColumn("batch", F.lit("compacted")).write.partitionBy("batch").parquet(target)


def monthly(counts_: DataFrame, metric: str = "month") -> DataFrame:
    """(month, n) in order, from merged counts."""
    return counts_.where(F.col("metric") == metric).select(F.col("key").alias("month"), "n")


def deltas(counts_: DataFrame, before: str, after: str) -> DataFrame:
    """(key, before, after, delta) of two metrics over the same keys; a key that one of them lacks counts zero there."""
    both = counts_.where(F.col("metric").isin(before, after)).groupBy("key").agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).cast("long").alias(name) for m, name in ((before, "before"), (after, "after"))])
    return both.withColumn("delta", F.col("after") - F.col("before"))
