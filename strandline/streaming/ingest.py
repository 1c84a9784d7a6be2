"""Structured Streaming ingestion: stateless transforms, keyed upserts, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions import times
from strandline.sources import sinks

DAY_OFFSET = f"{24 - (times.LOCAL_HOURS - times.DAY_START)} hours"


def file_stream(spark: SparkSession, path: str, schema, *, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP; NTZ columns are read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def drain(df: DataFrame, checkpoint: str, batch=None, *, mode: str = "append", out: str | None = None) -> StreamingQuery:
    """Process everything available and stop.  Either ``batch(df, id)`` or a Parquet folder ``out``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return q


def upsert_batch(table: str, keys: list[str], order: list[Column]):
    """First write wins by key.  A repeated batch adds nothing, so restarts are safe."""
    def write(df: DataFrame, batch_id: int) -> None:
        sinks.append_new(df, table, keys, order)
    return write


def keep_latest_batch(table: str):
    """Store every batch of an update-mode aggregate in its own folder; a repeated batch replaces itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_seq", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
    return write


def latest(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Current state of an update-mode table: the newest batch's row per key."""
    rows = spark.read.parquet(table).drop("batch_id")
    values = [c for c in rows.columns if c not in [*keys, "batch_seq"]]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_seq").alias(c) for c in values])


def dedupe(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark([key])


def window_counts(df: DataFrame, ts: str, by: list[str], *, delay: str, days: int = 1) -> DataFrame:
    """Counts per reporting day, or per ``days``-day period ending each day."""
    w = F.window(ts, f"{days} days", "1 day", DAY_OFFSET)
    return (event_time(df, ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"))
            .select(F.col("w.start").alias("start_utc"), F.col("w.end").alias("end_utc"), *by, "events"))


def late_report_batch(kept: str, late: str, ts: str, start: Column, end: Column):
    """Rows inside the reporting window go to ``kept``, the others with a reason to ``late``."""
    def write(df: DataFrame, batch_id: int) -> None:
        t = F.col(ts)
        reason = (F.when(t.isNull(), F.lit("Missing valid published date"))
                  .when(~times.in_window(t, start, end), F.lit("Published date outside reporting window")))
        rows = df.withColumn("reason", reason)
        for path, part in ((kept, rows.where("reason is null").drop("reason")), (late, rows.where("reason is not null"))):
            part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def counted_batch(metrics: str, batch):
    """``batch`` with a row (batch_id, input_rows) written to the folder ``metrics`` for every micro-batch; a repeated
    batch replaces its own row, and no number of batches is too large.

    The rows are counted as they pass through ``batch``'s first action, so ``batch`` must act on what it is given.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch {batch_id}")
        batch(df.observe(seen, F.count("*").alias("input_rows")), batch_id)
        row = df.sparkSession.createDataFrame([(int(seen.get["input_rows"]),)], "input_rows bigint")
        row.write.mode("overwrite").parquet(f"{metrics}/batch_id={batch_id}")
    return write


def append_batch(out: str):
    """Store every batch in its own folder under ``out``; a repeated batch replaces itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def run_metrics(spark: SparkSession, metrics: str) -> DataFrame:
    """One row per micro-batch from the folder that ``counted_batch`` wrote."""
    return spark.read.schema("input_rows bigint, batch_id bigint").parquet(metrics).select("batch_id", "input_rows")
