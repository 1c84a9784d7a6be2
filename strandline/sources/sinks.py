"""Idempotent Parquet sinks and stored projections.

A table keyed by id is a Parquet folder.  Appends only add unseen keys; replacements and
updates rewrite just the hash buckets they touch, by dynamic partition overwrite.  Every
write is one Spark job, so a lost executor only repeats its tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas, vocab
from strandline.functions import rules
from strandline.operators import graph
from strandline.operators.dedupe import first_per_key
from strandline.operators.skew import HOT_ROWS
from strandline.sources.keyindex import KeyIndex, key_hash
from strandline.runtime import cut_lineage, drop_path, path_exists

BUCKET = "_bucket"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before the first write."""
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str], order: list[Column], partition_by: list[str] | None = None,
               layout: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Insert rows whose key is not stored yet; the first write of a key wins, also inside a batch.

    The stored keys are looked up through the index beside the table (``<path>_keys``), so a batch reads what may
    hold its keys and not all of them.  A key with nulls is a key like any other.  ``layout`` orders the rows for writing.
    """
    index = KeyIndex(df.sparkSession, f"{path.rstrip('/')}_keys", path, keys)
    index.catch_up()
    rows = first_per_key(df, keys, order)
    if read_table(df.sparkSession, path) is not None:
        a, b = key_hash(keys)
        known = index.stored(df.select(*keys)).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        rows = rows.withColumns({"_a": a, "_b": b}).join(known, ["_a", "_b"], "left_anti").drop("_a", "_b")
    writer = (rows if layout is None else layout(rows)).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_versions(df: DataFrame, path: str, order: list[Column]) -> None:
    """One row per (source_id, content_hash); rows without a content hash are not stored."""
    append_new(df.where(F.coalesce("content_hash", F.lit("")) != ""), path, ["source_id", "content_hash"], order)


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _bucketed(df: DataFrame, key: str | list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*_columns(key)), F.lit(buckets)).cast("int"))


def _overwrite_buckets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _by_content(df: DataFrame) -> list[Column]:
    """An order of rows that does not depend on their place: the hash of all columns."""
    return [F.xxhash64(*df.columns)]


def replace_by_key(df: DataFrame, path: str, key: str | list[str], buckets: int = 64, order: list[Column] | None = None) -> None:
    """Insert or replace rows by key, a column or several.  Of rows of one batch with the same key the first by ``order`` is stored.  The
    merged buckets are materialised before they are overwritten."""
    keys = _columns(key)
    new = _bucketed(first_per_key(df, keys, order or _by_content(df)), keys, buckets)
    stored = read_table(df.sparkSession, path)
    if stored is None:
        _overwrite_buckets(new, path)
        return
    touched = F.broadcast(new.select(BUCKET).distinct())
    old = stored.join(touched, BUCKET, "left_semi").join(new.select(*keys), keys, "left_anti")
    merged = old.unionByName(new, allowMissingColumns=True)
    _overwrite_buckets(cut_lineage(merged, "replace"), path)


def update_by_key(df: DataFrame, path: str, key: str | list[str], columns: list[str], buckets: int = 64, order: list[Column] | None = None) -> None:
    """Update ``columns`` of stored rows from ``df``; null values keep the old ones.  Of rows of one batch with the
    same key the first by ``order`` counts."""
    stored = read_table(df.sparkSession, path)
    if stored is None:
        return
    keys = _columns(key)
    new = _bucketed(first_per_key(df, keys, order or _by_content(df)), keys, buckets).select(*keys, BUCKET, *[F.col(c).alias(f"_new_{c}") for c in columns])
    touched = F.broadcast(new.select(BUCKET).distinct())
    joined = stored.join(touched, BUCKET, "left_semi").join(new.drop(BUCKET), keys, "left")
    merged = joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*stored.columns)
    _overwrite_buckets(cut_lineage(merged, "update"), path)


def append_links(links: DataFrame, path: str, buckets: int = 64, *, hot_rows: int = HOT_ROWS) -> int:
    """Merge new links (a, b) into the stored components (node, component) at ``path``; returns the number of buckets rewritten.

    Rows are filed by their component, so only the buckets of components that change are rewritten.  A bucket that
    loses all its rows is deleted last; until then a node may have two rows, which a repeated batch joins again.
    """
    spark = links.sparkSession
    stored = read_table(spark, path)
    nodes = links.schema["a"].dataType
    if stored is None:
        stored = spark.createDataFrame([], "node string, component string").select(*[F.col(c).cast(nodes).alias(c) for c in ("node", "component")])
    changes = cut_lineage(graph.changed_components(stored, links, hot_rows=hot_rows), "links-changes")
    ends = changes.select(F.col("old").alias("c")).unionByName(changes.select(F.col("component").alias("c"))).where("c is not null")
    touched = {r[0] for r in _bucketed(ends, "c", buckets).select(BUCKET).distinct().collect()}  # at most ``buckets``
    if not touched:
        return 0
    rows = _bucketed(changes.select("node", "component"), "component", buckets)
    if BUCKET in stored.columns:
        kept = stored.where(F.col(BUCKET).isin(sorted(touched))).select("node", "component")
        gone = changes.where("old is not null").select("node", F.col("old").alias("component")).distinct()
        rows = rows.unionByName(_bucketed(kept.join(gone, ["node", "component"], "left_anti"), "component", buckets))
    merged = cut_lineage(rows.distinct(), "links-merged")
    _overwrite_buckets(merged, path)
    for bucket in sorted(touched - {r[0] for r in merged.select(BUCKET).distinct().collect()}):
        drop_path(spark, f"{path}/{BUCKET}={bucket}")
    return len(touched)


def enrichment_update(df: DataFrame, path: str, columns: list[str], buckets: int = 64, key: str | list[str] = "id") -> None:
    """Write back rows stamped with the current taxonomy version."""
    update_by_key(df.where(F.col("taxonomy_version") == vocab.TAXONOMY_VERSION), path, key, columns, buckets)


def create_keyed(df: DataFrame, path: str, key: str | list[str], buckets: int = 64) -> None:
    _overwrite_buckets(_bucketed(df, key, buckets), path)


def json_archive(df: DataFrame, root: str, date_key: str, run_id: str) -> None:
    """Write one run's archive, never over an existing run, and refresh ``latest``."""
    df.write.mode("errorifexists").json(f"{root}/{date_key}/{run_id}")
    df.write.mode("overwrite").json(f"{root}/{date_key}/latest")


def log_run(spark: SparkSession, path: str, rows: list[dict] | DataFrame) -> None:
    """Append states of runs to the log; columns that ``rows`` lacks are null."""
    log = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schemas.RUN_LOG)
    shape = spark.createDataFrame([], schemas.RUN_LOG).schema
    log.select(*[(F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]) \
        .write.mode("append").parquet(path)


def latest_runs(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest state per run, newest runs first; all, or a page of ``limit``."""
    state = F.struct("status", "source_count", "rejected_count", "discarded_count", "error_message")
    runs = log.groupBy("run_id").agg(F.min("logged_at").alias("started_at"), F.max("logged_at").alias("last_at"),
                                     F.max_by(state, "logged_at").alias("s"))
    out = runs.select("run_id", "started_at", "last_at", "s.*").orderBy(F.desc("started_at"), "run_id")
    return out if limit is None else out.limit(limit)


# Storage projection: column -> (type, default).  None keeps null.
SOURCE_ROW = {
    "id": ("string", None), "snapshot_id": ("string", None), "title": ("string", None), "url": ("string", None),
    "original_url": ("string", "@url"), "canonical_url": ("string", "@url"), "final_url": ("string", "@url"),
    "publisher": ("string", None), "author": ("string", ""), "date_published": ("timestamp_ntz", None),
    "date_published_actual": ("timestamp_ntz", "@date_published"), "date_discovered": ("timestamp_ntz", None),
    "date_confidence": ("string", "exact"), "source_type": ("string", None), "trust_tier": ("string", "unknown"),
    "is_curated": ("boolean", False), "curated_metadata": ("map<string,string>", None), "full_text": ("string", ""),
    "summary": ("string", ""), "raw_text": ("string", "@full_text"), "clean_text": ("string", "@full_text"),
    "raw_html": ("string", ""), "extracted_code_blocks": ("array<struct<language:string,content:string>>", []),
    "extracted_iocs": ("struct<cves:array<string>,ips:array<string>,urls:array<string>,hashes:struct<sha256:array<string>,md5:array<string>>>", None),
    "cleaning_version": ("string", None), "content_hash": ("string", None), "clean_text_hash": ("string", None),
    "tags": ("array<string>", []), "url_safety_status": ("string", "unknown"), "validation_flags": ("array<string>", []),
    "validity_status": ("string", "invalid"), "ai_relevance_score": ("int", None), "ai_specificity_score": ("int", None),
    "relevance_tier": ("string", None), "eligible_for_daily_report": ("boolean", False), "eligible_for_weekly_report": ("boolean", False),
    "eligible_for_monthly_report": ("boolean", False), "eligible_for_horizon_scan": ("boolean", False), "eligible_for_archive": ("boolean", True),
    "eligible_for_trend_analysis": ("boolean", False), "eligible_for_reference_context": ("boolean", False), "needs_review": ("boolean", False),
    "archive_version": ("string", vocab.ARCHIVE_VERSION),
}


def build_source_row(df: DataFrame, snapshot_id: Column) -> DataFrame:
    """The 43-column storage projection with defaults for whatever the input lacks."""
    have = {**{c: F.col(c) for c in df.columns}, "snapshot_id": snapshot_id,
            "validity_status": F.when(F.col("is_valid"), F.lit("valid")) if "is_valid" in df.columns else F.lit(None).cast("string")}
    cols = []
    for name, (typ, default) in SOURCE_ROW.items():
        c = have.get(name, F.lit(None)).cast(typ)
        if default == []:
            c = F.coalesce(c, F.array().cast(typ))
        elif isinstance(default, str) and default.startswith("@"):
            c = F.coalesce(F.nullif(c, F.lit("")) if typ == "string" else c, have[default[1:]])
        elif default is not None:
            c = F.coalesce(F.nullif(c, F.lit("")) if typ == "string" else c, F.lit(default))
        cols.append(c.alias(name))
    return df.select(*cols)


def build_snapshot_record(row: DataFrame, captured_at: Column) -> DataFrame:
    return row.select(F.col("id").alias("source_id"), "snapshot_id", captured_at.alias("captured_at"), "content_hash", "clean_text_hash",
                      "raw_text", "clean_text", "raw_html", "cleaning_version", "extracted_code_blocks", "extracted_iocs")


def build_archive_record(row: DataFrame, validity: dict[str, Column], accessed: Column) -> DataFrame:
    """Nested archive document as one JSON column per record."""
    v = {"credibility_label": F.lit("unknown"), "structural_validity_score": F.lit(0), "publisher_trust_score": F.lit(0), **validity}
    doc = F.struct(
        F.col("id").alias("source_id"), "original_url", "canonical_url", "final_url",
        F.struct("title", "publisher", "author", F.col("canonical_url").alias("url"), "date_published", accessed.alias("date_accessed")).alias("citation"),
        F.struct("source_type", "trust_tier", "is_curated", "date_confidence", "date_discovered").alias("provenance"),
        F.struct(*[c.alias(n) for n, c in v.items()], "url_safety_status").alias("validity"),
        F.struct("source_type", v["credibility_label"].alias("credibility_label"), F.col("tags").alias("initial_tags")).alias("tags"),
        F.struct(F.sha2("canonical_url", 256).alias("url_hash"), F.coalesce("content_hash", F.sha2("full_text", 256)).alias("content_hash"),
                 "clean_text_hash", "cleaning_version").alias("integrity"),
        F.struct("raw_text", "clean_text", "raw_html", "summary", "extracted_code_blocks", "extracted_iocs").alias("content"))
    return row.select("id", F.to_json(doc).alias("record"))
