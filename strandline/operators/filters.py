"""Stored queries, splits and funnel counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules, times
from strandline.operators.skew import hot_join


def newest(df: DataFrame, tie: str = "id") -> DataFrame:
    """Newest first with undated rows in front, then by id."""
    return df.orderBy(F.desc_nulls_first("date_published"), F.asc(tie))


def list_sources(df: DataFrame, *, start: Column | None = None, end: Column | None = None,
                 publisher: str | None = None, source_type: str | None = None,
                 trust_tier: str | None = None, tag: str | None = None,
                 test_set: bool = False, limit: int | None = None) -> DataFrame:
    """All filters are optional and combine with AND; ``limit`` is a page size, without it all rows come."""
    conds = []
    if test_set:
        conds.append(F.col("in_test_set"))
    if start is not None:
        conds.append(F.col("date_published") >= start)
    if end is not None:
        conds.append(F.col("date_published") < end)
    if publisher:
        conds.append(F.col("publisher").ilike(f"%{publisher}%"))
    if source_type:
        conds.append(F.col("source_type") == source_type)
    if trust_tier:
        conds.append(F.col("trust_tier") == trust_tier)
    if tag:
        conds.append(F.array_contains("tags", tag))
    out = newest(reduce(DataFrame.where, conds, df))
    return out if limit is None else out.limit(limit)


def period_query(df: DataFrame, as_of: Column, period: str = "daily", limit: int | None = None) -> DataFrame:
    w = times.period_window(as_of, period)
    return list_sources(df, start=w["start_utc"], end=w["end_utc"], limit=limit)


def horizon_load(df: DataFrame, start: Column, end: Column, *, source_type: str | None = None,
                 trust_tier: str | None = None, categories: list[str] | None = None,
                 limit: int | None = None) -> DataFrame:
    rows = df.where("eligible_for_horizon_scan")
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    return list_sources(rows, start=start, end=end, source_type=source_type, trust_tier=trust_tier, limit=limit)


def known_identifiers(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Distinct stored ids and content hashes as (kind, value)."""
    rows = df if since is None else df.where(F.col("date_published") >= since)
    pairs = F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("value")),
                    F.struct(F.lit("content_hash").alias("kind"), F.col("content_hash").alias("value")))
    return rows.select(F.inline(pairs)).where(F.coalesce("value", F.lit("")) != "").distinct()


def lookup_by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def list_snapshots(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Snapshots whose [start_utc, end_utc] overlaps whole days start..end."""
    if start is not None:
        df = df.where(F.col("end_utc") >= start)
    if end is not None:
        df = df.where(F.col("start_utc") < F.date_add(end, 1).cast("timestamp_ntz"))
    return df.orderBy(F.desc("end_utc"))


def snapshot_members(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    return newest(hot_join(rows, snapshots, ["snapshot_id"]))


def list_reports(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Newest first; all, or a page of ``limit``."""
    out = df.orderBy(F.desc("generated_at"), F.asc("deck_id")).select(*columns)
    return out if limit is None else out.limit(limit)


def search(df: DataFrame, text: str = "", *, category: str | None = None, tag: str | None = None,
           priority: str | None = None, sort: str = "date") -> DataFrame:
    """Category, tag and priority filters, then a substring of title, publisher or any tag."""
    if category:
        df = df.where(F.coalesce("category", F.lit(vocab.UNCATEGORISED)) == category)
    if tag:
        df = df.where(F.array_contains("tags", tag))
    if priority:
        df = df.where(F.col("priority_label") == priority)
    q = text.strip().lower()
    if q:
        hit = reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in ("title", "publisher")])
        df = df.where(hit | F.exists("tags", lambda t: F.lower(t).contains(q)))
    return df.orderBy(*sort_keys(sort))


def sort_keys(mode: str) -> list[Column]:
    date = [F.desc_nulls_last("date_published"), F.asc("position")]
    return date if mode == "date" else [F.coalesce("priority_score", F.lit(0)).desc(), *date]


def group_by_category(df: DataFrame, order: list[str], mode: str = "priority") -> DataFrame:
    """Rows by category bucket in ``order``; unknown categories go to ``uncategorised`` and an
    empty bucket keeps one all-null row.  The order inside a bucket is a global sort, so no
    bucket is held by one task."""
    spark = df.sparkSession
    names = list(dict.fromkeys(order + [vocab.UNCATEGORISED]))
    spine = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "bucket string, bucket_no int")
    known = F.when(F.col("category").isin(names), F.col("category")).otherwise(F.lit(vocab.UNCATEGORISED))
    rows = F.broadcast(spine).join(df.withColumn("bucket", known), "bucket", "right")
    empty = spine.join(rows.select("bucket").distinct(), "bucket", "left_anti")
    return rows.unionByName(empty, allowMissingColumns=True).orderBy("bucket_no", *sort_keys(mode))


def purge_split(df: DataFrame, threshold: int = 10) -> DataFrame:
    """Mark off-topic rows: low specificity unless curated, or unclassified without tags."""
    low = (F.col("ai_specificity_score") < threshold) & (F.col("trust_tier") != "curated")
    bare = F.col("category").isNull() & (F.size("tags") == 0)
    reason = F.when(low, F.lit("low_specificity")).when(bare, F.lit("unclassified_untagged"))
    return df.withColumn("purge_reason", reason).withColumn("removed", F.col("purge_reason").isNotNull())


def published_window(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Keep flag and reason for the publish-date filter, in one pass."""
    d = F.col("date_published")
    reason = (F.when(d.isNull(), F.lit("Missing valid published date"))
              .when(~times.in_window(d, start, end), F.lit("Published date outside reporting window")))
    return df.withColumn("window_reason", reason).withColumn("kept", F.col("window_reason").isNull())


def acceptance(title: Column, url: Column, source_type: Column, trust_tier: Column, tags: Column) -> Column:
    """struct<accepted, needs_review, reason>; curated records skip the type check."""
    missing = rules.blank(title) | rules.blank(url)
    curated = (F.coalesce(trust_tier, F.lit("")) == "curated") | F.coalesce(F.array_contains(tags, "curated"), F.lit(False))
    st = F.coalesce(source_type, F.lit("undefined"))
    reason = (F.when(missing, F.lit("Missing title or URL"))
              .when(curated | st.isin(vocab.ALL_SOURCE_TYPES), F.lit(None).cast("string"))
              .otherwise(F.concat(F.lit("Unsupported source_type: "), st)))
    review = ~missing & ~curated & (st == "unknown")
    return F.struct(reason.isNull().alias("accepted"), review.alias("needs_review"), reason.alias("reason"))


def filter_acceptable(df: DataFrame) -> DataFrame:
    tags = F.col("tags") if "tags" in df.columns else F.array().cast("array<string>")
    a = acceptance(F.col("title"), F.col("url"), F.col("source_type"), F.col("trust_tier"), tags)
    return df.withColumn("acceptance", a)
