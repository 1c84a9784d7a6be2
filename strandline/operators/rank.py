"""Rankings and top-k.  Every per-group rank is filtered to a small k, which Spark also
applies before the shuffle, so a hot group sends at most k rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions.rules import lit_map


def priority_rank(c: Column, order: list[str] | None = None) -> Column:
    """Position in the priority order; unknown values come last."""
    order = order or vocab.PRIORITY_ORDER
    return F.coalesce(F.element_at(lit_map({p: i for i, p in enumerate(order)}), c),
                      F.lit(len(order)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_sources_per_category(df: DataFrame, score: str, k: int = 5) -> DataFrame:
    return top_per_group(df.where(F.col(score).isNotNull()), ["category"], [F.desc(score), F.asc("id"), F.asc("position")], k)


def select_dossier(df: DataFrame, k: int = 12, categories: list[str] | None = None) -> DataFrame:
    """Top k per category: priority order, cluster representatives first, score descending."""
    rows = df.where(F.col("category").isin(categories or vocab.OFFENSIVE_CATEGORIES))
    return top_per_group(rows, ["category"], [
        F.least(priority_rank(F.col("rawfact_priority")), F.lit(4)),
        F.coalesce("is_representative", F.lit(True)).desc(),
        F.coalesce("rawfact_score", F.lit(0)).desc(), F.asc("id"), F.asc("position")], k)


def top_k_union(df: DataFrame, score: str, k: int = 4) -> DataFrame:
    rows = df.withColumn("category", F.coalesce("category", F.lit(vocab.FALLBACK_CATEGORY)))
    top = top_per_group(rows.where(F.col("category").isin(vocab.CATEGORIES)), ["category"],
                        [F.desc(score), F.asc("id"), F.asc("position")], k)
    return top_per_group(top.drop("rank"), ["id"], [F.asc("position")], 1).drop("rank")


def diverse_sample(df: DataFrame, per_category: int = 3, pool: int = 50) -> DataFrame:
    """``per_category`` picks out of each category's newest ``pool``: unenriched first, then trust
    order; distinct source types before repeats."""
    newest = top_per_group(df.where(F.col("category").isin(vocab.OFFENSIVE_CATEGORIES)), ["category"],
                           [F.desc_nulls_first("date_published"), F.asc("id"), F.asc("position")], pool, "_pool")
    order = [F.col("enriched").cast("int"), priority_rank(F.col("trust_tier"), vocab.TRUST_TIERS),
             F.asc("_pool")]
    typed = newest.withColumn("_in_type", F.row_number().over(
        Window.partitionBy("category", "source_type").orderBy(*order)))
    return top_per_group(typed, ["category"], [(F.col("_in_type") > 1).cast("int"), *order], per_category) \
        .drop("_pool", "_in_type")


def priority_briefing(df: DataFrame, k: int = 5) -> DataFrame:
    return (df.where(F.col("priority_label").isin("critical", "high"))
            .orderBy(F.coalesce("priority_score", F.lit(0)).desc(), F.desc_nulls_last("date_published"), F.asc("id"))
            .limit(k))


def featured(df: DataFrame, order: list[Column], k: int = 3) -> DataFrame:
    """First k rows per category and how many remain.  The size comes from a partial aggregate."""
    totals = df.groupBy("category").agg(F.count("*").alias("_n"))
    top = top_per_group(df, ["category"], order, k)
    return top.join(F.broadcast(totals), "category").withColumn(
        "remaining", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def timeline(df: DataFrame) -> DataFrame:
    """Dated rows ascending, with their first attack vector and signal cluster."""
    return (df.where(F.col("date_published").isNotNull()).withColumns({
        "date": F.date_format("date_published", "yyyy-MM-dd"),
        "top_attack_vector": F.get("attack_vectors", F.lit(0)),
        "top_signal_cluster": F.get("signal_clusters", F.lit(0))})
        .orderBy("date", "position"))


def timeline_top(df: DataFrame, k: int = 20, summary_chars: int = 150) -> DataFrame:
    rows = timeline(df).withColumn("source_summary", F.substring("source_summary", 1, summary_chars))
    return rows.orderBy(priority_rank(F.col("rawfact_priority")), F.desc("date"), F.asc("position")).limit(k)


def top_claims(claims: DataFrame, kind: str, *, per_category: int | None = None, total: int | None = None,
               confidence: str | None = None) -> DataFrame:
    """First claims of a kind in category order, optionally per category and in total."""
    rows = claims.where(F.col("kind") == kind)
    if confidence:
        rows = rows.where(F.col("confidence") == confidence)
    if per_category:
        rows = top_per_group(rows, ["category"], [F.asc("position")], per_category).drop("rank")
    rows = rows.orderBy(priority_rank(F.col("category"), vocab.CATEGORIES), "position")
    return rows.limit(total) if total else rows
