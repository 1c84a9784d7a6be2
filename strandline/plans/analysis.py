"""Analysis composition: relevance, taxonomy, cards, two-pass score, analytics columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import classify, graph, score, taxonomy
from strandline.operators.skew import HOT_ROWS
from strandline.runtime import cut_lineage

TEXTS = ["full_text", "clean_text", "raw_text", "raw_html"]
CLUSTER_COLUMNS = ["cluster_id", "component", "cluster_size", "representative_title", "is_multi_source", "is_representative", "cluster_theme"]


def enrich(df: DataFrame, as_of: Column, *, whole_word: bool = False) -> DataFrame:
    """Narrow enrichment: relevance, taxonomy, evidence card, first score, analytics columns."""
    out = df if "ai_specificity_score" in df.columns else classify.ai_relevance(df, whole_word=whole_word)
    out = score.evidence_card(taxonomy.rawfact_taxonomy(out))
    return taxonomy.analytics_taxonomy(score.rawfact_score(out, as_of))


def two_pass_score(df: DataFrame, as_of: Column, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """score -> cluster -> score again, where members that do not represent their cluster lose points.

    The enriched rows are written once, without their texts, and only position, id, title, category and score are
    clustered.  Clusters and texts are joined back on the unique position; columns that nobody asks for are neither read
    again nor shuffled.
    """
    first = enrich(df, as_of)
    texts = [c for c in TEXTS if c in first.columns]
    columns = first.columns
    first = cut_lineage(first.drop(*texts), "first-pass")
    slim = first.select("position", "id", "title", "category", "rawfact_score")
    clusters = graph.cluster_records(slim, F.col("rawfact_score"), hot_rows=hot_rows).select("position", *CLUSTER_COLUMNS)
    both = first.join(clusters, "position").join(df.select("position", *texts), "position")
    return score.rawfact_score(both.select(*columns, *CLUSTER_COLUMNS), as_of)


def rawfact_counts(df: DataFrame) -> DataFrame:
    p = F.col("rawfact_priority")
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("evidence_card").isNotNull()).alias("evidence_cards"),
        *[F.count_if(p == b).alias(b) for b in ("must_read", "high", "medium", "low", "archive_only")],
        F.count_distinct("component").alias("clusters"),
        F.count_distinct(F.when(F.col("is_multi_source"), F.col("component"))).alias("multi_source_clusters"))


def synthesis_counts(df: DataFrame, claims: DataFrame) -> DataFrame:
    p = F.col("rawfact_priority")
    whole = df.agg(F.count("*").alias("total_sources"), F.count_if(p.isin("must_read", "high")).alias("high_priority"),
                   F.count_if(F.col("evidence_card").isNotNull()).alias("evidence_cards"),
                   F.count_distinct(F.when(F.col("is_multi_source"), F.col("component"))).alias("clusters"))
    said = claims.agg(F.count_if(F.col("kind") == "insight").alias("insights"),
                      F.count_if(F.col("kind") == "early_signal").alias("early_signals"))
    both = whole.unionByName(said, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
