"""Evidence dossiers, fallback insights and claim checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules
from strandline.operators import aggregate, rank
from strandline.operators.dedupe import first_per_key
from strandline.operators.skew import hot_join

EMPTY = "array<string>"


def _opt(df: DataFrame, name: str, typ: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(typ)


def evidence_item(df: DataFrame) -> DataFrame:
    """Evidence projection with id ``raw_<id>`` and fallbacks from card to landed fields."""
    card = F.col("evidence_card")
    none = F.array().cast(EMPTY)
    return df.select(
        F.concat(F.lit("raw_"), "id").alias("evidence_id"), F.col("id").alias("source_id"), "category",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.coalesce(F.date_format("date_published", "yyyy-MM-dd"), F.lit("")).alias("published_date"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.coalesce("rawfact_score", F.lit(0)).alias("rawfact_score"),
        F.coalesce("rawfact_priority", F.lit("low")).alias("rawfact_priority"),
        F.coalesce(_opt(df, "is_representative", "boolean"), F.lit(True)).alias("is_cluster_representative"),
        F.coalesce(_opt(df, "cluster_size", "bigint"), F.lit(1)).cast("bigint").alias("cluster_size"),
        F.coalesce(card["short_summary"], _opt(df, "source_summary"), _opt(df, "summary")).alias("short_summary"),
        F.coalesce(card["key_facts"], _opt(df, "main_claims", EMPTY), none).alias("key_facts"),
        F.coalesce(card["numbers_statistics"], _opt(df, "important_numbers", EMPTY), none).alias("numbers_statistics"),
        F.coalesce("attack_vectors", none).alias("attack_vectors"), F.coalesce("maturity", F.lit("unknown")).alias("maturity"),
        F.coalesce("signal_clusters", none).alias("signal_clusters"),
        F.coalesce("operational_status", F.lit("unknown")).alias("operational_status"),
        *[F.col(c) for c in ("rank", "position") if c in df.columns])


def dossier_items(df: DataFrame, k: int = 12) -> DataFrame:
    return evidence_item(rank.select_dossier(df, k))


def dossier(df: DataFrame, k: int = 12) -> DataFrame:
    """One row per non-empty offensive category: count, its top items (at most k) and metric values.

    Item and metric lists are nested here because both are bounded: k items, and values
    of controlled vocabularies.
    """
    items = dossier_items(df, k).groupBy("category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))), lambda s: s["evidence_id"]), "|")
        .alias("evidence_ids"))
    metrics = aggregate.category_metrics(df).groupBy("category").agg(
        F.first("source_count").alias("source_count"),
        F.array_join(F.array_sort(F.collect_set("analytics_id")), "|").alias("analytics_ids"))
    return metrics.join(items, "category")


def dossier_index(items: DataFrame, metrics: DataFrame) -> DataFrame:
    """All citable evidence: (evidence_id, citation_type, label, publisher)."""
    raw = items.select("evidence_id", F.lit("rawfact").alias("citation_type"), F.col("title").alias("label"), "publisher")
    agg = metrics.select(F.col("analytics_id").alias("evidence_id"), F.lit("analytics").alias("citation_type"),
                         F.col("metric").alias("label"), F.lit(None).cast("string").alias("publisher")).distinct()
    return first_per_key(raw.unionByName(agg), ["evidence_id"], [F.asc("citation_type"), F.asc("label"), F.asc("publisher")])


def fallback_insights(df: DataFrame, k: int = 3) -> DataFrame:
    """First k dossier items per category as insight text with a confidence by priority."""
    items = dossier_items(df, 12).where(F.col("rank") <= k)
    fact = F.nullif(F.get("key_facts", F.lit(0)), F.lit(""))
    text = F.coalesce(fact, F.nullif(F.substring("short_summary", 1, 120), F.lit("")),
                      F.concat("source_type", F.lit(": "), F.substring("title", 1, 80)))
    conf = (F.when(F.col("rawfact_priority") == "must_read", F.lit("high"))
            .when(F.col("rawfact_priority") == "high", F.lit("medium")).otherwise(F.lit("low")))
    return items.select("category", "rank", text.alias("insight"), "evidence_id", conf.alias("confidence")).where("insight <> ''")


def fallback_overview(df: DataFrame) -> DataFrame:
    """Overview, outlook and confidence per category from counts."""
    items = dossier_items(df, 12).groupBy("category").agg(F.count_if(F.col("rawfact_priority") == "must_read").alias("must_read"))
    totals = df.where(F.col("category").isin(vocab.OFFENSIVE_CATEGORIES)).groupBy("category").agg(F.count("*").alias("source_count"))
    label = aggregate.spaced(F.col("category"))
    return totals.join(F.broadcast(items), "category").select(
        "category", F.format_string(
            "%d sources identified in %s this reporting period, with %d classified as must-read priority.",
            "source_count", label, "must_read").alias("overview"),
        F.format_string("Continued activity expected in %s. Monitor high-priority sources for escalation.", label).alias("outlook"),
        F.when((F.col("must_read") >= 4) | (F.col("source_count") >= 10), F.lit("medium")).otherwise(F.lit("low")).alias("confidence"))


def insight_audit(claims: DataFrame, index: DataFrame) -> DataFrame:
    """issues and qa_pass per claim.  Lengths are in characters: 15 / 10 / 10 / 20."""
    cited = claims.select("claim_id", F.explode("supporting_ids").alias("evidence_id"))
    found = (hot_join(cited, index.select("evidence_id").distinct(), ["evidence_id"], how="left_semi").select("claim_id").distinct()
             .withColumn("resolved", F.lit(True)))
    rows = claims.join(found, "claim_id", "left")
    n = F.length(F.coalesce("text", F.lit("")))
    kind = F.col("kind")
    issues = rules.flags(
        ("no_evidence_cited", F.coalesce(F.size("supporting_ids"), F.lit(0)) <= 0), ("evidence_not_resolved", F.col("resolved").isNull()),
        ("insight_too_short", (kind == "insight") & (n < 15)), ("signal_too_short", (kind == "early_signal") & (n < 10)),
        ("implication_too_short", (kind == "early_signal") & (F.length(F.coalesce("implication", F.lit(""))) < 10)),
        ("statement_too_short", (kind == "outlook") & (n < 20)))
    return rows.withColumn("issues", issues).drop("resolved").withColumn("qa_pass", F.size("issues") == 0)


def apply_verdicts(audited: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Landed fact-check verdicts (category, position, supported, reason) fail unsupported insights."""
    rows = audited.join(verdicts, ["category", "position"], "left")
    bad = (F.col("kind") == "insight") & (F.coalesce("supported", F.lit(True)) == F.lit(False))
    note = F.array(F.concat(F.lit("unsupported: "), F.coalesce("reason", F.lit(""))))
    return (rows.withColumn("issues", F.when(bad, F.concat("issues", note)).otherwise(F.col("issues")))
            .withColumn("qa_pass", F.col("qa_pass") & ~bad).drop("supported", "reason"))


def confidence_adjust(audited: DataFrame, confidence: DataFrame) -> DataFrame:
    """Per category: retained and removed insights and the adjusted confidence.

    ``confidence``: category, original_confidence.  Retention below .5 gives low; below .8 turns
    high into medium, as does a failed outlook.
    """
    kind, ok = F.col("kind"), F.col("qa_pass")
    got = audited.groupBy("category").agg(
        F.count_if(kind == "insight").alias("insights"), F.count_if((kind == "insight") & ok).alias("retained"),
        F.count_if((kind == "early_signal")).alias("early_signals"),
        F.count_if((kind == "early_signal") & ~ok).alias("signal_issues"),
        F.coalesce(F.bool_and(F.when(kind == "outlook", ok)), F.lit(True)).alias("outlook_pass"))
    rate = F.when(F.col("insights") > 0, F.col("retained") / F.col("insights")).otherwise(F.lit(1.0))
    first = (F.when(rate < 0.5, F.lit("low")).when((rate < 0.8) & (F.col("original_confidence") == "high"), F.lit("medium"))
             .otherwise(F.col("original_confidence")))
    return (got.join(confidence, "category").withColumn("removed", F.col("insights") - F.col("retained"))
            .withColumn("_c", first)
            .withColumn("adjusted_confidence", F.when(~F.col("outlook_pass") & (F.col("_c") == "high"), F.lit("medium")).otherwise(F.col("_c")))
            .drop("_c"))


def audit_rollup(adjusted: DataFrame) -> DataFrame:
    """Totals per category and overall."""
    return (adjusted.rollup("category").agg(
        F.sum("insights").alias("insights"), F.sum("early_signals").alias("early_signals"),
        F.sum("retained").alias("retained"), F.sum("removed").alias("removed"),
        F.count_if(F.col("adjusted_confidence") != F.col("original_confidence")).alias("downgraded"),
        F.count_if(F.col("adjusted_confidence") == "high").alias("high_confidence"))
        .withColumn("category", F.coalesce("category", F.lit("all"))))
