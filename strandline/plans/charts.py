"""Chart-ready tables: every data set of a report as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import times
from strandline.operators import aggregate, rank
from strandline.runtime import cut_lineage

BARS = {"attack_vector": ("attack_vectors", 15), "attack_surface": ("attack_surface", 15), "ai_layer": ("ai_layer", 12),
        "signal_cluster": ("signal_clusters", 10)}


def bar_series(df: DataFrame) -> DataFrame:
    """Top values of the four bar metrics with spaced labels."""
    freq = aggregate.corpus_frequencies(df, {}, {m: c for m, (c, _) in BARS.items()})
    top = aggregate.top_n_by(freq, ["metric"], max(n for _, n in BARS.values()))
    limit = F.element_at(F.create_map(*[F.lit(x) for m, (_, n) in BARS.items() for x in (m, n)]), F.col("metric"))
    return top.where(F.col("rank") <= limit).withColumn("label", aggregate.spaced(F.col("key")))


def chart_counts(df: DataFrame) -> DataFrame:
    """The one heavy aggregate behind all charts: counts per metric, key, category and month.

    Its size is bounded by vocabularies x categories x months, so everything after it is small.
    """
    scalars = {m: c for m, c in {"source_type": "source_type", "maturity": "maturity", "operational_status": "operational_status"}.items()}
    arrays = {**{m: c for m, (c, _) in BARS.items()}, "recurring_theme": "recurring_themes"}
    rows = df.withColumn("month", times.year_month(F.col("date_published"))).withColumn("_one", F.lit("all"))
    return aggregate.corpus_frequencies(rows, {**scalars, "rows": "_one"}, arrays, by=["category", "month"])


def viz_table(df: DataFrame, events: int = 20) -> DataFrame:
    """(viz_id, viz_type, slide_use, row_key, column_key, value) for 14 charts.  Zero cells are absent."""
    slim = df.select("position", "id", "category", "date_published", "source_type", "maturity", "operational_status", "attack_vectors",
                     "attack_surface", "ai_layer", "signal_clusters", "recurring_themes", "rawfact_priority", "rawfact_score")
    counts = cut_lineage(chart_counts(slim), "chart-counts")
    none = F.lit(None).cast("string")

    def arm(viz: str, typ: str, use: str, data: DataFrame, row: Column, col: Column) -> DataFrame:
        return data.select(F.lit(viz).alias("viz_id"), F.lit(typ).alias("viz_type"), F.lit(use).alias("slide_use"),
                           row.alias("row_key"), col.alias("column_key"), F.col("count").alias("value"))

    def total(metric: str, *by: str) -> DataFrame:
        keys = list(by) or ["key"]
        return counts.where(F.col("metric") == metric).groupBy(*keys).agg(F.sum("count").alias("count"))

    offensive = F.col("category").isin(vocab.OFFENSIVE_CATEGORIES)
    key, cat = F.col("key"), F.col("category")

    def heat(metric: str, n: int) -> DataFrame:
        top = aggregate.top_n(total(metric), n).select("key")
        return total(metric, "key", "category").where(offensive).join(F.broadcast(top), "key")

    overview, executive, convergence = "threat_landscape_overview", "executive_overview", "cross_category_convergence"
    grid = lambda m: total(m, "category", "key").where(offensive)
    timeline = (rank.timeline_top(slim.withColumn("source_summary", none), events)
                .withColumn("count", F.col("rawfact_score").cast("bigint")))
    return reduce(DataFrame.unionByName, [
        arm("category_distribution", "bar_chart", overview, total("rows", "category"), cat, none),
        arm("source_type_distribution", "bar_chart", executive, total("source_type"), key, none),
        arm("attack_vector_frequency", "bar_chart", "category_insight", aggregate.top_n(total("attack_vector"), 15), key, none),
        arm("attack_surface_heatmap", "heatmap", convergence, aggregate.top_n(total("attack_surface"), 15), key, none),
        arm("maturity_distribution", "stacked_bar", overview, grid("maturity"), cat, key),
        arm("operational_status_by_category", "stacked_bar", overview, grid("operational_status"), cat, key),
        arm("monthly_category_timeline", "stacked_bar", executive,
            total("rows", "month", "category").where("month is not null"), F.col("month"), cat),
        arm("signal_cluster_heatmap", "heatmap", convergence, heat("signal_cluster", 12), key, cat),
        arm("recurring_theme_heatmap", "heatmap", "outlook_support", heat("recurring_theme", 10), key, cat),
        arm("category_maturity_matrix", "matrix", overview, grid("maturity"), cat, key),
        arm("source_type_by_category", "stacked_bar", "category_insight", heat("source_type", 8), key, cat),
        arm("signal_cluster_radar", "radar_chart", convergence, aggregate.top_n(total("signal_cluster"), 10), key, none),
        arm("ai_layer_frequency", "bar_chart", overview, aggregate.top_n(total("ai_layer"), 12), key, none),
        arm("timeline_events", "timeline", executive, timeline, F.col("id"), F.col("date")),
    ])


def cluster_evidence(df: DataFrame, k: int = 4) -> DataFrame:
    """Per signal cluster: source count, number of categories and the first k rows by score."""
    long = df.select(F.explode("signal_clusters").alias("theme"), "position", "id", "category", "rawfact_score", "title", "url")
    totals = long.groupBy("theme").agg(F.count("*").alias("source_count"), F.count_distinct("category").alias("categories"))
    top = rank.top_per_group(long, ["theme"], [F.desc("rawfact_score"), F.asc("id"), F.asc("position")], k)
    return top.join(totals, "theme")


def sector_alerts(df: DataFrame, k: int = 2) -> DataFrame:
    long = df.select(F.explode("sector").alias("sector"), "position", "id", "rawfact_score", "title", "url")
    totals = long.groupBy("sector").agg(F.count("*").alias("count"))
    return rank.top_per_group(long, ["sector"], [F.desc("rawfact_score"), F.asc("id"), F.asc("position")], k).join(totals, "sector")


def entity_counts(df: DataFrame, array: str, kind) -> DataFrame:
    """Entities by kind; ``kind`` maps an entity Column to its kind."""
    long = df.select(F.explode(array).alias("name"))
    return long.groupBy(kind(F.col("name")).alias("kind"), "name").agg(F.count("*").alias("count"))
