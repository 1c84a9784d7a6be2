"""Counts, cross-tabs, trends and roll-ups as long tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import times
from strandline.runtime import cut_lineage

# metric name -> column of the enriched frame
SCALAR_METRICS = {
    "category": "category", "source_type": "source_type", "publisher": "publisher",
    "trust_tier": "trust_tier", "operational_status": "operational_status",
    "maturity": "maturity", "impact_scope": "impact_scope", "rawfact_priority": "rawfact_priority",
}
ARRAY_METRICS = {
    "attack_vector": "attack_vectors", "attack_surface": "attack_surface", "ai_layer": "ai_layer",
    "impact_type": "impact_type", "sector": "sector", "geography": "geography",
    "technology": "technology", "entity": "entities", "signal_cluster": "signal_clusters",
    "recurring_theme": "recurring_themes",
}


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.where(present(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count"))


def count_by_array(df: DataFrame, array: str) -> DataFrame:
    """Count array elements; repeats inside one array count again."""
    return count_by(df.select(F.explode(array).alias("key")), "key")


def metric_rows(scalars: dict[str, str], arrays: dict[str, str]) -> Column:
    """array<struct<metric, key>> of one row: every metric it contributes to."""
    def pair(metric: str, key: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"))

    parts = [F.array(*[pair(m, F.col(c)) for m, c in scalars.items()])] if scalars else []
    for metric, col in arrays.items():
        values = F.coalesce(F.col(col), F.array().cast("array<string>"))
        parts.append(F.transform(values, partial(pair, metric)))
    return F.filter(F.concat(*parts), lambda x: present(x["key"]))


def corpus_frequencies(df: DataFrame, scalars=None, arrays=None, by: list[str] | None = None) -> DataFrame:
    """All frequencies in one pass: explode (metric, key), then one aggregate."""
    by = by or []
    pairs = metric_rows(SCALAR_METRICS if scalars is None else scalars,
                        ARRAY_METRICS if arrays is None else arrays)
    return df.select(*by, F.inline(pairs)).groupBy(*by, "metric", "key").agg(F.count("*").alias("count"))


def mapping_frequency(df: DataFrame, category: str | None = None) -> DataFrame:
    rows = df if category is None else df.where(F.col("category") == category)
    both = F.concat(
        F.transform("attack_mappings", lambda m: F.struct(F.lit("attack").alias("kind"), m["tag"].alias("tag"))),
        F.transform("governance_tags", lambda m: F.struct(F.lit("governance").alias("kind"), m["tag"].alias("tag"))))
    return rows.select(F.inline(both)).groupBy("kind", "tag").agg(F.count("*").alias("count"))


def monthly_counts(df: DataFrame, scalars: dict[str, str], arrays: dict[str, str] | None = None,
                   date: str = "date_published") -> DataFrame:
    rows = df.where(F.col(date).isNotNull()).withColumn("month", times.year_month(F.col(date)))
    return corpus_frequencies(rows, scalars, arrays or {}, by=["month"])


def month_range(df: DataFrame, date: str = "date_published") -> DataFrame:
    month = times.year_month(F.col(date))
    return df.agg(F.concat(F.min(month), F.lit("-01")).alias("start"), F.concat(F.max(month), F.lit("-01")).alias("end"),
                  F.count_distinct(month).alias("months"))


def trend_delta(monthly: DataFrame) -> DataFrame:
    """Change per (metric, key) from the last-but-one month *present* to the last; empty below two months.

    ``monthly`` has metric, month, key, count.  The two months are found from the few
    distinct months, not by a window over all rows.
    """
    months = monthly.groupBy("metric").agg(F.array_sort(F.collect_set("month")).alias("ms")).where(F.size("ms") >= 2)
    ends = months.select("metric", F.element_at("ms", -2).alias("prev_month"), F.element_at("ms", -1).alias("last_month"))
    rows = monthly.join(F.broadcast(ends), "metric").where(F.col("month").isin(F.col("prev_month"), F.col("last_month")))
    sign = F.when(F.col("month") == F.col("last_month"), F.col("count")).otherwise(-F.col("count"))
    return rows.groupBy("metric", "key", "prev_month", "last_month").agg(F.sum(sign).alias("delta"))


def top_growing(delta: DataFrame, n: int = 3) -> DataFrame:
    return delta.where("delta > 0").orderBy(F.desc("delta"), "key").limit(n)


def top_n(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), F.asc("key")).limit(n)


def top_n_by(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc("key"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def spine(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, {column}_no int")


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Dense counts with one column per fixed value."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_filled(df: DataFrame, rows: str, row_values: list[str], columns: str, values: list[str]) -> DataFrame:
    """``crosstab`` with every row value present."""
    table = crosstab(df.where(F.col(rows).isin(row_values)), rows, columns, values)
    names = spine(df, rows, row_values).drop(f"{rows}_no")
    return names.join(table, rows, "left").na.fill(0)


def top_crosstab(df: DataFrame, array: str, n: int, categories: list[str] | None = None) -> DataFrame:
    """Top-n array values of the whole corpus, each counted per category."""
    cats = categories or vocab.OFFENSIVE_CATEGORIES
    long = df.select("category", F.explode(array).alias("key")).where(present(F.col("key")))
    by_cat = long.groupBy("key", "category").agg(F.count("*").alias("count"))
    top = top_n(by_cat.groupBy("key").agg(F.sum("count").alias("count")), n)
    cells = by_cat.join(F.broadcast(top.select("key", F.col("count").alias("total"))), "key")
    return cells.groupBy("key", "total").pivot("category", cats).agg(F.sum("count")).na.fill(0)


def stacked_months(monthly: DataFrame) -> DataFrame:
    """Dense month x key series with zeros: a pivot over the keys and back.

    Spark finds the keys itself and refuses more than ``spark.sql.pivotMaxValues`` of them.
    """
    wide = monthly.groupBy("month").pivot("key").agg(F.sum("count")).na.fill(0)
    return wide.unpivot("month", [c for c in wide.columns if c != "month"], "key", "count")


def labeled_counts(counts: DataFrame, labels: dict[str, str]) -> DataFrame:
    from strandline.functions.rules import lookup
    return counts.withColumn("label", F.coalesce(lookup(F.col("key"), labels), "key"))


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def category_breakdown(df: DataFrame) -> DataFrame:
    """Long table per offensive category: counts, top-5 lists, monthly counts; every category
    has at least its ``count`` row."""
    rows = df.where(F.col("category").isin(vocab.OFFENSIVE_CATEGORIES))
    freq = corpus_frequencies(
        rows, {"source_type": "source_type", "maturity": "maturity"},
        {"attack_vector": "attack_vectors", "attack_surface": "attack_surface",
         "signal_cluster": "signal_clusters", "recurring_theme": "recurring_themes"}, by=["category"])
    capped = ["attack_vector", "attack_surface", "signal_cluster", "recurring_theme"]
    top = top_n_by(freq.where(F.col("metric").isin(capped)), ["category", "metric"], 5).drop("rank")
    whole = freq.where(~F.col("metric").isin(capped))
    months = (rows.where(F.col("date_published").isNotNull())
              .groupBy("category", times.year_month(F.col("date_published")).alias("key"))
              .agg(F.count("*").alias("count")).withColumn("metric", F.lit("month")))
    total = spine(df, "category", vocab.OFFENSIVE_CATEGORIES).drop("category_no").join(
        rows.groupBy("category").agg(F.count("*").alias("count")), "category", "left").na.fill(0, ["count"]) \
        .select("category", F.lit("count").alias("metric"), F.lit("all").alias("key"), "count")
    return total.unionByName(whole).unionByName(top).unionByName(months)


def category_metrics(df: DataFrame) -> DataFrame:
    """Dossier metrics per offensive category: agg_<category>_<metric> with value counts and the
    number of member rows.  Members are counted, not collected: a category can be huge."""
    rows = (df.where(F.col("category").isin(vocab.OFFENSIVE_CATEGORIES))
            .withColumn("maturity", F.coalesce("maturity", F.lit("unknown")))
            .withColumn("operational_status", F.coalesce("operational_status", F.lit("unknown"))))
    freq = corpus_frequencies(
        rows, {"maturity": "maturity", "operational_status": "operational_status"},
        {"attack_vectors": "attack_vectors", "signal_clusters": "signal_clusters"}, by=["category"])
    members = rows.groupBy("category").agg(F.count("*").alias("source_count"))
    return freq.join(F.broadcast(members), "category").withColumn(
        "analytics_id", F.concat_ws("_", F.lit("agg"), "category", "metric"))


def metric_members(df: DataFrame) -> DataFrame:
    """Membership of the dossier metrics as rows (category, source_id) instead of an array."""
    return df.where(F.col("category").isin(vocab.OFFENSIVE_CATEGORIES)).select("category", F.col("id").alias("source_id"))


def share(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Count and share of the total per key; the counts are written once, so any number of keys is added up in many tasks."""
    counts = cut_lineage(df.groupBy(key.alias(name)).agg(F.count("*").alias("count")), "share")
    total = counts.agg(F.sum("count")).first()[0]
    return counts.withColumn("share", F.col("count") / F.lit(total))


def priority_bar(df: DataFrame) -> DataFrame:
    label = F.col("priority_label")
    return share(df, F.when(label.isin(vocab.BRIEFING_ORDER), label).otherwise(F.lit("background")), "priority")


def tag_cloud(df: DataFrame, n: int = 28) -> DataFrame:
    top = top_n(count_by_array(df, "tags"), n)
    peak = F.max("count").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("relative_size", F.col("count") / peak)


def archive_facets(df: DataFrame) -> DataFrame:
    cat = F.coalesce("category", F.lit(vocab.UNCATEGORISED))
    return (df.withColumn("facet", cat).rollup("facet").agg(F.count("*").alias("count"))
            .select(F.coalesce("facet", F.lit("all")).alias("facet"), "count"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues by module and severity with subtotals; ``pass`` means no error in the group."""
    return (issues.rollup("module", "severity").agg(
        F.count("*").alias("issues"), (F.count_if(F.col("severity") == "error") == 0).alias("pass"))
        .select(F.coalesce("module", F.lit("all")).alias("module"),
                F.coalesce("severity", F.lit("all")).alias("severity"), "issues", "pass"))


def convergence_edges(df: DataFrame, array: str = "recurring_themes") -> DataFrame:
    """Category pairs that share a value of ``array``: weight and the shared values.

    Only the distinct (category, value) pairs are joined; both sides come from
    controlled vocabularies.  The two columns are written once: a filter on them would otherwise be pushed
    into what derives them, which is then worked out again for each of its uses, and for each side of the join.
    """
    df = cut_lineage(df.select("category", array), "convergence")
    pairs = df.select("category", F.explode(array).alias("theme")).where(present(F.col("theme"))).distinct()
    a = pairs.select(F.col("category").alias("from"), "theme")
    b = pairs.select(F.col("category").alias("to"), "theme")
    return (a.join(b, "theme").where(F.col("from") < F.col("to")).groupBy("from", "to")
            .agg(F.count("*").alias("weight"), F.array_join(F.array_sort(F.collect_set("theme")), "|").alias("themes")))


def weekly_activity(df: DataFrame, ts: str, emerging: Column) -> DataFrame:
    return df.groupBy(times.iso_week_key(F.col(ts)).alias("week")).agg(
        F.count("*").alias("count"), F.count_if(emerging).alias("emerging_count"))


def period_comparison(df: DataFrame, key: str, ts: str, as_of: Column, period: str) -> DataFrame:
    """Counts of a period and of the one before it, with change and percent change."""
    w = times.period_window(as_of, period)
    start, end = w["start_utc"], w["end_utc"]
    before = start - times.days(times.PERIOD_DAYS[period])
    t = F.col(ts)
    rows = df.where((t >= before) & (t < end))
    out = rows.groupBy(F.col(key).alias("key")).agg(
        F.count_if(t >= start).alias("current"), F.count_if(t < start).alias("previous"))
    return (out.withColumn("change", F.col("current") - F.col("previous"))
            .withColumn("percent_change", F.when(F.col("previous") > 0, F.round(F.col("change") * 100 / F.col("previous"), 2)))
            .withColumn("is_new", F.col("previous") == 0))
