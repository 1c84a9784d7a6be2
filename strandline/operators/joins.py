"""Joins with rule tables, connectors, evidence and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import phrases
from strandline.operators.skew import HOT_ROWS, hot_join, lookup_join
from strandline.runtime import cut_lineage


def first_rule(df: DataFrame, rule_table: DataFrame, text: Column, value: str, default: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First rule (lowest rule_no, then match) of (rule_no, match, <value>) whose ``match`` occurs in ``text``.

    The distinct texts are joined with the rules through the rules' rarest tokens, so neither table has to be
    small.  A null text, or one that no rule matches, gets ``default``.
    """
    rows = df.withColumn("_text", text)
    kinds = cut_lineage(rows.select("_text").where(F.col("_text").isNotNull()).distinct(), "rule-texts")
    rules_ = rule_table.where(F.col("match").isNotNull()).groupBy("match").agg(F.min(F.struct("rule_no", "match", value)).alias("_rule"))
    found = phrases.contained_phrases(kinds, rules_, keys=["_text"], text="_text", phrase="match", hot_rows=hot_rows)
    first = hot_join(found.withColumnRenamed("phrase", "match"), rules_, ["match"], hot_rows=hot_rows).groupBy("_text").agg(F.min("_rule").alias("_rule"))
    out = hot_join(rows, cut_lineage(first.select("_text", F.col("_rule")[value].alias("_value")), "rule-hits"), ["_text"], how="left", hot_rows=hot_rows)
    return out.withColumn(value, F.coalesce("_value", F.lit(default))).drop("_text", "_value")


def union_connectors(parts: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """Concatenate the connectors' rows by column name, stamped with the connector's name."""
    chosen = [df.withColumn("connector", F.lit(name)) for name, df in parts.items() if only is None or name in only]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def connector_stats(rows: DataFrame, failures: dict[str, str] | None = None) -> DataFrame:
    """Status, count and error per connector; failed reads are listed with no rows."""
    ok = rows.groupBy("connector").agg(F.count("*").alias("count")).select(
        "connector", F.lit("success").alias("status"), "count", F.lit(None).cast("string").alias("error"))
    if not failures:
        return ok
    bad = rows.sparkSession.createDataFrame([(n, "failed", 0, e) for n, e in failures.items()], ok.schema)
    return ok.unionByName(bad)


def stamp_from_registry(df: DataFrame, registry: DataFrame, key: str = "publisher") -> DataFrame:
    """Attach the enabled feed definitions of each row's publisher.

    A publisher may have several, so the registry is not hinted: Spark broadcasts it when its size allows
    and splits a hot publisher's rows otherwise.
    """
    return df.join(registry.where("enabled").drop("enabled"), key)


def link_evidence(claims: DataFrame, items: DataFrame, ids: str = "supporting_ids", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(claim, order, evidence_id, item columns): claims' ids resolved to dossier items; unknown ids drop out.

    ``items`` has one row per ``evidence_id``, of either kind.
    """
    long = claims.select("claim_id", "category", F.posexplode(ids).alias("ord", "evidence_id"))
    return hot_join(long, items, ["evidence_id"], hot_rows=hot_rows)


def claim_citations(linked: DataFrame) -> DataFrame:
    """Distinct citations per category."""
    return linked.select("category", "evidence_id", "citation_type").distinct()


def link_viewpoints(claims: DataFrame, rows: DataFrame, ids: str = "source_ids") -> DataFrame:
    """One row per resolved (claim, position) with the source's citation fields and framework refs.

    Fields that ``rows`` does not have come as nulls.
    """
    refs = F.concat(*[F.transform(c, lambda t: t["framework_ref"])
                      for c in ("framework_tags", "attack_mappings", "governance_tags")])
    more = [("date_published", "timestamp_ntz"), ("category", "string"), ("feed_score", "int"), ("feed_priority", "string"),
            ("source_summary", "string"), ("main_claims", "array<string>")]
    names = {"category": "main_category", "main_claims": "key_facts"}
    extra = [(F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(names.get(c, c)) for c, t in more]
    cite = rows.select(F.col("id").alias("source_id"), F.col("title"), "url", "publisher", "source_type",
                       F.col("trust_tier"), F.array_join(refs, "|").alias("framework_refs"), *extra)
    long = claims.select("claim_id", F.posexplode(ids).alias("ord", "source_id"))
    return hot_join(long, cite, ["source_id"])


def citation_coverage(sections: DataFrame, rows: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Share of high-priority rows cited by evidence id, planned id or call-out title, and the warning.

    ``rows``: id, title, feed_priority.
    """
    high = rows.where(F.col("feed_priority").isin("must_read", "high")).select("id", F.lower(F.coalesce("title", F.lit(""))).alias("t"))
    high = cut_lineage(high, "coverage-high")
    call = sections.select(F.explode("evidence").alias("e"))
    cited = call.select(F.regexp_replace("e.evidence_id", "^raw_", "").alias("id"),
                        F.col("e.evidence_id").startswith("raw_").alias("raw")).where("raw").select("id")
    planned = sections.select(F.explode("planned_ids").alias("id"))
    ids = cited.unionByName(planned).distinct().withColumn("by_id", F.lit(True))
    titles = call.select(F.lower(F.coalesce("e.title", F.lit(""))).alias("t")).distinct().withColumn("by_title", F.lit(True))
    # Titles repeat, so the title side is looked up through its per-title counts.
    counts = high.groupBy("t").agg(F.count("*").alias("n")).join(titles, "t")
    flagged = lookup_join(high, cut_lineage(counts, "coverage"), ["t"], count_col="n", how="left", hot_rows=hot_rows) \
        .join(ids, "id", "left")
    hit = F.coalesce("by_id", F.lit(False)) | F.coalesce("by_title", F.lit(False))
    out = flagged.agg(F.count("*").alias("high_priority"), F.count_if(hit).alias("covered"))
    n = F.col("high_priority")
    pct = F.when(n > 0, F.floor(F.col("covered") / n * 100 + 0.5)).otherwise(F.lit(100)).cast("int")
    limit = F.when(n <= 20, F.lit(50)).otherwise(
        F.greatest(F.lit(5), F.least(F.lit(50), F.floor(F.lit(55) / n * 100 + 0.5).cast("int"))))
    return out.withColumn("coverage_pct", pct).withColumn("threshold", limit) \
        .withColumn("warn", (n > 0) & (F.col("coverage_pct") < F.col("threshold")))


def number_trace(reported: DataFrame, source_texts: DataFrame, text: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Reported percentages that no source text states.

    ``reported``: section_id, number.  A source states N when it has ``N%``, ``N %`` or
    ``N percent`` as a whole number (``5%`` does not match inside ``15%``).
    """
    stated = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![\d.])(\d+(?:\.\d+)?)(?:%| %| percent)"), F.lit(1))
    known = source_texts.select(F.explode(stated).alias("number")).distinct()
    return hot_join(reported, known, ["number"], how="left_anti", hot_rows=hot_rows)
