"""Data-quality audits of report sections and claims: one issue row per failed check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import text
from strandline.functions.rules import lit_array
from strandline.operators.phrases import contained_phrases
from strandline.operators.skew import hot_join

STRUCTURAL = ["title", "section_divider", "appendix"]
UNCITED = [*STRUCTURAL, "conclusion"]
YEARS = (2020, 2030)


def filled(c: Column) -> Column:
    return text.js_trim(F.coalesce(c, F.lit(""))) != ""


def row_audit(df: DataFrame, key: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """Issue rows (key, check, severity) of the failed (name, severity, condition) checks.

    A null condition fails.  All checks run in one narrow pass over the rows.
    """
    issues = [F.when(~F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("check"), F.lit(sev).alias("severity")))
              for name, sev, cond in checks]
    return df.select(key, F.inline(F.array_compact(F.array(*issues))))


def audit_totals(df: DataFrame, key: str, issues: DataFrame) -> DataFrame:
    """Passed and failed record counts; a record fails when an error-level check fails."""
    bad = issues.where("severity = 'error'").select(key).distinct()
    marks = df.select(F.lit(1).alias("total"), F.lit(0).alias("failed")).unionByName(
        bad.select(F.lit(0).alias("total"), F.lit(1).alias("failed")))
    return (marks.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
            .select((F.col("total") - F.col("failed")).alias("passed"), "failed", (F.col("failed") == 0).alias("overall_pass")))


def section_checks() -> list[tuple[str, str, Column]]:
    structural = F.col("section_type").isin(STRUCTURAL)
    return [
        ("has_headline", "error", filled(F.col("headline"))),
        ("item_count_ok", "error", F.coalesce(F.size("items"), F.lit(0)) <= 5),
        ("items_not_too_long", "warning", F.forall(F.coalesce("items", F.array().cast("array<string>")), lambda i: text.word_count(i) <= 15)),
        ("has_notes", "warning", filled(F.col("notes"))),
        ("has_evidence_or_citations", "warning", structural | (F.size("evidence") > 0) | (F.size("citations") > 0)),
        ("evidence_has_id", "warning", structural | F.forall("evidence", lambda e: filled(e["evidence_id"]))),
    ]


def claim_checks(resolved: Column) -> list[tuple[str, str, Column]]:
    """``resolved``: whether one of the claim's evidence ids is known."""
    return [
        ("has_text", "error", filled(F.col("text"))),
        ("has_valid_category", "error", F.col("category").isin([*vocab.CATEGORIES, "cross_category", vocab.LEGACY_CATEGORY, vocab.UNCATEGORISED])),
        ("has_valid_claim_type", "warning", F.col("claim_type").isin("trend", "insight", "early_signal", "outlook", "implication")),
        ("has_supporting_evidence", "error", F.size("supporting_ids") > 0),
        ("evidence_ids_resolvable", "warning", resolved),
        ("has_note", "warning", filled(F.col("note"))),
        ("has_valid_confidence", "warning", F.col("confidence").isin("high", "medium", "low")),
        ("has_valid_maturity", "warning", F.col("maturity").isin(vocab.MATURITIES[:-1])),
        ("has_valid_watch_window", "warning", F.col("watch_window").isin("now", "3_6_months", "6_12_months")),
        ("text_not_too_long", "warning", text.word_count(F.col("text")) <= 60),
        ("note_not_too_long", "info", text.word_count(F.col("note")) <= 120),
    ]


def with_resolved(claims: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Flag claims with at least one evidence id of ``known_ids`` (evidence_id)."""
    cited = claims.select("claim_id", F.explode("supporting_ids").alias("evidence_id"))
    hit = (hot_join(cited, known_ids.select("evidence_id").distinct(), ["evidence_id"], how="left_semi").select("claim_id").distinct()
           .withColumn("resolved", F.lit(True)))
    return claims.join(hit, "claim_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def audit_callouts(sections: DataFrame) -> DataFrame:
    """Missing call-out fields and missing citations of content sections."""
    rows = sections.where(~F.col("section_type").isin(UNCITED))
    per = rows.select("section_id", F.explode("evidence").alias("e"))
    fields = row_audit(per, "section_id", [
        ("callout_has_title", "warning", filled(F.col("e.title"))), ("callout_has_publisher", "warning", filled(F.col("e.publisher"))),
        ("callout_has_key_fact", "warning", filled(F.col("e.key_fact")))])
    return fields.unionByName(row_audit(rows, "section_id", [("has_citations", "warning", F.size("citations") > 0)]))


def section_texts(sections: DataFrame) -> DataFrame:
    """(section_id, field, text) of the three audited fields."""
    return sections.select("section_id", F.inline(F.array(
        F.struct(F.lit("headline").alias("field"), F.coalesce("headline", F.lit("")).alias("text")),
        F.struct(F.lit("items").alias("field"), F.array_join(F.coalesce("items", F.array().cast("array<string>")), " ").alias("text")),
        F.struct(F.lit("notes").alias("field"), F.coalesce("notes", F.lit("")).alias("text")))))


def audit_numbers(texts: DataFrame) -> DataFrame:
    """Percentages over 100 (errors) and years outside the range (warnings), one row per occurrence."""
    over = F.transform(F.filter(text.percentages(F.col("text")), lambda p: p.cast("double") > 100),
                       lambda p: F.struct(F.lit("invalid_percentage").alias("check"), F.lit("error").alias("severity"), p.alias("value")))
    odd = F.transform(F.filter(text.years(F.col("text")), lambda y: (y < YEARS[0]) | (y > YEARS[1])),
                      lambda y: F.struct(F.lit("implausible_year").alias("check"), F.lit("warning").alias("severity"), y.cast("string").alias("value")))
    return texts.select("section_id", "field", F.inline(F.concat(over, odd)))


def audit_phrases(texts: DataFrame, phrases: DataFrame | list[str] | None = None) -> DataFrame:
    """(section_id, field, phrase) for each filler phrase a field contains.

    A list of phrases becomes a literal array: one narrow pass, no join.  A table of phrases, of any size, is joined
    through each phrase's rarest token.
    """
    phrases = vocab.FILLER_PHRASES if phrases is None else phrases
    low = texts.withColumn("_low", F.lower("text"))
    if isinstance(phrases, DataFrame):
        return contained_phrases(low, phrases, keys=["section_id", "field"], text="_low")
    found = F.filter(lit_array(phrases), lambda p: F.contains(F.col("_low"), p))
    return low.select("section_id", "field", F.explode(found).alias("phrase"))


def audit_all(parts: dict[str, DataFrame]) -> DataFrame:
    """All issues as (module, record_id, check, severity); no sections at all is one error."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(module).alias("module"), F.col(df.columns[0]).cast("string").alias("record_id"), "check", "severity")
        for module, df in parts.items()])


def empty_report_issue(sections: DataFrame) -> DataFrame:
    return (sections.agg(F.count("*").alias("n")).where("n = 0")
            .select(F.lit("qa").alias("module"), F.lit("-").alias("record_id"), F.lit("has_sections").alias("check"), F.lit("error").alias("severity")))
