"""Test views over the driver tables.

The operators need attributed, dated records; the driver's documents carry only text,
language and source.  These projections derive the missing columns by fixed arithmetic
on the ids, in Spark and (as CTEs) in SQL.  They are test data, not library features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import cte
from strandline import vocab
from strandline.functions import rules
from strandline.runtime import spread

AS_OF = "2025-03-01 00:00:00"
CONFIDENCES = ["exact", "exact", "estimated", "low", "none"]
FIXTURE_TYPES = vocab.SOURCE_TYPES + ["unknown", "social_signal"]
# Words that do occur in the invented prose.
TEST_TAGS = {
    "the": [" the "], "und": [" und ", "nicht"], "elle": ["elle"], "pour": [" pour "],
    "que": [" que "], "los": [" los ", " las "], "mail": ["@"], "cve": ["cve-"],
}
FRAMEWORK_TAGS = [r for r in vocab.registry_rows() if r[1] == "ai_framework_tag"]
ATTACK_TAGS = [r for r in vocab.registry_rows() if r[1] == "attack_mapping"]
GOVERNANCE_TAGS = [r for r in vocab.registry_rows() if r[1] == "governance_tag"]


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; the text tables are spread over the cores when they come as one split."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def pick(index: Column, values: list[str]) -> Column:
    """values[index], by a literal array."""
    return F.element_at(rules.lit_array(values), F.pmod(index, F.lit(len(values))).cast("int") + 1)


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(index: str, values) -> str:
    return f"({sql_list(values)})[({index}) % {len(values)} + 1]"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("page_url"))
    doc = F.col("doc_id")
    made = F.when(doc % 7 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), doc.cast("string")))
    url = F.coalesce("page_url", made)
    key = F.coalesce(url, F.concat(F.lit("doc:"), doc.cast("string")))
    hours = ((doc * 11) % 10800).cast("int")
    return d.join(p, "doc_id", "left").select(
        doc.alias("position"),
        F.substring(F.sha2(key, 256), 1, 36).alias("id"),
        url.alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(doc % 11 == 0, F.lit("Unknown")).otherwise(F.col("source")).alias("publisher"),
        F.col("text").alias("full_text"),
        F.when(doc % 13 != 0, F.lit("2024-01-01").cast("timestamp_ntz")
               + F.make_dt_interval(F.lit(0), hours)).alias("date_published"),
        pick(doc, vocab.TRUST_TIERS).alias("trust_tier"),
        pick(doc, FIXTURE_TYPES).alias("source_type"),
        pick(doc, CONFIDENCES).alias("date_confidence"),
        pick(doc, vocab.CATEGORIES).alias("category"),
        "lang",
    )


cte("sources", f"""
  SELECT doc_id AS position,
         left(sha256(coalesce(url, 'doc:' || doc_id)), 36) AS id, url,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 11 = 0 THEN 'Unknown' ELSE source END AS publisher,
         text AS full_text,
         CASE WHEN doc_id % 13 <> 0
              THEN TIMESTAMP '2024-01-01' + to_hours(((doc_id * 11) % 10800)::INT) END AS date_published,
         {sql_pick('doc_id', vocab.TRUST_TIERS)} AS trust_tier,
         {sql_pick('doc_id', FIXTURE_TYPES)} AS source_type,
         {sql_pick('doc_id', CONFIDENCES)} AS date_confidence,
         {sql_pick('doc_id', vocab.CATEGORIES)} AS category, lang
  FROM (SELECT d.*, coalesce(p.url, CASE WHEN d.doc_id % 7 = 0 THEN NULL
               ELSE 'https://' || d.source || '.example.org/doc/' || d.doc_id END) AS url
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)""")


def sql_any(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def sql_labels(text: str, table_: dict) -> str:
    """List of the rule names with a phrase in the text."""
    cases = ", ".join(f"CASE WHEN {sql_any(text, ps)} THEN '{name}' END" for name, ps in table_.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_map(expr: str, table_: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN " + (str(v) if isinstance(v, int) else sql_list(v) if isinstance(v, list)
                                            else "'" + v.replace("'", "''") + "'") for k, v in table_.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def sql_canonical_url(u: str, params, lower: bool = True, strip: bool = True) -> str:
    full = f"regexp_replace(trim({u}), '#.*$', '', 's')"
    base = f"split_part({full}, '?', 1)"
    rooted = f"CASE WHEN regexp_matches({base}, '^[^/]+://[^/]+$') THEN {base} || '/' ELSE {base} END"
    q = f"CASE WHEN contains({full}, '?') THEN substr({full}, strpos({full}, '?') + 1) ELSE '' END"
    kept = (f"array_to_string(list_filter(string_split({q}, '&'), "
            f"lambda x: NOT list_contains({sql_list(params)}, split_part(x, '=', 1))), '&')")
    out = f"({rooted}) || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"
    if strip:
        out = f"regexp_replace({out}, '/$', '')"
    valid = f"regexp_matches(trim({u}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')"
    if lower:
        return f"CASE WHEN {valid} THEN lower({out}) ELSE lower(trim({u})) END"
    return f"CASE WHEN {valid} THEN {out} ELSE {u} END"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with tags by the test rules."""
    s = sources(spark, sf)
    s = s.withColumn("_text", rules.lower_text(F.col("title"), F.lit(""), F.col("full_text")))
    return s.withColumn("tags", rules.labels("_text", TEST_TAGS)).drop("_text")


cte("tagged", f"""
  SELECT s.* EXCLUDE (low), {sql_labels('low', TEST_TAGS)} AS tags
  FROM (SELECT *, lower(coalesce(title, '') || '  ' || coalesce(full_text, '')) AS low FROM sources) s""",
    ["sources"])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _tag_struct(rows, index: Column, conf: Column, kind: str) -> Column:
    tag = pick(index, [r[0] for r in rows])
    ref = pick(index, [r[3] for r in rows])
    fields = [tag.alias("tag"), ref.alias("framework_ref"), conf.alias("confidence")]
    if kind == "framework":
        fields.insert(1, pick(index, [r[5] for r in rows]).alias("category_candidate"))
    return F.struct(*fields)


def understood(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged sources with landed enrichment results: tag arrays, claims, numbers, candidates."""
    s = tagged(spark, sf)
    p = F.col("position")
    conf = lambda c: pick(c, ["high", "medium", "low"])
    none = lambda typ: F.array().cast(f"array<struct<{typ}>>")
    fw_t = "tag:string,category_candidate:string,framework_ref:string,confidence:string"
    am_t = "tag:string,framework_ref:string,confidence:string"
    cand_t = "category:string,confidence:string,supporting_tags:array<string>"
    fw = F.concat(
        F.when(p % 4 != 3, F.array(_tag_struct(FRAMEWORK_TAGS, p, conf(p), "framework"))).otherwise(none(fw_t)),
        F.when(p % 3 == 0, F.array(_tag_struct(FRAMEWORK_TAGS, p * 7 + 3, conf(p + 1), "framework")))
        .otherwise(none(fw_t)))
    am = F.when(p % 4 == 0, F.array(_tag_struct(ATTACK_TAGS, p, conf(p), "attack"))).otherwise(none(am_t))
    gt = F.when(p % 10 == 0, F.array(_tag_struct(GOVERNANCE_TAGS, p, conf(p), "governance"))).otherwise(none(am_t))
    cand = F.concat(
        F.when(p % 4 != 0, F.array(F.struct(
            F.col("category"), conf(p).alias("confidence"), F.slice("tags", 1, 1).alias("supporting_tags"))))
        .otherwise(none(cand_t)),
        F.when(p % 6 == 1, F.array(F.struct(
            pick(p + 1, vocab.CATEGORIES).alias("category"), conf(p).alias("confidence"),
            F.col("tags").alias("supporting_tags")))).otherwise(none(cand_t)))
    numbers = F.regexp_extract_all("full_text", F.lit(r"[0-9]+"), F.lit(0))
    return s.withColumns({
        "framework_tags": fw, "attack_mappings": am, "governance_tags": gt,
        "category_candidates": cand,
        "main_claims": F.when(p % 3 > 0, F.split("full_text", "\n")).otherwise(F.array().cast("array<string>")),
        "important_numbers": numbers,
        "key_entities": F.array(F.col("publisher"), F.col("lang")),
        "source_summary": F.concat(F.col("title"), F.lit(". Published by "), F.col("publisher"), F.lit(".")),
    })


def _sql_tag(rows, index: str, conf: str, framework: bool) -> str:
    extra = f", category_candidate: {sql_pick(index, [r[5] for r in rows])}" if framework else ""
    return ("{" + f"tag: {sql_pick(index, [r[0] for r in rows])}{extra}, "
            f"framework_ref: {sql_pick(index, [r[3] for r in rows])}, confidence: {conf}" + "}")


_C = ["high", "medium", "low"]
cte("understood", f"""
  SELECT t.*,
    list_concat(CASE WHEN position % 4 <> 3 THEN [{_sql_tag(FRAMEWORK_TAGS, 'position', sql_pick('position', _C), True)}] ELSE [] END,
                CASE WHEN position % 3 = 0 THEN [{_sql_tag(FRAMEWORK_TAGS, 'position * 7 + 3', sql_pick('position + 1', _C), True)}] ELSE [] END) AS framework_tags,
    CASE WHEN position % 4 = 0 THEN [{_sql_tag(ATTACK_TAGS, 'position', sql_pick('position', _C), False)}] ELSE [] END AS attack_mappings,
    CASE WHEN position % 10 = 0 THEN [{_sql_tag(GOVERNANCE_TAGS, 'position', sql_pick('position', _C), False)}] ELSE [] END AS governance_tags,
    list_concat(CASE WHEN position % 4 <> 0 THEN [{{category: category, confidence: {sql_pick('position', _C)}, supporting_tags: tags[1:1]}}] ELSE [] END,
                CASE WHEN position % 6 = 1 THEN [{{category: {sql_pick('position + 1', vocab.CATEGORIES)}, confidence: {sql_pick('position', _C)}, supporting_tags: tags}}] ELSE [] END) AS category_candidates,
    CASE WHEN position % 3 > 0 THEN string_split(full_text, chr(10)) ELSE [] END AS main_claims,
    regexp_extract_all(full_text, '[0-9]+') AS important_numbers,
    [publisher, lang] AS key_entities,
    title || '. Published by ' || publisher || '.' AS source_summary
  FROM tagged t""", ["tagged"])


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Report sections: one per document, with evidence call-outs and citations."""
    s = sources(spark, sf)
    other = s.select((F.col("position") - 13).alias("position"), F.col("id").alias("other_id"))
    s = s.join(other, "position", "left")
    p = F.col("position")

    def entry(evidence_id: Column) -> Column:
        return F.struct(
            evidence_id.alias("evidence_id"),
            F.when(p % 7 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
            F.when(p % 11 == 0, F.lit("")).otherwise(F.col("publisher")).alias("publisher"),
            F.when(p % 4 == 1, F.lit("")).otherwise(F.col("full_text")).alias("key_fact"))

    first = entry(F.concat(F.lit("raw_"), F.coalesce("other_id", F.lit("missing"))))
    second = entry(F.when(p % 10 == 0, F.lit("raw_unknown")).otherwise(F.concat(F.lit("raw_"), F.col("id"))))
    return s.select(
        p.alias("section_id"),
        pick(p, ["title", "category_content", "outlook", "appendix"]).alias("section_type"),
        F.col("title"),
        F.when(p % 19 == 0, F.lit("")).otherwise(F.col("title")).alias("headline"),
        F.split("full_text", "\n").alias("items"),
        F.when(p % 3 != 0, F.col("lang")).alias("notes"),
        F.slice(F.array(first, second), F.lit(1), (p % 3).cast("int")).alias("evidence"),
        F.when(p % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("publisher")).alias("citations"),
        F.when(p % 9 == 0, F.array("id")).otherwise(F.array().cast("array<string>")).alias("planned_ids"),
    )


def _sql_entry(evidence_id: str) -> str:
    return ("{" + f"evidence_id: {evidence_id}, title: CASE WHEN position % 7 = 0 THEN '' ELSE title END, "
            "publisher: CASE WHEN position % 11 = 0 THEN '' ELSE publisher END, "
            "key_fact: CASE WHEN position % 4 = 1 THEN '' ELSE full_text END}")


cte("sections", f"""
  SELECT position AS section_id,
    {sql_pick('position', ['title', 'category_content', 'outlook', 'appendix'])} AS section_type, title,
    CASE WHEN position % 19 = 0 THEN '' ELSE title END AS headline,
    string_split(full_text, chr(10)) AS items,
    CASE WHEN position % 3 <> 0 THEN lang END AS notes,
    [{_sql_entry("'raw_' || coalesce(other_id, 'missing')")},
     {_sql_entry("CASE WHEN position % 10 = 0 THEN 'raw_unknown' ELSE 'raw_' || id END")}][1:(position % 3)] AS evidence,
    CASE WHEN position % 5 = 0 THEN []::VARCHAR[] ELSE [publisher] END AS citations,
    CASE WHEN position % 9 = 0 THEN [id] ELSE []::VARCHAR[] END AS planned_ids
  FROM (SELECT s.*, o.id AS other_id FROM sources s LEFT JOIN sources o ON o.position = s.position + 13)""",
    ["sources"])


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Insights, early signals and outlooks: one claim per document."""
    s = sources(spark, sf)
    p = F.col("position")
    ids = F.concat(
        F.when(p % 6 == 5, F.array().cast("array<string>"))
        .when(p % 10 == 0, F.array(F.lit("raw_unknown"))).otherwise(F.array(F.concat(F.lit("raw_"), F.col("id")))),
        F.when((p % 2 == 0) & (p % 6 != 5),
               F.array(F.concat(F.lit("agg_"), F.col("category"), F.lit("_maturity"))))
        .otherwise(F.array().cast("array<string>")))
    return s.select(
        p.alias("claim_id"), "category", p.alias("position"),
        pick(p, ["insight", "early_signal", "outlook"]).alias("kind"),
        F.when(p % 8 == 0, F.substring("title", 1, 9)).otherwise(F.col("title")).alias("text"),
        F.when(p % 7 == 0, F.lit("short")).otherwise(F.col("full_text")).alias("implication"),
        pick(F.floor(p / 3), ["high", "medium", "low", "sure"]).alias("confidence"),
        pick(p, vocab.MATURITIES).alias("maturity"),
        pick(p, ["trend", "insight", "early_signal", "outlook", "guess"]).alias("claim_type"),
        pick(p, ["now", "3_6_months", "6_12_months", "later"]).alias("watch_window"),
        F.when(p % 3 != 0, F.col("full_text")).alias("note"),
        ids.alias("supporting_ids"),
    )


cte("claims", f"""
  SELECT position AS claim_id, category, position,
    {sql_pick('position', ['insight', 'early_signal', 'outlook'])} AS kind,
    CASE WHEN position % 8 = 0 THEN left(title, 9) ELSE title END AS text,
    CASE WHEN position % 7 = 0 THEN 'short' ELSE full_text END AS implication,
    {sql_pick('position // 3', ['high', 'medium', 'low', 'sure'])} AS confidence,
    {sql_pick('position', vocab.MATURITIES)} AS maturity,
    {sql_pick('position', ['trend', 'insight', 'early_signal', 'outlook', 'guess'])} AS claim_type,
    {sql_pick('position', ['now', '3_6_months', '6_12_months', 'later'])} AS watch_window,
    CASE WHEN position % 3 <> 0 THEN full_text END AS note,
    list_concat(CASE WHEN position % 6 = 5 THEN []::VARCHAR[] WHEN position % 10 = 0 THEN ['raw_unknown'] ELSE ['raw_' || id] END,
                CASE WHEN position % 2 = 0 AND position % 6 <> 5 THEN ['agg_' || category || '_maturity'] ELSE []::VARCHAR[] END) AS supporting_ids
  FROM sources""", ["sources"])
