"""Validation, classification, taxonomy, scoring, counts, rankings and dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cte, query
from catalog.views import (AS_OF, TEST_TAGS, as_of, claims, events, pick, sources, sql_any, sql_labels, sql_list, sql_map,
                           sql_pick, table, tagged, understood)
from catalog.q_functions import SQL_AGE
from catalog.q_stored import PRIORITIES, known, prioritised, with_hash
from strandline import vocab
from strandline.functions import rules
from strandline.operators import aggregate, classify, dossier, rank, score, taxonomy
from strandline.plans import analysis

join = lambda c: F.array_join(c, "|")
SAFE = "coalesce(url LIKE 'https:%', false)"
STATUS = "CASE WHEN coalesce(url, '') = '' THEN 'missing' WHEN url LIKE 'https:%' THEN 'safe' ELSE 'unsafe_protocol' END"
NO_PUB = "(publisher = '' OR publisher = 'Unknown')"

# --- validity and typing --------------------------------------------------------
cte("structural", f"""
  SELECT position, CASE WHEN title_ok AND {SAFE} THEN greatest(0, least(100, 50 - CASE WHEN {NO_PUB} THEN 10 ELSE 0 END
      - CASE WHEN date_published IS NULL THEN 15 WHEN date_confidence = 'low' THEN 5 WHEN date_confidence = 'none' THEN 8 ELSE 0 END
      + CASE WHEN n >= 500 THEN 15 WHEN n >= 50 THEN 5 ELSE -5 END)) ELSE 0 END::INT AS score,
    CASE WHEN NOT title_ok THEN 'Missing title' WHEN coalesce(url, '') = '' THEN 'Missing URL' WHEN NOT {SAFE} THEN 'Unsafe URL (unsafe_protocol)'
      ELSE array_to_string(list_filter([CASE WHEN {NO_PUB} THEN 'Missing publisher' END, CASE WHEN date_published IS NULL THEN 'Missing publication date' END,
        CASE WHEN n < 50 THEN 'Limited text available' END], lambda x: x IS NOT NULL), '|') END AS warnings, trust_tier
  FROM (SELECT *, trim(title) <> '' AS title_ok, length(full_text) AS n FROM sources)""", ["sources"])


@query("structural_validity", f"""SELECT position, score AS structural_validity_score, {sql_map('trust_tier', vocab.PUBLISHER_TRUST, '2')}::INT AS publisher_trust_score,
  CASE WHEN score >= 80 THEN 'primary' WHEN score >= 65 THEN 'high_trust' WHEN score >= 45 THEN 'medium_trust' WHEN score >= 25 THEN 'low_trust' ELSE 'do_not_use' END AS credibility_label,
  warnings, score >= 25 AS usable FROM structural""", ["structural"])
def _(spark, sf):
    return classify.structural_validity(sources(spark, sf)).select(
        "position", "structural_validity_score", "publisher_trust_score", "credibility_label", join("warnings").alias("warnings"), "usable")


TEXT_Q = (f"(CASE WHEN n >= 500 THEN 60 WHEN n >= 100 THEN 35 WHEN n >= 50 THEN 15 ELSE 3 END + CASE WHEN length(title) >= 20 THEN 15 ELSE 0 END "
          f"+ CASE WHEN {NO_PUB} THEN 0 ELSE 10 END + CASE WHEN date_published IS NOT NULL THEN 5 ELSE 0 END)")
DENIED = ["src3", "paper.li"]
cte("gate_in", f"""
  SELECT *, CASE WHEN trim(title) = '' THEN 'missing_title' WHEN coalesce(url, '') = '' THEN 'missing_url' WHEN NOT {SAFE} THEN 'unsafe_url'
      WHEN contains(lower(publisher), 'src3') THEN 'denied_publisher:src3' WHEN contains(lower(publisher), 'paper.li') THEN 'denied_publisher:paper.li' END AS hard,
    list_filter([CASE WHEN {NO_PUB} THEN 'missing_publisher' END, CASE WHEN date_published IS NULL THEN 'no_publish_date' END,
      CASE WHEN year(date_published) < 2020 THEN 'date_before_2020' END, CASE WHEN n < 50 THEN 'short_text' END,
      CASE WHEN n >= 50 AND n < 200 THEN 'minimal_text' END, CASE WHEN regexp_matches(title, '^https?://') THEN 'title_is_url' END,
      CASE WHEN lower(title) IN ('untitled', 'no title') THEN 'generic_title' END,
      CASE WHEN s <> '' AND (length(s) - length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g'))) / length(s) > 0.3 THEN 'possible_non_english' END], lambda x: x IS NOT NULL) AS soft
  FROM (SELECT *, length(full_text) AS n, array_to_string(list_filter([title, full_text], lambda x: x <> ''), ' ') AS s FROM tagged)""", ["tagged"])
cte("gate", f"""
  SELECT *, hard IS NOT NULL AS hard_fail, CASE WHEN hard IS NOT NULL THEN [hard] ELSE soft END AS filter_flags,
    hard IS NULL AND NOT list_has_any(soft, ['short_text', 'title_is_url']) AS is_valid,
    CASE WHEN hard = 'missing_title' THEN 'Missing title' WHEN hard = 'missing_url' THEN 'Missing URL' WHEN hard = 'unsafe_url' THEN 'Unsafe URL: ' || url
      WHEN hard IS NOT NULL THEN 'Excluded publisher: ' || hard WHEN len(soft) = 0 THEN 'ok' ELSE array_to_string(soft, '; ') END AS validity_reason,
    CASE WHEN hard = 'missing_title' THEN 0 ELSE {TEXT_Q} END::INT AS text_quality_score FROM gate_in""", ["gate_in"])


@query("validity_gate", "SELECT position, hard_fail, is_valid, validity_reason, array_to_string(filter_flags, '|') AS filter_flags, text_quality_score FROM gate", ["gate"])
def _(spark, sf):
    return classify.validity_gate(tagged(spark, sf), DENIED).select(
        "position", "hard_fail", "is_valid", "validity_reason", join("filter_flags").alias("filter_flags"), "text_quality_score")


@query("text_quality", f"SELECT position, least(100, {TEXT_Q})::INT AS text_quality_score FROM (SELECT *, length(full_text) AS n FROM sources)", ["sources"])
def _(spark, sf):
    s = sources(spark, sf)
    return s.select("position", classify.text_quality(s).alias("text_quality_score"))


def _sql_signals(signals: dict) -> str:
    def part(level, cap, w):
        return "least(" + " + ".join(f"contains(s, '{p}')::INT" for p in signals[level]) + f", {cap}) * {w}"
    return f"({part('high', 5, 14)} + {part('medium', 3, 8)} + {part('low', 2, 3)})"


cte("relevance", f"""
  SELECT *, least(100, ai + least(15, floor(cyber * 0.15 + 0.5)::INT))::INT AS spec
  FROM (SELECT position, {_sql_signals(vocab.AI_SIGNALS)}::INT AS ai, {_sql_signals(vocab.CYBER_SIGNALS)}::INT AS cyber
        FROM (SELECT position, lower(array_to_string(list_filter([title, full_text], lambda x: x <> ''), ' ')) AS s FROM sources))""", ["sources"])
SQL_TIER = "CASE WHEN spec >= 40 THEN 'core' WHEN spec >= 20 THEN 'adjacent' WHEN spec >= 10 THEN 'peripheral' ELSE 'off_topic' END"


@query("ai_relevance", f"SELECT position, ai AS ai_relevance_score, cyber AS cyber_relevance_score, spec AS ai_specificity_score, {SQL_TIER} AS relevance_tier FROM relevance", ["relevance"])
def _(spark, sf):
    return classify.ai_relevance(sources(spark, sf)).select(
        "position", "ai_relevance_score", "cyber_relevance_score", "ai_specificity_score", "relevance_tier")


TEXT_RULES = [("incident", ["thst"], []), ("research_finding", ["elle", "tion"], ["und "]), ("ecosystem_signal", ["und", "der"], [])]
TAG_TYPES = {"the": "incident", "los": "governance_signal"}


def typed_input(spark, sf):
    """Tagged sources whose type is kept, legacy, or missing; some come from a known connector."""
    p = F.col("position")
    return tagged(spark, sf).withColumns({
        "source_type": F.when(p % 3 == 0, F.col("source_type")).when(p % 3 == 1, F.lit("novel_type")),
        "connector_id": F.when(p % 10 == 1, F.lit("arxiv_feed"))})


cte("typed", f"""
  SELECT position, st AS original_source_type, CASE WHEN list_contains({sql_list(vocab.ALL_SOURCE_TYPES)}, st) THEN ['existing', 'high', st]
      WHEN st = 'social_signal' THEN ['legacy_map', 'medium', 'research_finding'] WHEN position % 10 = 1 THEN ['connector_origin', 'high', 'research_finding']
      WHEN len(t) > 0 THEN ['tag_signal', 'medium', CASE t[1] WHEN 'the' THEN 'incident' ELSE 'governance_signal' END]
      WHEN contains(s, 'thst') THEN ['text_signal', 'low', 'incident']
      WHEN (contains(s, 'elle') OR contains(s, 'tion')) AND NOT contains(s, 'und ') THEN ['text_signal', 'low', 'research_finding']
      WHEN contains(s, 'und') OR contains(s, 'der') THEN ['text_signal', 'low', 'ecosystem_signal'] ELSE ['fallback', 'low', 'unknown'] END AS d
  FROM (SELECT *, CASE position % 3 WHEN 0 THEN source_type WHEN 1 THEN 'novel_type' END AS st, list_filter(tags, lambda x: x IN ('the', 'los')) AS t,
          lower(array_to_string(list_filter([title, full_text], lambda x: x <> ''), ' ')) AS s FROM tagged)""", ["tagged"])


@query("source_type_rules", "SELECT position, d[3] AS source_type, d[2] AS source_type_confidence, d[1] AS source_type_reason FROM typed", ["typed"])
def _(spark, sf):
    return classify.source_type_rules(typed_input(spark, sf), TEXT_RULES, TAG_TYPES).select(
        "position", "source_type", "source_type_confidence", "source_type_reason")


TRUST = [("src1", "primary"), ("src2", "high")]
cte("trusted", f"""SELECT position, tier, reason, {sql_map('tier', vocab.TIER_CREDIBILITY, '1')}::INT AS cred FROM (
  SELECT position, CASE WHEN trust_tier <> 'unknown' THEN trust_tier WHEN contains(publisher, 'src1') THEN 'primary' WHEN contains(publisher, 'src2') THEN 'high' ELSE 'medium' END AS tier,
    CASE WHEN trust_tier <> 'unknown' THEN 'connector_assigned' WHEN contains(publisher, 'src1') THEN 'publisher_match:src1' WHEN contains(publisher, 'src2') THEN 'publisher_match:src2' ELSE 'default_unknown' END AS reason
  FROM sources)""", ["sources"])


@query("trust_assess", "SELECT position, tier AS trust_tier, cred AS source_credibility_score, tier || ' tier (' || reason || '); score=' || cred AS credibility_reason FROM trusted", ["trusted"])
def _(spark, sf):
    return classify.trust_assess(sources(spark, sf), TRUST).select("position", "trust_tier", "source_credibility_score", "credibility_reason")


def layered(spark, sf, exempt=("primary", "high")):
    return classify.classify_layer(tagged(spark, sf), exempt_tiers=exempt)


# With the default deny list and trust rules: the fixture publishers match neither.
cte("layer", f"""
  SELECT *, CASE WHEN status = 'reject' THEN 'discard' WHEN status = 'review' THEN 'layer4_with_review' ELSE 'layer4' END AS route FROM (
  SELECT position, flags, st, original, tier, spec, {SQL_TIER} AS rel, CASE WHEN NOT valid THEN 'reject'
      WHEN spec < 10 AND tier IN ('primary', 'high') THEN 'review' WHEN spec < 10 THEN 'reject'
      WHEN list_has_any(flags, ['missing_publisher', 'possible_non_english', 'date_before_2020', 'minimal_text', 'no_publish_date']) OR st = 'unknown' THEN 'review' ELSE 'pass' END AS status,
    CASE WHEN valid AND spec < 10 AND tier IN ('primary', 'high') THEN 'off_topic_but_trusted: ai_specificity=' || spec || '; trust=' || tier
      WHEN valid AND spec < 10 THEN 'off_topic: ai_specificity=' || spec ELSE reason END AS reason
  FROM (SELECT position, source_type AS original, CASE source_type WHEN 'social_signal' THEN 'research_finding' ELSE source_type END AS st,
      CASE trust_tier WHEN 'unknown' THEN 'medium' ELSE trust_tier END AS tier, spec,
      CASE WHEN h IS NOT NULL THEN [h] ELSE soft END AS flags, h IS NULL AND NOT list_has_any(soft, ['short_text', 'title_is_url']) AS valid,
      CASE WHEN h = 'missing_title' THEN 'Missing title' WHEN h = 'missing_url' THEN 'Missing URL' WHEN h = 'unsafe_url' THEN 'Unsafe URL: ' || url
        WHEN len(soft) = 0 THEN 'ok' ELSE array_to_string(soft, '; ') END AS reason
    FROM (SELECT *, CASE WHEN hard LIKE 'denied%' THEN NULL ELSE hard END AS h FROM gate_in) JOIN relevance USING (position)))""", ["gate_in", "relevance"])


@query("final_gate", "SELECT position, status AS gate_status, reason AS final_validity_reason, route AS downstream_route FROM layer", ["layer"])
def _(spark, sf):
    return layered(spark, sf).select("position", "gate_status", "final_validity_reason", "downstream_route")


@query("classify_layer", "SELECT position, st AS source_type, tier AS trust_tier, rel AS relevance_tier, array_to_string(flags, '|') AS filter_flags, status AS gate_status FROM layer", ["layer"])
def _(spark, sf):
    return layered(spark, sf).select("position", "source_type", "trust_tier", "relevance_tier", join("filter_flags").alias("filter_flags"), "gate_status")


@query("gate_stats", """SELECT 'status' AS kind, status AS key, count(*) AS count FROM layer GROUP BY status
  UNION ALL SELECT 'reject_flag', f, count(*) FROM (SELECT unnest(flags) AS f FROM layer WHERE status = 'reject') GROUP BY f""", ["layer"])
def _(spark, sf):
    return classify.gate_stats(layered(spark, sf))


@query("type_change_stats", """
  SELECT kind, key, count(*) AS count FROM (
    SELECT 'source_type' AS kind, st AS key FROM layer UNION ALL SELECT 'reason', CASE WHEN st = original THEN 'existing' ELSE 'legacy_map' END FROM layer
    UNION ALL SELECT 'trust_tier', tier FROM layer UNION ALL SELECT 'relevance_tier', rel FROM layer UNION ALL SELECT 'status', status FROM layer
    UNION ALL SELECT 'flag', unnest(flags) FROM layer UNION ALL SELECT 'changed', 'source_type' FROM layer WHERE st <> original) GROUP BY kind, key""", ["layer"])
def _(spark, sf):
    return classify.type_change_stats(layered(spark, sf))


cte("validated", f"""
  SELECT position, stop, dup, CASE WHEN stop THEN [hard] ELSE list_filter([dup, CASE WHEN {NO_PUB} THEN 'missing_publisher' END,
      CASE WHEN date_published IS NULL THEN 'no_publish_date' END, CASE WHEN length(full_text) < 50 THEN 'insufficient_text' END,
      CASE WHEN spec < 10 AND trust_tier IN ('primary', 'high', 'curated') THEN 'low_relevance_authoritative' END,
      CASE WHEN spec < 10 AND trust_tier NOT IN ('primary', 'high', 'curated') THEN 'low_ai_cyber_relevance' END], lambda x: x IS NOT NULL) END AS flags
  FROM (SELECT s.*, spec, CASE WHEN trim(title) = '' THEN 'missing_title' WHEN coalesce(url, '') = '' THEN 'missing_url' ELSE 'unsafe_url' END AS hard,
          trim(title) = '' OR NOT {SAFE} AS stop,
          CASE WHEN s.id IN (SELECT id FROM known) THEN 'duplicate_id' WHEN sha256(full_text) IN (SELECT h FROM known) THEN 'duplicate_content' END AS dup
        FROM sources s JOIN relevance USING (position))""", ["known", "relevance"])
SQL_VALID = "NOT list_has_any(flags, ['missing_title', 'missing_url', 'unsafe_url', 'duplicate_id', 'duplicate_content', 'low_ai_cyber_relevance'])"


@query("validate_known", f"SELECT position, array_to_string(flags, '|') AS validation_flags, NOT stop AND dup IS NOT NULL AS is_duplicate, {SQL_VALID} AS is_valid FROM validated", ["validated"])
def _(spark, sf):
    return classify.validate_known(with_hash(spark, sf), known(spark, sf)).select(
        "position", join("validation_flags").alias("validation_flags"), "is_duplicate", "is_valid")


@query("validation_split", f"""SELECT CASE WHEN NOT stop AND dup IS NOT NULL THEN 'duplicate' WHEN {SQL_VALID} THEN 'valid' ELSE 'invalid' END AS bucket, count(*) AS count
  FROM validated GROUP BY 1""", ["validated"])
def _(spark, sf):
    rows = classify.validation_split(classify.validate_known(with_hash(spark, sf), known(spark, sf)))
    return rows.groupBy("bucket").agg(F.count("*").alias("count"))


@query("quick_tags", "SELECT position, array_to_string(tags, '|') AS tags FROM tagged", ["tagged"])
def _(spark, sf):
    return classify.quick_tags(sources(spark, sf), TEST_TAGS).select("position", join("tags").alias("tags"))


def _recent(n: int) -> str:
    return f"coalesce(date_confidence <> 'none' AND date_published > TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY, false)"


@query("eligibility", f"""
  SELECT position, {_recent(1)} AS eligible_for_daily_report, {_recent(7)} AS eligible_for_weekly_report, {_recent(30)} AS eligible_for_monthly_report,
    {_recent(365)} AS eligible_for_horizon_scan, true AS eligible_for_archive, length(full_text) > 200 AS eligible_for_trend_analysis,
    trust_tier IN ('curated', 'primary', 'high') AS eligible_for_reference_context,
    date_confidence IN ('none', 'low') OR source_type = 'unknown' OR publisher = '' OR date_published IS NULL AS needs_review FROM sources""", ["sources"])
def _(spark, sf):
    cols = ["daily_report", "weekly_report", "monthly_report", "horizon_scan", "archive", "trend_analysis", "reference_context"]
    return classify.eligibility(sources(spark, sf), as_of()).select("position", *[f"eligible_for_{c}" for c in cols], "needs_review")


KEYWORDS = [("llm_threats", ["thst", "und"]), ("agentic_ai_threats", ["elle"]), ("ai_enabled_threats", [" los "])]
SQL_GUESS = "CASE " + " ".join(f"WHEN {sql_any('low', ps)} THEN '{n}'" for n, ps in KEYWORDS) + " END"


@query("guess_category", f"SELECT position, {SQL_GUESS} AS category FROM (SELECT position, lower(title || ' ' || full_text) AS low FROM sources)", ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("position", classify.guess_category(F.col("title"), F.col("full_text"), KEYWORDS).alias("category"))


@query("understand_fallback", f"""SELECT position, title || '. Published by ' || publisher || '.' AS source_summary, left(title, 80) AS primary_subject,
  publisher AS key_entities, {SQL_GUESS} AS candidate, 'taxonomy-v6.0' AS taxonomy_version FROM (SELECT *, lower(title || ' ' || full_text) AS low FROM sources)""", ["sources"])
def _(spark, sf):
    return classify.understand_fallback(sources(spark, sf), KEYWORDS).select(
        "position", "source_summary", "primary_subject", join("key_entities").alias("key_entities"),
        F.get("category_candidates", F.lit(0))["category"].alias("candidate"), "taxonomy_version")


@query("understand_counts", """SELECT count(*) AS total, count_if(position % 4 = 0)::BIGINT AS already_done,
  count_if(position % 4 <> 0 AND position % 3 = 0)::BIGINT AS processed_by_model, count_if(position % 4 <> 0 AND position % 3 <> 0)::BIGINT AS fallback FROM sources""", ["sources"])
def _(spark, sf):
    p = F.col("position")
    return classify.understand_counts(sources(spark, sf).withColumns({
        "previous_version": F.when(p % 4 == 0, F.lit(vocab.TAXONOMY_VERSION)).otherwise(F.lit("taxonomy-v5.0")), "llm_used": p % 3 == 0}))


def picked(spark, sf):
    p = F.col("position")
    rows = understood(spark, sf).withColumns({
        "main_category": F.col("category"), "llm_used": p % 2 == 0,
        "classify_version": F.when(p % 20 == 5, F.lit(vocab.CLASSIFY_VERSION)),
        "classification_confidence": F.when(p % 20 == 5, F.lit("high"))})
    return classify.pick_category(rows).withColumn("already_done", p % 20 == 5)


RANK = "CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE {d} END"
cte("cand", f"""SELECT position, arg_min(c.category, o) AS category, arg_min(c.confidence, o) AS confidence FROM (
  SELECT position, c, -{RANK.format(c='c.confidence', d=0)} * 10000 - len(c.supporting_tags) * 100 + i AS o
  FROM (SELECT position, unnest(category_candidates) AS c, generate_subscripts(category_candidates, 1) AS i FROM understood)) GROUP BY position""", ["understood"])
cte("fwtags", f"""SELECT position, arg_min(cat, o) AS category, CASE arg_min(r, o) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT position, cat, max(r) AS r, -count(*) * 10000 - max(r) * 100 + min(i) AS o FROM (
    SELECT position, t.category_candidate AS cat, {RANK.format(c='t.confidence', d=1)} AS r, i
    FROM (SELECT position, unnest(framework_tags) AS t, generate_subscripts(framework_tags, 1) AS i FROM understood)) GROUP BY position, cat) GROUP BY position""", ["understood"])
cte("picked", f"""
  SELECT position, position % 20 = 5 AS done,
    CASE WHEN position % 20 = 5 OR keep THEN category ELSE coalesce(c3, 'unclear_or_adjacent') END AS main_category,
    CASE WHEN position % 20 = 5 THEN 'high' WHEN keep THEN 'low' ELSE coalesce(f3, 'none') END AS confidence
  FROM (SELECT *, (c3 IS NULL OR f3 = 'low') AND category <> 'unclear_or_adjacent' AND position % 2 <> 0 AS keep FROM (
    SELECT *, CASE WHEN am THEN 'ai_enabled_threats' ELSE c2 END AS c3, CASE WHEN am THEN amc ELSE f2 END AS f3 FROM (
      SELECT *, (c2 IS NULL OR f2 = 'low') AND amc IN ('high', 'medium') AS am FROM (
        SELECT u.position, u.category, CASE WHEN b THEN w.category ELSE k.category END AS c2, CASE WHEN b THEN w.confidence ELSE k.confidence END AS f2, amc FROM (
          SELECT position, category, attack_mappings[1].confidence AS amc FROM understood) u
        LEFT JOIN cand k USING (position) LEFT JOIN (SELECT *, confidence IN ('high', 'medium') AS strong FROM fwtags) w USING (position),
        LATERAL (SELECT coalesce((k.category IS NULL OR k.confidence = 'low') AND w.strong, false) AS b)))))""", ["understood", "cand", "fwtags"])


@query("pick_category", "SELECT position, main_category, confidence AS classification_confidence FROM picked", ["picked"])
def _(spark, sf):
    return picked(spark, sf).select("position", "main_category", "classification_confidence")


@query("classify_distribution", """SELECT 'category' AS kind, main_category AS key, count(*) AS count FROM picked GROUP BY 2
  UNION ALL SELECT 'confidence', confidence, count(*) FROM picked GROUP BY 2
  UNION ALL SELECT 'state', CASE WHEN done THEN 'already_done' ELSE 'newly_done' END, count(*) FROM picked GROUP BY 2""", ["picked"])
def _(spark, sf):
    return classify.classify_distribution(picked(spark, sf))


@query("tags_by_category", f"""SELECT category, array_to_string(list_sort(list(DISTINCT tag)), '|') AS tags, array_to_string(list_sort(list(DISTINCT fw)), '|') AS frameworks FROM (
  SELECT category, tag, {sql_map('tag', {r[0]: r[2] for r in vocab.registry_rows()})} AS fw FROM (SELECT category, unnest(framework_tags).tag AS tag FROM understood)) GROUP BY category""", ["understood"])
def _(spark, sf):
    return classify.tags_by_category(understood(spark, sf), classify.registry(spark))


# --- taxonomy -------------------------------------------------------------------
def _or(lst: str, default: str) -> str:
    return f"CASE WHEN len({lst}) > 0 THEN {lst} ELSE ['{default}'] END"


cte("rawfact", f"""
  SELECT *, list_filter(all_t, lambda x, i: list_position(all_t, x) = i) AS rawfact_tags,
    {_or(sql_labels('low', vocab.SECTOR_RULES), 'cross_sector')} AS sector, {sql_labels('low', vocab.GEOGRAPHY_RULES)} AS geography,
    {sql_labels('low', vocab.TECHNOLOGY_RULES)} AS technology, {_or(sql_labels('low', vocab.IMPACT_TYPE_RULES), 'security')} AS impact_types,
    {sql_map('source_type', vocab.TYPE_RELEVANCE, "'medium'")} AS operational_relevance,
    CASE WHEN {sql_any('low', vocab.NOVELTY_NEW)} THEN 'new_tactic' WHEN {sql_any('low', vocab.NOVELTY_SCALE)} THEN 'known_tactic_new_scale' ELSE 'unknown' END AS novelty
  FROM (SELECT *, lower(title || ' ' || full_text) AS low, list_concat(list_concat(tags, list_transform(framework_tags, lambda x: x.tag)),
          list_transform(attack_mappings, lambda x: x.tag)) AS all_t FROM understood)""", ["understood"])


@query("rawfact_taxonomy", """SELECT position, array_to_string(rawfact_tags, '|') AS rawfact_tags, array_to_string(sector, '|') AS sector, array_to_string(geography, '|') AS geography,
  array_to_string(technology, '|') AS technology, array_to_string(impact_types, '|') AS impact_types, operational_relevance, novelty FROM rawfact""", ["rawfact"])
def _(spark, sf):
    arrays = ["rawfact_tags", "sector", "geography", "technology", "impact_types"]
    return taxonomy.rawfact_taxonomy(understood(spark, sf)).select(
        "position", *[join(a).alias(a) for a in arrays], "operational_relevance", "novelty")


@query("default_context", """SELECT position, CASE source_type WHEN 'vulnerability' THEN 'unknown' END AS exploitability,
  CASE source_type WHEN 'incident' THEN 'unclear' END AS confirmed_impact, CASE WHEN source_type IN ('exploit_disclosure', 'capability_demonstration') THEN 'unknown' END AS required_access,
  CASE source_type WHEN 'infrastructure_dependency_signal' THEN false END AS known_exploits, CASE WHEN source_type IN ('defensive_capability', 'benchmark_evaluation') THEN 0 END::INT AS limitations
  FROM sources""", ["sources"])
def _(spark, sf):
    c = F.col("c")
    return sources(spark, sf).withColumn("c", taxonomy.default_context("source_type")).select(
        "position", c["exploitability"].alias("exploitability"), c["confirmed_impact"].alias("confirmed_impact"),
        c["required_access"].alias("required_access"), c["known_exploits"].alias("known_exploits"),
        F.when(c["limitations"].isNotNull(), F.size(c["limitations"])).alias("limitations"))


@query("feed_taxonomy", f"""
  SELECT position, array_to_string(list_filter(ft, lambda x, i: list_position(ft, x) = i), '|') AS feed_tags,
    array_to_string({_or(sql_labels('low', vocab.FEED_IMPACT_TYPE_RULES), 'security')}, '|') AS impact_types,
    {sql_map('source_type', vocab.FEED_TYPE_SCOPE, "'organization'")} AS impact_scope, {sql_map('source_type', vocab.FEED_TYPE_SEVERITY, "'unknown'")} AS impact_severity,
    {sql_map('source_type', vocab.FEED_TYPE_RELEVANCE, "'medium'")} AS operational_relevance,
    CASE WHEN {sql_any('low', vocab.NOVELTY_NEW)} THEN 'new_tactic' WHEN {sql_any('low', vocab.FEED_NOVELTY_SCALE)} THEN 'known_tactic_new_scale' ELSE 'known_tactic' END AS novelty
  FROM (SELECT *, list_concat(list_concat(all_t, {sql_map('source_type', vocab.FEED_TYPE_TAGS, '[]::VARCHAR[]')}),
          CASE WHEN source_type = 'vulnerability' AND contains(low, 'cve') THEN ['cve'] ELSE []::VARCHAR[] END) AS ft FROM rawfact)""", ["rawfact"])
def _(spark, sf):
    return taxonomy.feed_taxonomy(understood(spark, sf)).select(
        "position", join("feed_tags").alias("feed_tags"), join("impact_types").alias("impact_types"), "impact_scope", "impact_severity",
        "operational_relevance", "novelty")


CONFS = ["high", "medium", "low", "none"]


def base(spark, sf):
    """Understood sources with a stored classification confidence."""
    return understood(spark, sf).withColumn("classification_confidence", pick(F.floor(F.col("position") / 5), CONFS))


def analysed(spark, sf):
    return analysis.enrich(base(spark, sf), as_of())


def twice(spark, sf):
    return analysis.two_pass_score(base(spark, sf), as_of())


_V = sql_list(vocab.ATTACK_VECTORS)
_SURF = f"flatten(list_transform(technology, lambda x: {sql_map('x', vocab.TECH_SURFACES, '[]::VARCHAR[]')}))"
cte("analytics", f"""
  SELECT * EXCLUDE (av, su), {_or('av', 'unknown')} AS attack_vectors, {_or('su', 'unknown')} AS attack_surface,
    {sql_map('status', vocab.STATUS_MATURITY, "'unknown'")} AS maturity,
    list_filter([CASE WHEN len(su) > 0 OR len(technology) > 0 THEN 'attack_surface_expansion' END, CASE WHEN status IN ('active_operational_use', 'limited_operational_use') THEN 'operationalization' END,
      CASE WHEN source_type = 'adversary_adoption_signal' THEN 'adversary_ai_adoption' END, CASE WHEN source_type = 'trust_boundary_shift' THEN 'trust_boundary_failure' END,
      CASE WHEN source_type = 'infrastructure_dependency_signal' THEN 'dependency_growth' END, CASE WHEN source_type = 'governance_signal' THEN 'governance_pressure' END,
      CASE WHEN source_type = 'research_finding' AND status <> 'research_only' THEN 'research_to_threat_pipeline' END], lambda x: x IS NOT NULL) AS themes
  FROM (SELECT *, list_filter(v, lambda x, i: list_position(v, x) = i) AS av, list_filter(sf, lambda x, i: list_position(sf, x) = i) AS su,
      {sql_map('category', vocab.CATEGORY_LAYERS, "['unknown']")} AS ai_layer, {sql_map('category', vocab.CATEGORY_CLUSTERS, "['unknown']")} AS signal_clusters,
      {_or(sql_labels('low', vocab.ANALYTICS_IMPACT_RULES), 'unknown')} AS a_impact,
      CASE WHEN source_type = 'research_finding' AND {sql_any('low', vocab.POC_PHRASES)} THEN 'proof_of_concept' ELSE {sql_map('source_type', vocab.TYPE_STATUS, "'unknown'")} END AS status
    FROM (SELECT *, list_filter(list_transform(list_concat(list_concat(list_transform(framework_tags, lambda x: x.tag), list_transform(attack_mappings, lambda x: x.tag)), rawfact_tags),
            lambda x: replace(lower(x), '-', '_')), lambda x: list_contains({_V}, x)) AS v, {_SURF} AS sf FROM rawfact))""", ["rawfact"])
ANALYTICS = "(SELECT * EXCLUDE (themes), CASE WHEN len(themes) > 0 THEN themes ELSE ['unknown'] END AS recurring_themes FROM analytics)"


@query("analytics_taxonomy", f"""SELECT position, array_to_string(attack_vectors, '|') AS attack_vectors, array_to_string(attack_surface, '|') AS attack_surface,
  array_to_string(ai_layer, '|') AS ai_layer, status AS operational_status, maturity, array_to_string(a_impact, '|') AS analytics_impact_types,
  array_to_string(signal_clusters, '|') AS signal_clusters, array_to_string(recurring_themes, '|') AS recurring_themes,
  CASE WHEN trust_tier IN ('primary', 'curated', 'high') THEN 'high' WHEN trust_tier = 'medium' THEN 'medium' ELSE 'low' END AS analytics_confidence FROM {ANALYTICS}""", ["analytics"])
def _(spark, sf):
    arrays = ["attack_vectors", "attack_surface", "ai_layer", "analytics_impact_types", "signal_clusters", "recurring_themes"]
    return analysed(spark, sf).select("position", *[join(a).alias(a) for a in arrays], "operational_status", "maturity", "analytics_confidence")


# --- score ----------------------------------------------------------------------
NOV = "CASE novelty WHEN 'new_tactic' THEN {a} WHEN 'known_tactic_new_scale' THEN {b} ELSE 0 END"
# Points of the default contexts, worked out by hand per type.
SQL_TYPE = f"""CASE source_type
  WHEN 'vulnerability' THEN CASE WHEN list_has_any(technology, ['llm', 'ai_agent']) THEN 7 ELSE 4 END
  WHEN 'exploit_disclosure' THEN 0
  WHEN 'incident' THEN 2 + CASE WHEN list_has_any(sector, ['financial_services', 'healthcare', 'energy', 'government', 'defense']) THEN 7 ELSE 4 END
  WHEN 'threat_intelligence' THEN 2 + 6
  WHEN 'research_finding' THEN {NOV.format(a=8, b=5)} + 5
  WHEN 'defensive_capability' THEN 5 + 2
  WHEN 'governance_signal' THEN 3 + 2 + 3 + 2 + 5
  WHEN 'ecosystem_signal' THEN 3 + 5
  WHEN 'societal_harm_signal' THEN 2 + 2
  WHEN 'benchmark_evaluation' THEN CASE WHEN trust_tier IN ('primary', 'high') THEN 10 ELSE 5 END + 3 + 5 + 4
  WHEN 'strategic_signal' THEN 3 + 2 + 5
  WHEN 'capability_demonstration' THEN {NOV.format(a=10, b=6)} + 1 + 2
  WHEN 'adversary_adoption_signal' THEN 7
  WHEN 'infrastructure_dependency_signal' THEN 1 + 2
  WHEN 'trust_boundary_shift' THEN {NOV.format(a=9, b=6)} + 3 + 2
  ELSE 5 END"""
cte("scored", f"""
  SELECT *, cred + rel + conc + cit + rec AS common_base FROM (
  SELECT r.*, v.spec, {sql_map('trust_tier', vocab.SCORE_CREDIBILITY, '1')} AS cred,
    CASE WHEN category <> 'unclear_or_adjacent' AND conf = 'high' THEN greatest(8, least(10, floor(spec / 10.0 + 0.5)))
         WHEN category <> 'unclear_or_adjacent' AND conf = 'medium' THEN greatest(5, least(10, floor(spec / 10.0 + 0.5))) ELSE least(10, floor(spec / 10.0 + 0.5)) END::INT AS rel,
    least(10, len(main_claims) * 2 + CASE WHEN len(important_numbers) > 0 THEN 2 ELSE 0 END) AS conc,
    CASE WHEN trust_tier IN ('primary', 'curated') THEN 5 WHEN trust_tier = 'high' THEN 4 WHEN url IS NOT NULL THEN 2 ELSE 0 END AS cit,
    {SQL_AGE} AS rec, {SQL_TYPE} AS type_specific,
    CASE WHEN operational_relevance IN ('very_high', 'high') AND novelty = 'new_tactic' THEN 5 ELSE 0 END + CASE WHEN len(important_numbers) > 0 THEN 5 ELSE 0 END
      + CASE WHEN category <> 'unclear_or_adjacent' AND conf = 'high' THEN 5 ELSE 0 END AS bonus,
    CASE WHEN len(main_claims) = 0 THEN 10 ELSE 0 END + CASE WHEN spec < 20 AND category = 'unclear_or_adjacent' THEN 15 ELSE 0 END + CASE WHEN trust_tier = 'low' THEN 20 ELSE 0 END
      + CASE WHEN source_type = 'unknown' AND len(framework_tags) + len(attack_mappings) + len(governance_tags) = 0 THEN 10 ELSE 0 END AS pen
  FROM (SELECT *, {sql_pick('position // 5', CONFS)} AS conf FROM rawfact) r JOIN relevance v USING (position))""", ["rawfact", "relevance"])
cte("scored1", "SELECT *, greatest(0, least(100, common_base + type_specific + bonus - pen))::INT AS score1 FROM scored", ["scored"])


def _band(s: str) -> str:
    return f"CASE WHEN {s} >= 85 THEN 'must_read' WHEN {s} >= 70 THEN 'high' WHEN {s} >= 50 THEN 'medium' WHEN {s} >= 30 THEN 'low' ELSE 'archive_only' END"


@query("score_base", "SELECT position, cred::INT AS source_credibility, rel AS ai_relevance, conc::INT AS evidence_concreteness, cit::INT AS citation_quality, rec::INT AS recency, common_base::INT AS common_base FROM scored1", ["scored1"])
def _(spark, sf):
    return analysed(spark, sf).select("position", "source_credibility", "ai_relevance", "evidence_concreteness", "citation_quality", "recency", "common_base")


@query("score_type", "SELECT position, type_specific::INT AS type_specific FROM scored1", ["scored1"])
def _(spark, sf):
    return analysed(spark, sf).select("position", "type_specific")


@query("score_bonus_penalty", "SELECT position, bonus::INT AS horizon_bonus, pen::INT AS penalties FROM scored1", ["scored1"])
def _(spark, sf):
    return analysed(spark, sf).select("position", "horizon_bonus", "penalties")


@query("rawfact_score", f"""SELECT position, score1 AS rawfact_score, {_band('score1')} AS rawfact_priority,
  trust_tier || ' trust (' || cred || '/10), ' || replace(source_type, '_', ' ') || ' type (type=' || type_specific || '), '
    || CASE WHEN rel >= 8 THEN 'high' WHEN rel >= 5 THEN 'medium' ELSE 'low' END || ' AI relevance' || CASE WHEN bonus > 0 THEN ', horizon bonus +' || bonus ELSE '' END
    || CASE WHEN pen > 0 THEN ', penalties -' || pen ELSE '' END || ', op_relevance=' || operational_relevance AS scoring_reason FROM scored1""", ["scored1"])
def _(spark, sf):
    return analysed(spark, sf).select("position", "rawfact_score", "rawfact_priority", "scoring_reason")


def fed(spark, sf):
    return score.feed_score(classify.ai_relevance(classify.trust_assess(classify.validity_gate(base(spark, sf)))))


cte("fed", f"""
  SELECT u.*, least(100, {sql_map('t.tier', vocab.FEED_TIER_POINTS, '20')} + {sql_map('u.source_type', vocab.FEED_TYPE_POINTS, '8')}
    + floor(least(25, floor(spec * 25 / 100.0 + 0.5)) / 4.0 + 0.5)::INT + CASE WHEN category <> 'unclear_or_adjacent' AND conf NOT IN ('low', 'none') THEN 10 ELSE 0 END
    + t.cred * 2 - least(15, len(flags) * 3))::INT AS feed_score
  FROM (SELECT *, {sql_pick('position // 5', CONFS)} AS conf FROM understood) u JOIN relevance USING (position)
  JOIN (SELECT position, tier, {sql_map('tier', vocab.TIER_CREDIBILITY, '1')} AS cred, flags FROM layer) t USING (position)""", ["understood", "relevance", "layer"])
SQL_FEED = "CASE WHEN feed_score >= 80 THEN 'must_read' WHEN feed_score >= 65 THEN 'high' WHEN feed_score >= 45 THEN 'medium' WHEN feed_score >= 25 THEN 'low' ELSE 'archive_only' END"


@query("feed_score", f"SELECT position, feed_score, {SQL_FEED} AS feed_priority FROM fed", ["fed"])
def _(spark, sf):
    return fed(spark, sf).select("position", "feed_score", "feed_priority")


CARD = """left(title, 80) AS evidence_card_title, source_summary AS short_summary, array_to_string(main_claims, '|') AS key_facts,
  array_to_string(important_numbers, '|') AS numbers_statistics"""


def _cards(df):
    c = F.col("evidence_card")
    return df.where(c.isNotNull()).select("position", c["evidence_card_title"].alias("evidence_card_title"), c["short_summary"].alias("short_summary"),
                                          join(c["key_facts"]).alias("key_facts"), join(c["numbers_statistics"]).alias("numbers_statistics"))


@query("evidence_card", f"SELECT position, {CARD} FROM rawfact WHERE operational_relevance IN ('very_high', 'high')", ["rawfact"])
def _(spark, sf):
    return _cards(analysed(spark, sf))


@query("feed_evidence", f"SELECT position, {CARD} FROM fed WHERE feed_score >= 65", ["fed"])
def _(spark, sf):
    return _cards(score.feed_cards(fed(spark, sf)))


cte("cl2_meta", """SELECT component, count(*) AS n, arg_min(id, (-score1)::BIGINT * 1000000000 + position) AS rep_id, min(id) AS min_id
  FROM cl_nodes JOIN scored1 USING (position) GROUP BY component""", ["cl_nodes", "scored1"])
cte("scored2", """SELECT s.*, m.n AS cluster_size, m.component, m.n = 1 OR s.id = m.rep_id AS is_rep,
    greatest(0, least(100, common_base + type_specific + bonus - pen - CASE WHEN m.n > 1 AND s.id <> m.rep_id THEN 10 ELSE 0 END))::INT AS score2
  FROM scored1 s JOIN cl_nodes USING (position) JOIN cl2_meta m USING (component)""", ["cl2_meta"])


@query("two_pass_score", f"SELECT position, cluster_size, is_rep AS is_representative, score2 AS rawfact_score, {_band('score2')} AS rawfact_priority FROM scored2", ["scored2"])
def _(spark, sf):
    return twice(spark, sf).select("position", "cluster_size", "is_representative", "rawfact_score", "rawfact_priority")


@query("rawfact_counts", f"""SELECT count(*) AS total, count_if(operational_relevance IN ('very_high', 'high'))::BIGINT AS evidence_cards, count_if(b = 'must_read')::BIGINT AS must_read,
  count_if(b = 'high')::BIGINT AS high, count_if(b = 'medium')::BIGINT AS medium, count_if(b = 'low')::BIGINT AS low, count_if(b = 'archive_only')::BIGINT AS archive_only,
  count(DISTINCT component) AS clusters, count(DISTINCT CASE WHEN cluster_size > 1 THEN component END) AS multi_source_clusters FROM (SELECT *, {_band('score2')} AS b FROM scored2)""", ["scored2"])
def _(spark, sf):
    return analysis.rawfact_counts(twice(spark, sf))


@query("synthesis_counts", f"""SELECT count(*) AS total_sources, count_if(score2 >= 70)::BIGINT AS high_priority, count_if(operational_relevance IN ('very_high', 'high'))::BIGINT AS evidence_cards,
  count(DISTINCT CASE WHEN cluster_size > 1 THEN component END) AS clusters, (SELECT count(*) FROM claims WHERE kind = 'insight') AS insights,
  (SELECT count(*) FROM claims WHERE kind = 'early_signal') AS early_signals FROM scored2""", ["scored2", "claims"])
def _(spark, sf):
    return analysis.synthesis_counts(twice(spark, sf), claims(spark, sf))
