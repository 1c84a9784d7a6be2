"""Record scores.  Per-type scoring is a rule table of terms, compiled to one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules, times
from strandline.functions.rules import points
from strandline.runtime import cut_lineage

HML = ("high", "medium", "low")


def by(field: str, *pairs, **named) -> tuple:
    return ("value", field, {**dict(pairs), **named})


def hml(field: str, a: int, b: int, c: int) -> tuple:
    return ("value", field, dict(zip(HML, (a, b, c))))


def flag(field: str, yes: int, no: int = 0) -> tuple:
    return ("flag", field, yes, no)


def count(field: str, per: int, cap: int, base: int = 0) -> tuple:
    return ("count", field, per, cap, base)


def filled(field: str, some: int, none: int) -> tuple:
    return ("filled", field, some, none)


def fixed(n: int) -> tuple:
    return ("fixed", n)


CRITICAL_SECTORS = ["financial_services", "healthcare", "energy", "government", "defense"]
SEVERITY = by("@impact_severity", critical=10, high=8, medium=5, low=2, informational=1)


def novelty(*p: int) -> tuple:
    return ("value", "@novelty", dict(zip(vocab.NOVELTIES, p)))


# --- fixed values: points per source type -------------------------------------
# A field name is a context field; with @ it is a column of the record.
TYPE_TERMS: dict[str, list[tuple]] = {
    "vulnerability": [
        by("exploitability", very_high=10, high=8, medium=5, low=2), SEVERITY,
        by("blast_radius", **{"global": 8}, ecosystem=7, sector=5, product=3, local=1),
        ("any", "@technology", ["llm", "ai_agent"], 7, 4),
        by("exploit_status", exploited_in_the_wild=5, proof_of_concept=3, disclosed=1),
        by("defender_actionability", immediate=5, monitor=3, low=1)],
    "exploit_disclosure": [
        hml("reproducibility", 10, 6, 2), hml("operational_realism", 10, 6, 2), count("exploit_chain", 2, 8),
        by("required_access", none=7, user=5, privileged=2), flag("public_tooling_available", 5),
        hml("automation_potential", 5, 3, 1)],
    "incident": [
        by("confirmed_impact", confirmed=10, claimed=6, unclear=2),
        by("incident_scale", societal=8, ecosystem=7, sector=6, organization=4, individual=2),
        ("any", "@sector", CRITICAL_SECTORS, 7, 4), hml("repeatability", 7, 4, 1), flag("attacker_method", 5),
        by("institutional_response", yes=4, no=1, unknown=0), filled("known_losses_or_numbers", 4, 0)],
    "threat_intelligence": [
        hml("operational_confidence", 10, 6, 2), count("observed_ttps", 3, 10), hml("attribution_confidence", 7, 4, 1),
        filled("targeted_sectors", 6, 2), by("ai_role_in_operation", tool=6, target=5, operating_environment=4, unknown=0),
        fixed(6)],
    "research_finding": [
        novelty(10, 8, 5, 3, 1), hml("reproducibility", 8, 5, 2), hml("research_to_threat_potential", 10, 5, 1),
        count("systems_tested", 2, 7), ("fewer", "operationalization_barriers", 5), flag("defensive_implications", 5)],
    "defensive_capability": [
        flag("defensive_gap_addressed", 10), by("deployment_readiness", production=10, pilot=7, research=4, concept=2),
        by("coverage_scope", broad=8, moderate=5, narrow=2), by("evaluation_quality", strong=7, moderate=4, weak=1),
        fixed(5), filled("limitations", 5, 2)],
    "governance_signal": [
        flag("issuing_authority", 10, 3), count("affected_sectors", 2, 8, 2), flag("systemic_risk_recognized", 10, 3),
        flag("compliance_or_policy_implication", 7, 2), fixed(5), count("recommended_actions", 2, 5)],
    "ecosystem_signal": [
        by("adoption_signal", strong=10, moderate=6, weak=2), flag("infrastructure_or_platform", 10, 3),
        hml("downstream_security_impact", 8, 5, 2), hml("dependency_growth", 7, 4, 1),
        hml("attack_surface_growth", 5, 3, 1), fixed(5)],
    "societal_harm_signal": [
        SEVERITY, flag("affected_population", 8, 2),
        by("harm_scale", **{"global": 7}, national=6, institutional=5, community=3, individual=1),
        hml("repeatability", 7, 4, 1), by("institutional_response", yes=6, no=3, unknown=0),
        flag("trust_system_affected", 7, 2)],
    "benchmark_evaluation": [
        ("in", "@trust_tier", ["primary", "high"], 10, 5), flag("capability_measured", 10, 3),
        by("@impact_severity", critical=8, high=6, medium=4, low=2), hml("trajectory_signal", 8, 5, 2), fixed(5),
        filled("limitations", 2, 4)],
    "strategic_signal": [
        by("horizon_relevance", very_high=10, high=8, medium=5, low=2, none=0), flag("convergence_signal", 10, 3),
        flag("systemic_risk", 8, 2), count("supporting_examples", 2, 7), hml("confidence", 5, 3, 1), fixed(5)],
    "capability_demonstration": [
        novelty(12, 10, 6, 3, 1), hml("ease_of_replication", 10, 6, 2),
        by("required_access", none=8, user=6, privileged=3, unknown=1), flag("public_reproduction_available", 8),
        flag("defender_implications", 7, 2)],
    "adversary_adoption_signal": [
        by("observed_evidence", confirmed=12, claimed=7, inferred=4, unknown=1),
        by("spread_trajectory", high=10, medium=6, low=2, unknown=0), count("targeted_sectors", 3, 8),
        by("@operational_relevance", very_high=10, high=7, medium=4, low=1, none=0), flag("adopting_actor_type", 5)],
    "infrastructure_dependency_signal": [
        by("criticality", critical=12, high=9, medium=5, low=2, unknown=1),
        by("scope_of_exposure", **{"global": 10}, ecosystem=8, sector=5, organization=3, unknown=1),
        flag("known_exploits", 8), flag("attack_surface_created", 7, 2), count("affected_systems", 2, 8)],
    "trust_boundary_shift": [
        novelty(12, 9, 6, 3, 1), flag("systemic_implication", 10, 3),
        by("exploitability_window", immediate=10, near_term=7, long_term=4, unknown=1),
        count("affected_stakeholders", 3, 8), flag("trust_assumption_violated", 7, 2)],
}
TYPE_CAP, TYPE_DEFAULT = 45, 5
BANDS = [(85, "must_read"), (70, "high"), (50, "medium"), (30, "low")]
FEED_BANDS = [(80, "must_read"), (65, "high"), (45, "medium"), (25, "low")]


def term_sql(term: tuple, context: str = "source_type_context") -> str:
    """Points of one rule-table term as a SQL expression."""
    kind = term[0]
    if kind == "fixed":
        return str(term[1])
    name = term[1]
    c = name[1:] if name.startswith("@") else f"{context}.{name}"
    n = f"coalesce(size({c}), 0)"
    if kind == "value":
        return f"CASE {c} " + " ".join(f"WHEN {rules.sql_str(k)} THEN {v}" for k, v in term[2].items()) + " ELSE 0 END"
    if kind == "flag":
        # Text counts as set when non-empty; booleans when true.
        return f"CASE WHEN string({c}) NOT IN ('', 'false') THEN {term[2]} ELSE {term[3]} END"
    if kind == "count":
        return f"least({term[3]}, greatest({n}, 0) * {term[2]} + {term[4]})"
    if kind == "filled":
        return f"CASE WHEN {n} > 0 THEN {term[2]} ELSE {term[3]} END"
    if kind == "fewer":
        return f"greatest(0, {term[2]} - greatest({n}, 0))"
    if kind == "any":
        return f"CASE WHEN arrays_overlap({c}, {rules.sql_lit(term[2])}) THEN {term[3]} ELSE {term[4]} END"
    if kind == "in":
        return f"CASE WHEN {c} IN ({', '.join(map(rules.sql_str, term[2]))}) THEN {term[3]} ELSE {term[4]} END"
    raise ValueError(kind)


def score_type(terms: dict[str, list[tuple]] | None = None) -> Column:
    """Type-specific points, each type capped; unlisted types get the default."""
    whens = " ".join(f"WHEN {rules.sql_str(name)} THEN least({TYPE_CAP}, {' + '.join(map(term_sql, parts))})"
                     for name, parts in (terms or TYPE_TERMS).items())
    return F.expr(f"CASE source_type {whens} ELSE {TYPE_DEFAULT} END")


def _size(df: DataFrame, *names: str) -> Column:
    """Length of the first of the array columns that is not null."""
    have = [F.size(n) for n in names if n.split(".")[0] in df.columns]
    return F.coalesce(*[F.when(s >= 0, s) for s in have], F.lit(0))


def score_base(df: DataFrame, as_of: Column) -> dict[str, Column]:
    tier = F.coalesce("trust_tier", F.lit("unknown"))
    offensive = F.coalesce((F.col("category") != "") & (F.col("category") != vocab.FALLBACK_CATEGORY), F.lit(False))
    conf = F.col("classification_confidence")
    ai = F.least(F.lit(10), F.floor(F.coalesce("ai_specificity_score", F.lit(0)) * 10 / 100 + 0.5).cast("int"))
    relevance = (F.when(offensive & (conf == "high"), F.greatest(ai, F.lit(8)))
                 .when(offensive & (conf == "medium"), F.greatest(ai, F.lit(5))).otherwise(ai))
    facts = _size(df, "evidence_card.key_facts", "main_claims")
    numbers = _size(df, "evidence_card.numbers_statistics", "important_numbers")
    flow = _size(df, "evidence_card.attack_flow") if "evidence_card" in df.columns else F.lit(0)
    return {
        "source_credibility": rules.lookup(tier, vocab.SCORE_CREDIBILITY, 1),
        "ai_relevance": relevance,
        "evidence_concreteness": F.least(F.lit(10), facts * 2 + points((numbers > 0, 2), (flow > 0, 2))),
        "citation_quality": F.when(tier.isin("primary", "curated"), 5).when(tier == "high", 4)
        .when(F.coalesce("url", F.lit("")) != "", 2).otherwise(0),
        "recency": times.age_band(F.col("date_published"), as_of),
    }


def score_bonus(df: DataFrame) -> Column:
    op, nov = F.col("operational_relevance"), F.col("novelty")
    numbers = _size(df, "evidence_card.numbers_statistics", "important_numbers")
    sure = (F.col("classification_confidence") == "high") & (F.col("category") != "") \
        & (F.col("category") != vocab.FALLBACK_CATEGORY)
    return points((op.isin("very_high", "high") & nov.isin("new_attack_surface", "new_tactic"), 5),
                  (numbers > 0, 5), (sure, 5))


def score_penalty(df: DataFrame) -> Column:
    facts = _size(df, "evidence_card.key_facts", "main_claims")
    dup = (F.col("is_multi_source") & ~F.col("is_representative")) if "is_multi_source" in df.columns else F.lit(False)
    untagged = (_size(df, "framework_tags") == 0) & (_size(df, "attack_mappings") == 0) & (_size(df, "governance_tags") == 0)
    weak = (F.coalesce("ai_specificity_score", F.lit(100)) < 20) & (F.col("category") == vocab.FALLBACK_CATEGORY)
    return points((dup, 10), (facts == 0, 10), (weak, 15), (F.col("trust_tier") == "low", 20),
                  ((F.col("source_type") == "unknown") & untagged, 10))


def rawfact_score(df: DataFrame, as_of: Column, terms=None) -> DataFrame:
    """All components, the clamped total, its band and a reason."""
    df = df.withColumns({**score_base(df, as_of), "type_specific": score_type(terms),
                         "horizon_bonus": score_bonus(df), "penalties": score_penalty(df)})
    base = reduce(lambda a, b: a + b, [F.col(c) for c in (
        "source_credibility", "ai_relevance", "evidence_concreteness", "citation_quality", "recency")])
    df = df.withColumn("common_base", base)
    total = F.col("common_base") + F.col("type_specific") + F.col("horizon_bonus") - F.col("penalties")
    df = df.withColumn("rawfact_score", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    rel = F.col("ai_relevance")
    reason = F.concat_ws(
        ", ", F.format_string("%s trust (%d/10)", F.coalesce("trust_tier", F.lit("unknown")), F.col("source_credibility")),
        F.format_string("%s type (type=%d)", F.replace(F.coalesce("source_type", F.lit("unknown")), F.lit("_"), F.lit(" ")),
                        F.col("type_specific")),
        F.when(rel >= 8, F.lit("high AI relevance")).when(rel >= 5, F.lit("medium AI relevance"))
        .otherwise(F.lit("low AI relevance")),
        F.when(F.col("horizon_bonus") > 0, F.format_string("horizon bonus +%d", F.col("horizon_bonus"))),
        F.when(F.col("penalties") > 0, F.format_string("penalties -%d", F.col("penalties"))),
        F.concat(F.lit("op_relevance="), "operational_relevance"))
    return (df.withColumn("rawfact_priority", rules.ladder(F.col("rawfact_score"), BANDS, "archive_only"))
            .withColumn("scoring_reason", reason))


def feed_score(df: DataFrame) -> DataFrame:
    """The older additive score and its bands."""
    have = df.columns
    raw_ai = F.coalesce(*[F.col(c) for c in ("ai_specificity_score", "ai_relevance_score") if c in have], F.lit(0))
    cat = F.coalesce("category", F.lit(""))
    conf = F.coalesce("classification_confidence", F.lit("low"))
    known = ~cat.isin("", vocab.FALLBACK_CATEGORY, vocab.UNCATEGORISED) & ~conf.isin("low", "none")
    df = df.withColumns({
        "base_score": rules.lookup(F.coalesce("trust_tier", F.lit("")), vocab.FEED_TIER_POINTS, 20),
        "source_type_score": rules.lookup(F.coalesce("source_type", F.lit("")), vocab.FEED_TYPE_POINTS, 8),
        "category_relevance_score": F.least(F.lit(25), F.floor(raw_ai * 25 / 100 + 0.5).cast("int")),
        "feed_bonus": F.when(known, 10).otherwise(0),
        "credibility_bonus": F.coalesce("source_credibility_score", F.lit(0)) * 2,
        "noise_penalty": F.least(F.lit(15), _size(df, "filter_flags") * 3)})
    total = (F.col("base_score") + F.col("source_type_score")
             + F.floor(F.col("category_relevance_score") / 4 + 0.5).cast("int")
             + F.col("feed_bonus") + F.col("credibility_bonus") - F.col("noise_penalty"))
    return (df.withColumn("feed_score", F.least(F.lit(100), total))
            .withColumn("feed_priority", rules.ladder(F.col("feed_score"), FEED_BANDS, "archive_only")))


CARD_TYPE = ("struct<evidence_card_title:string,short_summary:string,key_facts:array<string>,"
             "numbers_statistics:array<string>,attack_flow:array<string>,impacts:array<string>,"
             "why_it_matters:string,best_used_for:array<string>>")
WHY_IT_MATTERS = "Relevant to the AI threat landscape — see source for details."


TITLE_CHARS = 80          # display width of a card's title


def _card(df: DataFrame, with_summary: bool, title_chars: int = TITLE_CHARS) -> Column:
    empty = F.array().cast("array<string>")
    summary = [F.nullif(F.col(c), F.lit("")) for c in (["source_summary", "summary"] if with_summary else ["source_summary"])
               if c in df.columns]
    return F.struct(
        F.substring(F.coalesce("title", F.lit("")), 1, title_chars).alias("evidence_card_title"),
        F.coalesce(*summary, F.col("title"), F.lit("")).alias("short_summary"),
        F.coalesce("main_claims", empty).alias("key_facts"),
        F.coalesce("important_numbers", empty).alias("numbers_statistics"),
        empty.alias("attack_flow"), empty.alias("impacts"), F.lit(WHY_IT_MATTERS).alias("why_it_matters"),
        F.array(F.lit("trend_support")).alias("best_used_for")).cast(CARD_TYPE)


def evidence_card(df: DataFrame, landed: str | None = None, *, limits: dict[str, int] | None = None) -> DataFrame:
    """Card for relevant or prioritised rows, null for the rest.  ``landed`` names a column of card
    JSON produced elsewhere; it is validated (``limits`` may cap its lists by name) and preferred."""
    priority = F.col("feed_priority") if "feed_priority" in df.columns else F.lit(None).cast("string")
    wanted = F.coalesce(F.col("operational_relevance").isin("very_high", "high"), F.lit(False)) \
        | F.coalesce(priority.isin("must_read", "high"), F.lit(False))
    card = _card(df, True)
    if landed is not None:
        card = F.coalesce(validate_card(F.col(landed), limits=limits), card)
    return df.withColumn("evidence_card", F.when(wanted, card))


def validate_card(raw: Column, *, limits: dict[str, int] | None = None) -> Column:
    """Landed card JSON; null when it does not parse.  Lists are whole unless ``limits`` caps them by name."""
    most = (limits or {}).get
    r = F.from_json(raw, CARD_TYPE)
    empty = F.array().cast("array<string>")
    used = rules.first_items(F.filter(F.coalesce(r["best_used_for"], empty), lambda v: v.isin(vocab.BEST_USED_FOR)), most("best_used_for"))
    text = lambda n: F.coalesce(r[n], F.lit(""))
    whole = lambda n: rules.first_items(F.coalesce(r[n], empty), most(n)).alias(n)
    card = F.struct(
        text("evidence_card_title").alias("evidence_card_title"), text("short_summary").alias("short_summary"),
        whole("key_facts"), whole("numbers_statistics"), whole("attack_flow"), whole("impacts"),
        text("why_it_matters").alias("why_it_matters"), rules.or_default(used, "trend_support").alias("best_used_for"))
    return F.when(r.isNotNull() & r["evidence_card_title"].isNotNull(), card)


def feed_evidence(df: DataFrame) -> DataFrame:
    wanted = F.col("feed_priority").isin("must_read", "high")
    return df.withColumn("evidence_card", F.when(wanted, _card(df, False)))


def feed_cards(df: DataFrame, keys: tuple[str, ...] = ("position", "url")) -> DataFrame:
    """The must_read and high rows alone, with their card.

    Priorities are written once by ``keys`` and looked up: a filter on them would be pushed into what derives them,
    which is then worked out again for each of its uses.
    """
    wanted = cut_lineage(df.select(*keys, "feed_priority"), "feed-priority").where(F.col("feed_priority").isin("must_read", "high"))
    wanted = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(wanted, same, "left_semi").withColumn("evidence_card", _card(df, False))
