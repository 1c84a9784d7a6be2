"""Deterministic record taxonomies: sector, geography, technology, impact, context, analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules

S, A, B = "string", "array<string>", "boolean"
U = "unknown"
# --- fixed values: default context per source type ----------------------------
# field -> default; "" is empty text, [] an empty array, False a flag
DEFAULT_CONTEXT: dict[str, dict] = {
    "vulnerability": {"exploitability": U, "affected_product_or_system": "", "affected_ecosystem": "",
                      "blast_radius": U, "exploit_status": U, "patch_status": U,
                      "execution_or_data_access_risk": U, "defender_actionability": U},
    "exploit_disclosure": {"exploit_chain": [], "required_access": U, "reproducibility": U, "technical_complexity": U,
                           "public_tooling_available": False, "operational_realism": U, "automation_potential": U},
    "incident": {"confirmed_impact": "unclear", "victim_or_target_type": "", "affected_sector": [], "incident_scale": U,
                 "attacker_method": "", "repeatability": U, "institutional_response": U, "known_losses_or_numbers": []},
    "threat_intelligence": {"observed_ttps": [], "threat_actor": "", "campaign_scope": U, "targeted_sectors": [],
                            "ai_role_in_operation": U, "attribution_confidence": U, "operational_confidence": U},
    "research_finding": {"research_claim": "", "method_demonstrated": "", "reproducibility": U, "systems_tested": [],
                         "research_to_threat_potential": U, "operationalization_barriers": [],
                         "defensive_implications": ""},
    "defensive_capability": {"defensive_gap_addressed": "", "capability_proposed": "", "deployment_readiness": U,
                             "coverage_scope": U, "evaluation_quality": U, "limitations": []},
    "governance_signal": {"issuing_authority": "", "affected_sectors": [], "governance_issue": "",
                          "compliance_or_policy_implication": "", "systemic_risk_recognized": False,
                          "recommended_actions": []},
    "ecosystem_signal": {"ecosystem_change": "", "adoption_signal": U, "infrastructure_or_platform": "",
                         "downstream_security_impact": U, "dependency_growth": U, "attack_surface_growth": U},
    "capability_demonstration": {"demonstrated_capability": "", "affected_system": "", "ease_of_replication": U,
                                 "required_access": U, "defender_implications": "",
                                 "public_reproduction_available": False},
    "adversary_adoption_signal": {"adopting_actor_type": "", "capability_adopted": "",
                                  "observed_evidence": "confirmed | claimed | inferred | unknown",
                                  "spread_trajectory": "high | medium | low | unknown",
                                  "targeted_sectors": [], "first_observed": ""},
    "infrastructure_dependency_signal": {"dependency_type": "", "attack_surface_created": "", "scope_of_exposure": U,
                                         "criticality": "critical | high | medium | low | unknown",
                                         "known_exploits": False, "affected_systems": []},
    "trust_boundary_shift": {"trust_assumption_violated": "", "affected_context": "", "systemic_implication": "",
                             "exploitability_window": "immediate | near_term | long_term | unknown",
                             "affected_stakeholders": []},
    "societal_harm_signal": {"harm_type": "", "affected_population": "", "harm_scale": U, "trust_system_affected": "",
                             "institutional_response": U, "repeatability": U},
    "benchmark_evaluation": {"capability_measured": "", "evaluation_setup": "", "key_result": "",
                             "model_or_system_tested": "", "trajectory_signal": U, "limitations": []},
    "strategic_signal": {"strategic_theme": "", "systemic_risk": "", "convergence_signal": "", "horizon_relevance": U,
                         "supporting_examples": [], "confidence": U},
}


def context_fields() -> dict[str, str]:
    """All context fields of all types with their Spark type: one wide struct."""
    out: dict[str, str] = {}
    for shape in DEFAULT_CONTEXT.values():
        for name, value in shape.items():
            out[name] = A if isinstance(value, list) else B if isinstance(value, bool) else S
    return dict(sorted(out.items()))


CONTEXT_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in context_fields().items()) + ">"


def default_context(source_type: str) -> Column:
    """The default context of the type in column ``source_type``; fields of other types are null."""
    fields = []
    for name, typ in context_fields().items():
        by_value: dict[str, list[str]] = {}
        for st, shape in DEFAULT_CONTEXT.items():
            if name in shape:
                by_value.setdefault(rules.sql_lit(shape[name]), []).append(rules.sql_str(st))
        whens = " ".join(f"WHEN {source_type} IN ({', '.join(types)}) THEN {value}" for value, types in by_value.items())
        fields.append(f"'{name}', CASE {whens} ELSE cast(NULL AS {typ}) END")
    return F.expr("named_struct(" + ", ".join(fields) + ")")


def _has(df: DataFrame, name: str, typ: str) -> Column:
    return F.col(name) if name in df.columns else F.array().cast(typ)


def _tag_names(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.array().cast(A)
    return F.filter(F.transform(name, lambda t: t["tag"]), lambda t: t.isNotNull())


def all_tags(df: DataFrame) -> Column:
    return F.array_distinct(F.concat(F.coalesce(_has(df, "tags", A), F.array().cast(A)),
                                     _tag_names(df, "framework_tags"), _tag_names(df, "attack_mappings")))


def rawfact_taxonomy(df: DataFrame, *, limits: dict[str, int] | None = None) -> DataFrame:
    """Columns rawfact_tags, sector, geography, technology, impact_*, operational_relevance, novelty,
    source_type_context.  ``limits`` may cap the lists by column; they are whole without it."""
    most = (limits or {}).get
    st = F.coalesce("source_type", F.lit(U))
    t = "_text"
    out = df.withColumn("_text", rules.lower_text(F.col("title"), F.col("full_text")))
    novelty = (F.when(rules.any_phrase(t, vocab.NOVELTY_NEW), F.lit("new_tactic"))
               .when(rules.any_phrase(t, vocab.NOVELTY_SCALE), F.lit("known_tactic_new_scale")).otherwise(F.lit(U)))
    return out.withColumns({
        "rawfact_tags": rules.first_items(all_tags(df), most("rawfact_tags")),
        "sector": rules.or_default(rules.first_items(rules.labels(t, vocab.SECTOR_RULES), most("sector")), "cross_sector"),
        "geography": rules.first_items(rules.labels(t, vocab.GEOGRAPHY_RULES), most("geography")),
        "technology": rules.first_items(rules.labels(t, vocab.TECHNOLOGY_RULES), most("technology")),
        "impact_types": rules.or_default(rules.labels(t, vocab.IMPACT_TYPE_RULES), "security"),
        "impact_scope": F.lit(U), "impact_severity": F.lit(U),
        "operational_relevance": rules.lookup(st, vocab.TYPE_RELEVANCE, "medium"),
        "novelty": novelty,
        "source_type_context": default_context("source_type"),
        "rawfact_taxonomy_reason": F.concat(F.lit("Deterministic fallback: source_type="), st)}).drop("_text")


RAWFACT_LANDED = ("rawfact_tags array<string>, sector array<string>, geography array<string>, technology array<string>, "
                  "affected_systems array<string>, impact_type array<string>, impact_scope string, impact_severity string, "
                  "operational_relevance string, novelty string, rawfact_taxonomy_reason string, "
                  f"source_type_context {CONTEXT_TYPE}")


def rawfact_validate(df: DataFrame, raw: str, *, limits: dict[str, int] | None = None) -> DataFrame:
    """Landed taxonomy JSON with enum checks; ``limits`` may cap the lists by column."""
    out = df.withColumn("_r", F.from_json(raw, RAWFACT_LANDED))

    def whole(name: str) -> Column:
        return rules.first_items(F.coalesce(F.col(f"_r.{name}"), F.array().cast(A)), (limits or {}).get(name))

    return out.withColumns({
        "rawfact_tags": whole("rawfact_tags"), "sector": whole("sector"), "geography": whole("geography"),
        "technology": whole("technology"), "affected_systems": whole("affected_systems"),
        "impact_types": whole("impact_type"),
        "impact_scope": rules.enum_exact(F.col("_r.impact_scope"), vocab.IMPACT_SCOPES),
        "impact_severity": rules.enum_exact(F.col("_r.impact_severity"), vocab.IMPACT_SEVERITIES),
        "operational_relevance": rules.enum_exact(F.col("_r.operational_relevance"), vocab.OPERATIONAL_RELEVANCES, "medium"),
        "novelty": rules.enum_exact(F.col("_r.novelty"), vocab.NOVELTIES),
        "source_type_context": F.col("_r.source_type_context"),
        "rawfact_taxonomy_reason": F.coalesce("_r.rawfact_taxonomy_reason", F.lit(""))}).drop("_r")


def feed_taxonomy(df: DataFrame) -> DataFrame:
    """The older variant: no caps, type-based tags, scope and severity, other impact phrases."""
    st = F.coalesce("source_type", F.lit(U))
    t = "_text"
    out = df.withColumn("_text", rules.lower_text(F.col("title"), F.col("full_text")))
    type_tags = rules.lookup_array(st, vocab.FEED_TYPE_TAGS)
    cve = F.when((st == "vulnerability") & F.col(t).contains("cve"), F.array(F.lit("cve"))).otherwise(F.array().cast(A))
    novelty = (F.when(rules.any_phrase(t, vocab.NOVELTY_NEW), F.lit("new_tactic"))
               .when(rules.any_phrase(t, vocab.FEED_NOVELTY_SCALE), F.lit("known_tactic_new_scale"))
               .otherwise(F.lit("known_tactic")))
    return out.withColumns({
        "feed_tags": F.array_distinct(F.concat(all_tags(df), type_tags, cve)),
        "sector": rules.or_default(rules.labels(t, vocab.SECTOR_RULES), "cross_sector"),
        "geography": rules.labels(t, vocab.GEOGRAPHY_RULES),
        "technology": rules.labels(t, vocab.TECHNOLOGY_RULES),
        "impact_types": rules.or_default(rules.labels(t, vocab.FEED_IMPACT_TYPE_RULES), "security"),
        "impact_scope": rules.lookup(st, vocab.FEED_TYPE_SCOPE, "organization"),
        "impact_severity": rules.lookup(st, vocab.FEED_TYPE_SEVERITY, U),
        "operational_relevance": rules.lookup(st, vocab.FEED_TYPE_RELEVANCE, "medium"),
        "novelty": novelty}).drop("_text")


def analytics_taxonomy(df: DataFrame, *, limits: dict[str, int] | None = None) -> DataFrame:
    """Chart-ready columns from tags, technology, category, type and text.  Needs the rawfact columns.  ``limits`` may
    cap the lists by column; they are whole without it, since reports count them."""
    most = (limits or {}).get
    st = F.coalesce("source_type", F.lit(U))
    cat = F.coalesce("category", F.lit(vocab.FALLBACK_CATEGORY))
    t = "_text"
    ctx = F.col("source_type_context")
    out = df.withColumn("_text", rules.lower_text(F.col("title"), F.col("full_text")))
    names = F.concat(_tag_names(df, "framework_tags"), _tag_names(df, "attack_mappings"), F.col("rawfact_tags"))
    vectors = rules.vocab_intersect(names, vocab.ATTACK_VECTORS, most("attack_vectors"))
    surfaces = rules.first_items(F.array_distinct(F.flatten(F.transform(
        "technology", lambda x: rules.lookup_array(x, vocab.TECH_SURFACES)))), most("attack_surface"))
    evidence = F.lower(F.coalesce(ctx["observed_evidence"], F.lit("")))
    status = (F.when((st == "vulnerability") & (ctx["exploit_status"] == "exploited_in_the_wild"), F.lit("active_operational_use"))
              .when((st == "research_finding") & rules.any_phrase(t, vocab.POC_PHRASES), F.lit("proof_of_concept"))
              .when((st == "adversary_adoption_signal") & (evidence == "confirmed"), F.lit("active_operational_use"))
              .otherwise(rules.lookup(st, vocab.TYPE_STATUS, U)))
    out = out.withColumns({
        "attack_vectors": rules.or_default(vectors, U), "_surfaces": surfaces,
        "ai_layer": rules.or_default(rules.lookup_array(cat, vocab.CATEGORY_LAYERS), U),
        "operational_status": status,
        "analytics_impact_types": rules.first_items(rules.or_default(rules.labels(t, vocab.ANALYTICS_IMPACT_RULES), U), most("analytics_impact_types")),
        "signal_clusters": rules.or_default(rules.lookup_array(cat, vocab.CATEGORY_CLUSTERS), U)})
    op = F.col("operational_status")
    themes = rules.flags(
        ("attack_surface_expansion", (F.size("_surfaces") > 0) | (F.size("technology") > 0)),
        ("operationalization", op.isin("active_operational_use", "limited_operational_use")),
        ("adversary_ai_adoption", st == "adversary_adoption_signal"),
        ("trust_boundary_failure", st == "trust_boundary_shift"),
        ("dependency_growth", st == "infrastructure_dependency_signal"),
        ("governance_pressure", st == "governance_signal"),
        ("research_to_threat_pipeline", (st == "research_finding") & (op != "research_only")))
    return out.withColumns({
        "attack_surface": rules.or_default(F.col("_surfaces"), U),
        "maturity": rules.lookup(op, vocab.STATUS_MATURITY, U),
        "recurring_themes": rules.first_items(rules.or_default(themes, U), most("recurring_themes")),
        "entities": rules.first_items(_has(df, "key_entities", A), most("entities")),
        "analytics_confidence": F.when(F.col("trust_tier").isin("primary", "curated", "high"), F.lit("high"))
        .when(F.col("trust_tier") == "medium", F.lit("medium")).otherwise(F.lit("low")),
        "analytics_date": F.date_format("date_published", "yyyy-MM-dd")}).drop("_text", "_surfaces")


ANALYTICS_LANDED = {
    "attack_vectors": vocab.ATTACK_VECTORS, "attack_surface": vocab.ATTACK_SURFACES,
    "ai_layer": vocab.AI_LAYERS, "impact_type": vocab.IMPACT_TYPES,
    "signal_clusters": vocab.SIGNAL_CLUSTERS, "recurring_themes": vocab.RECURRING_THEMES,
}
ANALYTICS_FREE = ["sector", "geography", "technology", "entities"]


def analytics_validate(df: DataFrame, raw: str, *, limits: dict[str, int] | None = None) -> DataFrame:
    """Landed analytics JSON (keys prefixed ``analytics_``) against its vocabularies.  ``limits`` may cap a list by its
    name, and the reason (characters)."""
    most = (limits or {}).get
    arrays = [*ANALYTICS_LANDED, *ANALYTICS_FREE]
    scalars = ["operational_status", "maturity", "impact_scope", "confidence", "reason"]
    schema = ", ".join([f"analytics_{n} array<string>" for n in arrays] + [f"analytics_{n} string" for n in scalars])
    out = df.withColumn("_r", F.from_json(raw, schema))
    r = lambda n: F.col(f"_r.analytics_{n}")
    cols = {n: rules.vocab_intersect(r(n), v, most(n)) for n, v in ANALYTICS_LANDED.items()}
    cols |= {n: rules.first_items(F.coalesce(r(n), F.array().cast(A)), most(n)) for n in ANALYTICS_FREE}
    cols |= {
        "operational_status": rules.pick_one(r("operational_status"), vocab.OPERATIONAL_STATUSES),
        "maturity": rules.pick_one(r("maturity"), vocab.MATURITIES),
        "impact_scope": rules.pick_one(r("impact_scope"), vocab.IMPACT_SCOPES),
        "analytics_confidence": rules.enum_exact(r("confidence"), ["high", "medium", "low"], "medium"),
        "analytics_reason": rules.first_chars(F.coalesce(r("reason"), F.lit("")), most("reason"))}
    return out.withColumns(cols).drop("_r")
