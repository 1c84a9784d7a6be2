"""Per-type points, bands, cards and taxonomy edges on small frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline import vocab
from strandline.operators import classify, score, taxonomy

BEST = {
    "vulnerability": ({"exploitability": "very_high", "blast_radius": "global", "exploit_status": "exploited_in_the_wild", "defender_actionability": "immediate"},
                      {"impact_severity": "critical", "technology": ["llm"]}, 45),
    "exploit_disclosure": ({"reproducibility": "medium", "exploit_chain": ["a", "b", "c"], "required_access": "user", "public_tooling_available": True}, {}, 6 + 6 + 5 + 5),
    "incident": ({"confirmed_impact": "claimed", "incident_scale": "sector", "attacker_method": "x", "known_losses_or_numbers": ["1"]}, {"sector": ["energy"]}, 6 + 6 + 7 + 5 + 4),
    "threat_intelligence": ({"operational_confidence": "low", "observed_ttps": ["a"] * 9, "targeted_sectors": ["x"]}, {}, 2 + 10 + 6 + 6),
    "research_finding": ({"operationalization_barriers": ["a", "b"], "systems_tested": ["x"], "defensive_implications": "d"}, {"novelty": "incremental"}, 1 + 2 + 3 + 5),
    "defensive_capability": ({"limitations": ["l"], "coverage_scope": "broad"}, {}, 8 + 5 + 5),
    "governance_signal": ({"affected_sectors": ["a", "b", "c", "d"], "issuing_authority": "x", "recommended_actions": ["r"] * 3}, {}, 10 + 8 + 3 + 2 + 5 + 5),
    "ecosystem_signal": ({"adoption_signal": "strong", "infrastructure_or_platform": "p"}, {}, 10 + 10 + 5),
    "societal_harm_signal": ({"harm_scale": "national", "institutional_response": "no"}, {"impact_severity": "low"}, 2 + 2 + 6 + 3 + 2),
    "benchmark_evaluation": ({"limitations": ["l"], "capability_measured": "c"}, {"trust_tier": "medium"}, 5 + 10 + 5 + 2),
    "strategic_signal": ({"horizon_relevance": "high", "supporting_examples": ["a"] * 5, "confidence": "low"}, {}, 8 + 3 + 2 + 7 + 1 + 5),
    "capability_demonstration": ({"required_access": "none"}, {"novelty": "new_attack_surface"}, 12 + 8 + 2),
    "adversary_adoption_signal": ({"observed_evidence": "confirmed", "targeted_sectors": ["a", "b"]}, {"operational_relevance": "low"}, 12 + 6 + 1),
    "infrastructure_dependency_signal": ({"criticality": "high", "known_exploits": True, "affected_systems": ["a"] * 6}, {}, 9 + 8 + 2 + 8),
    "trust_boundary_shift": ({"exploitability_window": "near_term", "affected_stakeholders": ["a"]}, {"novelty": "known_tactic"}, 3 + 3 + 7 + 3 + 2),
    "unknown": ({}, {}, 5),
}


@pytest.mark.parametrize("kind", BEST)
def test_type_points(spark, kind):
    context, record, want = BEST[kind]
    row = {"source_type": kind, "impact_severity": "unknown", "novelty": "unknown", "operational_relevance": "medium", "trust_tier": "primary",
           "technology": [], "sector": [], **record, "source_type_context": context}
    schema = ("source_type string, impact_severity string, novelty string, operational_relevance string, trust_tier string, "
              f"technology array<string>, sector array<string>, source_type_context {taxonomy.CONTEXT_TYPE}")
    df = spark.createDataFrame([row], schema)
    assert df.select(score.score_type().alias("p")).first().p == want


def test_context_covers_every_scored_field():
    fields = taxonomy.context_fields()
    for terms in score.TYPE_TERMS.values():
        for term in terms:
            if term[0] != "fixed" and not term[1].startswith("@"):
                assert term[1] in fields, term
    assert set(score.TYPE_TERMS) == set(vocab.SOURCE_TYPES) == set(taxonomy.DEFAULT_CONTEXT)


def test_registry_size():
    rows = list(vocab.registry_rows())
    assert len(rows) == 68 and len({r[0] for r in rows}) == 68


def test_landed_card(spark):
    good = '{"evidence_card_title": "T", "key_facts": ["1","2","3","4","5","6"], "best_used_for": ["case_study","nonsense"]}'
    rows = spark.createDataFrame([("high", good), ("high", "broken"), ("low", good)], "operational_relevance string, raw string").withColumns({
        "title": F.lit("My title"), "source_summary": F.lit("sum"), "main_claims": F.array(F.lit("c")), "important_numbers": F.array().cast("array<string>")})
    got = [r.evidence_card for r in score.evidence_card(rows, "raw").collect()]
    assert got[0].evidence_card_title == "T" and len(got[0].key_facts) == 6 and got[0].best_used_for == ["case_study"]
    assert len(score.evidence_card(rows, "raw", limits={"key_facts": 5}).first().evidence_card.key_facts) == 5
    assert got[1].evidence_card_title == "My title" and got[1].best_used_for == ["trend_support"]
    assert got[2] is None


CAND = "position bigint, category_candidates array<struct<category:string,confidence:string,supporting_tags:array<string>>>, framework_tags array<struct<tag:string,category_candidate:string,framework_ref:string,confidence:string>>, attack_mappings array<struct<tag:string,framework_ref:string,confidence:string>>, main_category string"


@pytest.mark.parametrize("cands, tags, attacks, stored, want", [
    ([("llm_threats", "medium", ["a"]), ("agentic_ai_threats", "medium", ["a", "b"])], [], [], None, ("agentic_ai_threats", "medium")),
    ([("weather", "high", []), ("llm_threats", "low", [])], [("t", "agentic_ai_threats", "r", "medium")], [], None, ("agentic_ai_threats", "medium")),
    ([("llm_threats", "low", [])], [("t", "agentic_ai_threats", "r", "low")], [], None, ("llm_threats", "low")),
    ([], [("t", "llm_threats", "r", "low"), ("u", "llm_threats", "r", "high"), ("v", "agentic_ai_threats", "r", "high")], [], None, ("llm_threats", "high")),
    ([], [], [("phishing", "T1566", "medium")], None, ("ai_enabled_threats", "medium")),
    ([], [], [], "llm_threats", ("llm_threats", "low")),
    ([], [], [], "ai_for_security", ("unclear_or_adjacent", "none")),
    ([], [("t", "llm_threats", "r", "low")], [], None, ("unclear_or_adjacent", "none"))])
def test_pick_category(spark, cands, tags, attacks, stored, want):
    df = spark.createDataFrame([(1, cands, tags, attacks, stored)], CAND)
    got = classify.pick_category(df).first()
    assert (got.main_category, got.classification_confidence) == want


def test_penalties_and_bonus(spark):
    df = spark.createDataFrame([("low", "unknown", vocab.FALLBACK_CATEGORY, "none", 5, False, True)],
                               "trust_tier string, source_type string, category string, classification_confidence string, ai_specificity_score int, is_representative boolean, is_multi_source boolean")
    empty = F.array().cast("array<string>")
    df = df.withColumns({"main_claims": empty, "important_numbers": empty, "framework_tags": empty, "attack_mappings": empty, "governance_tags": empty,
                         "operational_relevance": F.lit("high"), "novelty": F.lit("new_tactic"), "url": F.lit(""), "date_published": F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")})
    df = df.withColumns({"source_type_context": F.expr(f"cast(null as {taxonomy.CONTEXT_TYPE})"), "impact_severity": F.lit("unknown"), "technology": empty, "sector": empty})
    r = score.rawfact_score(df, F.lit("2025-03-01").cast("timestamp_ntz")).first()
    assert r.penalties == 10 + 10 + 15 + 20 + 10 and r.horizon_bonus == 5 and r.rawfact_score == 0 and r.rawfact_priority == "archive_only"
    assert r.recency == 5 and r.citation_quality == 0
