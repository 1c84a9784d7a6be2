"""Validity, relevance, typing, trust, gate, tags, eligibility and category decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules, text, times, urls
from strandline.functions.rules import blank, flags, ladder, points, text_length
from strandline.operators.skew import hot_join
from strandline.runtime import cut_lineage

REVIEW_FLAGS = ["missing_publisher", "possible_non_english", "date_before_2020", "minimal_text", "no_publish_date"]
BLOCKING_FLAGS = ["missing_title", "missing_url", "unsafe_url", "duplicate_id", "duplicate_content"]
AUTHORITATIVE = ["primary", "high", "curated"]
NO_TAGS = "array<string>"


def _col(df: DataFrame, name: str, typ: str = "string") -> Column:
    """An optional input column, or a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(typ)


def no_publisher(c: Column) -> Column:
    return blank(c) | (c == "Unknown")


def structural_validity(df: DataFrame, reachable: str | None = None) -> DataFrame:
    """Completeness score, label, warnings and usability.

    ``reachable`` names a boolean column of landed probe results, if there is one.
    """
    title_ok = F.trim(F.coalesce("title", F.lit(""))) != ""
    status = F.when(blank(F.col("url")), F.lit("missing")).otherwise(urls.url_safety_status(F.col("url")))
    n = text_length(F.col("full_text"))
    dated, conf = F.col("date_published").isNotNull(), F.coalesce(_col(df, "date_confidence"), F.lit("exact"))
    dead = F.coalesce(F.col(reachable) == F.lit(False), F.lit(False)) if reachable else F.lit(False)
    score = points((no_publisher(F.col("publisher")), -10), (~dated, -15), (dated & (conf == "low"), -5),
                   (dated & (conf == "none"), -8), (n >= 500, 15), ((n >= 50) & (n < 500), 5), (n < 50, -5),
                   (dead, -10), base=50)
    warnings = flags(("Missing publisher", no_publisher(F.col("publisher"))), ("Missing publication date", ~dated),
                     ("Limited text available", n < 50), ("URL returned error response", dead))
    df = df.withColumn("url_safety_status", F.when(title_ok, status))
    good = title_ok & (F.col("url_safety_status") == "safe")
    score = F.when(good, F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(F.lit(0))
    why = (F.when(~title_ok, F.array(F.lit("Missing title")))
           .when(F.col("url_safety_status") == "missing", F.array(F.lit("Missing URL")))
           .when(~good, F.array(F.concat(F.lit("Unsafe URL ("), "url_safety_status", F.lit(")")))).otherwise(warnings))
    return (df.withColumn("structural_validity_score", score)
            .withColumn("publisher_trust_score", rules.lookup(F.coalesce("trust_tier", F.lit("unknown")), vocab.PUBLISHER_TRUST, 2))
            .withColumn("credibility_label", ladder(F.col("structural_validity_score"), [
                (80, "primary"), (65, "high_trust"), (45, "medium_trust"), (25, "low_trust")], "do_not_use"))
            .withColumn("warnings", why)
            .withColumn("usable", F.col("credibility_label") != "do_not_use"))


def text_quality(df: DataFrame) -> Column:
    n = text_length(F.col("full_text"))
    return F.least(F.lit(100), ladder(n, [(500, 60), (100, 35), (50, 15)], 3) + points(
        (text_length(F.col("title")) >= 20, 15), (text_length(_col(df, "summary")) >= 50, 10),
        (~no_publisher(F.col("publisher")), 10), (F.col("date_published").isNotNull(), 5)))


def denied_publisher(publisher: Column, denied=tuple(vocab.DENIED_PUBLISHERS)) -> Column:
    p = F.lower(F.coalesce(publisher, F.lit("")))
    return F.coalesce(*[F.when(p.contains(d), F.lit(f"denied_publisher:{d}")) for d in denied],
                      F.lit(None).cast("string"))


def validity_gate(df: DataFrame, denied=tuple(vocab.DENIED_PUBLISHERS)) -> DataFrame:
    """Hard fails (title, URL, denied publisher) and soft flags."""
    title, url = F.col("title"), F.col("url")
    deny = denied_publisher(F.col("publisher"), denied)
    no_title = F.trim(F.coalesce(title, F.lit(""))) == ""
    no_url = F.trim(F.coalesce(url, F.lit(""))) == ""
    unsafe = ~urls.is_safe_url(url)
    n = text_length(F.col("full_text"))
    soft = flags(
        ("missing_publisher", no_publisher(F.col("publisher"))),
        ("no_publish_date", F.col("date_published").isNull()),
        ("date_before_2020", F.year("date_published") < 2020),
        ("short_text", n < 50), ("minimal_text", (n >= 50) & (n < 200)),
        ("title_is_url", title.rlike(r"^https?://")),
        ("generic_title", F.lower(title).isin("untitled", "no title")),
        ("possible_non_english", text.detect_language(title, _col(df, "summary"), F.col("full_text")) == "non_english"))
    hard = (F.when(no_title, F.lit("missing_title")).when(no_url, F.lit("missing_url"))
            .when(unsafe, F.lit("unsafe_url")).otherwise(deny))
    out = df.withColumn("_hard", hard).withColumn(
        "filter_flags", F.when(F.col("_hard").isNotNull(), F.array("_hard")).otherwise(soft))
    reason = (F.when(no_title, F.lit("Missing title")).when(no_url, F.lit("Missing URL"))
              .when(F.col("_hard") == "unsafe_url", F.concat(F.lit("Unsafe URL: "), url))
              .when(F.col("_hard").isNotNull(), F.concat(F.lit("Excluded publisher: "), F.col("_hard")))
              .when(F.size("filter_flags") == 0, F.lit("ok")).otherwise(F.array_join("filter_flags", "; ")))
    bad = F.arrays_overlap("filter_flags", F.array(F.lit("short_text"), F.lit("title_is_url")))
    conf = F.when(F.col("date_published").isNotNull(), F.lit("exact")).otherwise(F.lit("none"))
    return (out.withColumns({
        "hard_fail": F.col("_hard").isNotNull(),
        "is_valid": F.col("_hard").isNull() & ~bad,
        "validity_reason": reason,
        "text_quality_score": F.when(no_title, F.lit(0)).otherwise(text_quality(df)),
        "publish_date_confidence": F.when(no_title, F.lit("none")).otherwise(
            F.coalesce(F.nullif(_col(df, "date_confidence"), F.lit("")), conf))}).drop("_hard"))


def signal_score(t: str, signals: dict, whole_word: bool = False) -> Column:
    return (rules.phrase_count(t, signals["high"], 5, 14, whole_word)
            + rules.phrase_count(t, signals["medium"], 3, 8, whole_word)
            + rules.phrase_count(t, signals["low"], 2, 3, whole_word))


def ai_relevance(df: DataFrame, ai=None, cyber=None, *, whole_word: bool = False, max_chars: int | None = None) -> DataFrame:
    """Two dictionary scores, their combination and a tier, over the whole text or its first ``max_chars`` characters."""
    sample = rules.lower_present(F.col("title"), _col(df, "summary"), rules.first_chars(F.col("full_text"), max_chars))
    out = df.withColumn("_sample", sample)
    out = out.withColumn("ai_relevance_score", signal_score("_sample", ai or vocab.AI_SIGNALS, whole_word)) \
        .withColumn("cyber_relevance_score", signal_score("_sample", cyber or vocab.CYBER_SIGNALS, whole_word))
    bonus = F.least(F.lit(15), F.floor(F.col("cyber_relevance_score") * 0.15 + 0.5).cast("int"))
    return (out.drop("_sample")
            .withColumn("ai_specificity_score", F.least(F.lit(100), F.col("ai_relevance_score") + bonus))
            .withColumn("relevance_tier", ladder(F.col("ai_specificity_score"), [
                (40, "core"), (20, "adjacent"), (10, "peripheral")], "off_topic")))


def source_type_rules(df: DataFrame, text_rules=None, tag_types=None, *, max_chars: int | None = None) -> DataFrame:
    """Typing decision: existing > legacy name > connector > first tag > first text rule > unknown.  Text rules read
    the whole text, or its first ``max_chars`` characters."""
    st, connector = F.col("source_type"), F.coalesce(_col(df, "connector_id"), F.lit(""))
    tags = F.coalesce(_col(df, "tags", NO_TAGS), F.array().cast(NO_TAGS))
    tag_types = tag_types or vocab.TAG_SOURCE_TYPES
    sample = rules.lower_present(F.col("title"), _col(df, "summary"), rules.first_chars(F.col("full_text"), max_chars))

    def decision(value: Column, confidence: str, method: str) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("type"), F.lit(confidence).alias("confidence"),
                                                  F.lit(method).alias("method")))

    by_connector = F.coalesce(*[F.when(connector.startswith(p), F.lit(t)) for p, t in vocab.CONNECTOR_SOURCE_TYPES])
    norm = F.transform(tags, lambda t: F.lower(F.regexp_replace(F.replace(t, F.lit("-"), F.lit("_")), r"\s+", "_")))
    known = F.filter(norm, lambda t: t.isin(list(tag_types)))
    by_tag = rules.lookup(F.get(known, F.lit(0)), tag_types)
    by_text = F.expr("CASE " + " ".join(
        f"WHEN {rules.sql_any('_sample', a)} AND NOT {rules.sql_any('_sample', n)} THEN {rules.sql_str(name)}"
        for name, a, n in (text_rules or vocab.TEXT_TYPE_RULES)) + " END")
    out = df.withColumn("_sample", sample).withColumn("typing", F.coalesce(
        decision(F.when(st.isin(vocab.ALL_SOURCE_TYPES), st), "high", "existing"),
        decision(rules.lookup(st, vocab.LEGACY_SOURCE_TYPES), "medium", "legacy_map"),
        decision(by_connector, "high", "connector_origin"),
        decision(by_tag, "medium", "tag_signal"),
        decision(by_text, "low", "text_signal"),
        decision(F.lit("unknown"), "low", "fallback")))
    return out.withColumns({
        "original_source_type": st, "source_type": F.col("typing.type"),
        "source_type_confidence": F.col("typing.confidence"),
        "source_type_reason": F.col("typing.method")}).drop("_sample", "typing")


def trust_rule(publisher: Column, rules_=None) -> Column:
    """First (phrase, tier) rule whose phrase occurs in the publisher, as struct<tier, reason>."""
    p = F.lower(F.coalesce(publisher, F.lit("")))
    return F.coalesce(*[
        F.when(p.contains(m), F.struct(F.lit(t).alias("tier"), F.lit(f"publisher_match:{m}").alias("reason")))
        for m, t in (rules_ or vocab.PUBLISHER_TIER_RULES)],
        F.struct(F.lit("medium").alias("tier"), F.lit("default_unknown").alias("reason")))


def trust_assess(df: DataFrame, rules_=None) -> DataFrame:
    tier = F.col("trust_tier")
    kept = F.coalesce(tier, F.lit("")).isin("", "unknown")
    rule = F.when(kept, trust_rule(F.col("publisher"), rules_)).otherwise(
        F.struct(tier.alias("tier"), F.lit("connector_assigned").alias("reason")))
    return (df.withColumn("_rule", rule).withColumns({
        "trust_tier": F.col("_rule.tier"), "trust_tier_reason": F.col("_rule.reason"),
        "source_credibility_score": rules.lookup(F.col("_rule.tier"), vocab.TIER_CREDIBILITY, 1)}).drop("_rule")
        .withColumn("credibility_reason", F.format_string(
            "%s tier (%s); score=%d", "trust_tier", "trust_tier_reason", "source_credibility_score")))


def final_gate(df: DataFrame, exempt_tiers=("primary", "high")) -> DataFrame:
    """pass / review / reject with reason and route."""
    bad = ~F.col("is_valid") | (F.col("trust_tier") == "exclude")
    off = F.col("relevance_tier") == "off_topic"
    trusted = F.col("trust_tier").isin(*exempt_tiers)
    review = (F.arrays_overlap("filter_flags", F.array(*[F.lit(f) for f in REVIEW_FLAGS]))
              | (F.col("source_type") == "unknown"))
    status = (F.when(bad, F.lit("reject")).when(off & trusted, F.lit("review")).when(off, F.lit("reject"))
              .when(review, F.lit("review")).otherwise(F.lit("pass")))
    spec = F.concat(F.lit("ai_specificity="), F.col("ai_specificity_score").cast("string"))
    reason = (F.when(bad, F.col("validity_reason"))
              .when(off & trusted, F.concat(F.lit("off_topic_but_trusted: "), spec, F.lit("; trust="), "trust_tier"))
              .when(off, F.concat(F.lit("off_topic: "), spec)).otherwise(F.col("validity_reason")))
    return (df.withColumn("gate_status", status).withColumn("final_validity_reason", reason)
            .withColumn("downstream_route", F.when(F.col("gate_status") == "reject", F.lit("discard"))
                        .when(F.col("gate_status") == "review", F.lit("layer4_with_review")).otherwise(F.lit("layer4"))))


def classify_layer(df: DataFrame, *, exempt_tiers=("primary", "high"), ai=None, cyber=None) -> DataFrame:
    return (df.transform(validity_gate).transform(ai_relevance, ai, cyber).transform(source_type_rules)
            .transform(trust_assess).transform(final_gate, exempt_tiers))


def gate_stats(df: DataFrame) -> DataFrame:
    """Status counts, and flag frequency over rejected rows, as (kind, key, count)."""
    flagged = F.when(F.col("gate_status") == "reject", F.col("filter_flags")).otherwise(F.array().cast(NO_TAGS))
    pairs = F.concat(
        F.array(F.struct(F.lit("status").alias("kind"), F.col("gate_status").alias("key"))),
        F.transform(flagged, lambda f: F.struct(F.lit("reject_flag").alias("kind"), f.alias("key"))))
    return df.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count("*").alias("count"))


def type_change_stats(df: DataFrame) -> DataFrame:
    """Distributions of the typing run and the number of changed types, as (kind, key, count)."""
    scalar = [("source_type", "source_type"), ("reason", "source_type_reason"), ("trust_tier", "trust_tier"),
              ("relevance_tier", "relevance_tier"), ("status", "gate_status")]
    pairs = F.concat(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in scalar]),
        F.transform("filter_flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("key"))),
        F.when(~F.col("source_type").eqNullSafe(F.col("original_source_type")),
               F.array(F.struct(F.lit("changed").alias("kind"), F.lit("source_type").alias("key"))))
        .otherwise(F.array().cast("array<struct<kind:string,key:string>>")))
    return df.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count("*").alias("count"))


def join_known(df: DataFrame, known: DataFrame) -> DataFrame:
    """duplicate_of by stored id, else by stored content hash; null ids and hashes are never known.
    ``known``: (kind, value), distinct.  The known keys that the batch has are found first, from its keys alone, so its
    other columns are joined with those and not with all that is known.  Boilerplate shares one content hash, so hot hashes
    are looked up apart."""
    def met(kind: str, mark: str) -> DataFrame:
        mine = df.select(F.col("id" if kind == "id" else "content_hash").alias("value")).distinct()
        found = known.where(F.col("kind") == kind).join(mine, "value", "left_semi")
        return cut_lineage(found.select(F.col("value").alias(kind), F.lit(True).alias(mark)), "known-keys")
    ids, hashes = met("id", "_by_id"), met("content_hash", "_by_hash")
    out = hot_join(df.join(ids, "id", "left"), hashes, ["content_hash"], how="left")
    return (out.withColumn("duplicate_kind", F.when(F.col("_by_id"), F.lit("duplicate_id"))
                           .when(F.col("_by_hash"), F.lit("duplicate_content")))
            .withColumn("duplicate_of", F.when(F.col("_by_id"), F.col("id")).when(F.col("_by_hash"), F.col("content_hash")))
            .drop("_by_id", "_by_hash"))


def validate_known(df: DataFrame, known: DataFrame, ai=None, cyber=None) -> DataFrame:
    """Stored-record validation: blocking flags, duplicate flags, soft flags and relevance."""
    rows = ai_relevance(join_known(df, known), ai, cyber)
    no_title = F.trim(F.coalesce("title", F.lit(""))) == ""
    status = urls.url_safety_status(F.col("url"))
    no_url = blank(F.col("url"))
    stop = no_title | no_url | (status != "safe")
    off = F.col("relevance_tier") == "off_topic"
    authority = F.coalesce("trust_tier", F.lit("unknown")).isin(AUTHORITATIVE)
    soft = flags(
        (F.col("duplicate_kind"), F.col("duplicate_kind").isNotNull()),
        ("missing_publisher", no_publisher(F.col("publisher"))), ("no_publish_date", F.col("date_published").isNull()),
        ("date_too_old", F.year("date_published") < 2020), ("insufficient_text", text_length(F.col("full_text")) < 50),
        ("low_relevance_authoritative", off & authority), ("low_ai_cyber_relevance", off & ~authority))
    hard = F.when(no_title, F.lit("missing_title")).when(no_url, F.lit("missing_url")).otherwise(F.lit("unsafe_url"))
    out = rows.withColumn("validation_flags", F.when(stop, F.array(hard)).otherwise(soft))
    blocked = F.arrays_overlap("validation_flags", F.array(*[F.lit(f) for f in [*BLOCKING_FLAGS, "low_ai_cyber_relevance"]]))
    return out.withColumns({
        "is_duplicate": ~stop & F.col("duplicate_kind").isNotNull(),
        "duplicate_of": F.when(~stop, F.col("duplicate_of")),
        "is_valid": ~blocked,
        "validity_reason": F.when(F.size("validation_flags") == 0, F.lit("ok")).otherwise(F.array_join("validation_flags", "; ")),
        "url_safety_class": F.when(no_title | no_url, F.lit("unknown")).otherwise(urls.safety_class(status)),
        "relevance_tier": F.when(stop, F.lit("off_topic")).otherwise(F.col("relevance_tier")),
        "ai_relevance_score": F.when(stop, F.lit(0)).otherwise(F.col("ai_relevance_score")),
        "ai_specificity_score": F.when(stop, F.lit(0)).otherwise(F.col("ai_specificity_score"))}).drop("duplicate_kind")


def validation_split(df: DataFrame) -> DataFrame:
    bucket = (F.when(F.col("is_duplicate"), F.lit("duplicate")).when(F.col("is_valid"), F.lit("valid"))
              .otherwise(F.lit("invalid")))
    return df.withColumn("bucket", bucket)


def quick_tags(df: DataFrame, tag_rules: dict | None = None) -> DataFrame:
    t = rules.lower_text(F.col("title"), _col(df, "summary"), F.col("full_text"))
    return (df.withColumn("_text", t)
            .withColumn("tags", rules.labels("_text", tag_rules or vocab.QUICK_TAG_RULES)).drop("_text"))


def eligibility(df: DataFrame, as_of: Column, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Seven report flags and needs_review.  A non-null ``precomputed_daily`` column overrides the
    daily flag."""
    d = F.col("date_published")
    conf = F.coalesce(F.nullif(_col(df, "date_confidence"), F.lit("")), F.lit("exact"))
    sure = d.isNotNull() & (conf != "none")
    daily = sure & (times.in_window(d, *window) if window else times.within_days(d, 1, as_of))
    return df.withColumns({
        "eligible_for_daily_report": F.coalesce(_col(df, "precomputed_daily", "boolean"), daily),
        "eligible_for_weekly_report": sure & times.within_days(d, 7, as_of),
        "eligible_for_monthly_report": sure & times.within_days(d, 30, as_of),
        "eligible_for_horizon_scan": sure & times.within_days(d, 365, as_of),
        "eligible_for_archive": F.lit(True),
        "eligible_for_trend_analysis": text_length(F.col("full_text")) > 200,
        "eligible_for_reference_context": F.coalesce(F.col("trust_tier").isin("curated", "primary", "high"), F.lit(False)),
        "needs_review": conf.isin("none", "low") | F.coalesce(F.col("source_type") == "unknown", F.lit(False))
        | blank(F.col("publisher")) | d.isNull()})


def guess_category(title: Column, body: Column, keywords=None) -> Column:
    return rules.first_label(rules.lower_text(title, body), keywords or vocab.CATEGORY_KEYWORDS)


CANDIDATE = "struct<category:string,confidence:string,supporting_tags:array<string>>"
TAGGED = "struct<tag:string,framework_ref:string,confidence:string>"


def understand_fallback(df: DataFrame, keywords=None) -> DataFrame:
    """Deterministic understanding columns for rows not yet stamped with the current version."""
    out = df.withColumn("_text", rules.lower_text(F.col("title"), F.col("full_text")))
    guess = rules.first_label("_text", keywords or vocab.CATEGORY_KEYWORDS)
    title, pub = F.coalesce("title", F.lit("")), F.coalesce(F.nullif(F.col("publisher"), F.lit("")), F.lit("unknown"))
    empty = F.array().cast(NO_TAGS)
    return out.withColumns({
        "source_summary": F.concat(title, F.lit(". Published by "), pub, F.lit(".")),
        "primary_subject": F.substring(title, 1, 80),
        "main_claims": empty, "important_numbers": empty,
        "key_entities": F.array_compact(F.array(F.nullif(F.col("publisher"), F.lit("")))),
        "framework_tags": F.array().cast("array<struct<tag:string,category_candidate:string,framework_ref:string,confidence:string>>"),
        "attack_mappings": F.array().cast(f"array<{TAGGED}>"),
        "governance_tags": F.array().cast(f"array<{TAGGED}>"),
        "guessed_category": guess,
        "category_candidates": F.when(guess.isNotNull(), F.array(F.struct(
            guess.alias("category"), F.lit("low").alias("confidence"), empty.alias("supporting_tags"))))
        .otherwise(F.array().cast(f"array<{CANDIDATE}>")),
        "taxonomy_version": F.lit(vocab.TAXONOMY_VERSION)}).drop("_text")


def _rank_of(conf: Column, default: int = 0) -> Column:
    return rules.lookup(F.coalesce(conf, F.lit("")), vocab.CONFIDENCE_RANK, default)


def _best_candidate(cands: Column) -> Column:
    """First of the valid candidates by confidence, then supporting tags, then order."""
    scored = F.transform(cands, lambda c, i: F.struct(
        (-_rank_of(c["confidence"])).alias("r"), (-F.coalesce(F.size(c["supporting_tags"]), F.lit(0))).alias("t"),
        i.alias("i"), c["category"].alias("category"), c["confidence"].alias("confidence")))
    best = F.array_min(F.filter(scored, lambda s: s["category"].isin(vocab.CATEGORIES)))
    return F.when(best.isNotNull(), F.struct(best["category"].alias("category"), best["confidence"].alias("confidence")))


def _best_tagged(pairs: Column) -> Column:
    """Most frequent category over array<struct<category, rank>>, then highest rank, then first seen."""
    valid = F.filter(pairs, lambda p: p["category"].isin(vocab.CATEGORIES))
    cats = F.array_distinct(F.transform(valid, lambda p: p["category"]))
    scored = F.transform(cats, lambda c, i: F.struct(
        (-F.size(F.filter(valid, lambda p: p["category"] == c))).alias("n"),
        (-F.array_max(F.transform(F.filter(valid, lambda p: p["category"] == c), lambda p: p["rank"]))).alias("r"),
        i.alias("i"), c.alias("category")))
    best = F.array_min(scored)
    conf = (F.when(-best["r"] >= 3, F.lit("high")).when(-best["r"] >= 2, F.lit("medium")).otherwise(F.lit("low")))
    return F.when(best.isNotNull(), F.struct(best["category"].alias("category"), conf.alias("confidence")))


def pick_category(df: DataFrame, keep: str = "main_category") -> DataFrame:
    """One main category per row from candidates, framework tags, attack mappings or the stored value."""
    none = F.lit(None).cast("struct<category:string,confidence:string>")
    fw = F.transform("framework_tags", lambda t: F.struct(
        t["category_candidate"].alias("category"), _rank_of(t["confidence"], 1).alias("rank")))
    am = F.transform("attack_mappings", lambda t: F.struct(
        F.lit(vocab.ATTACK_CATEGORY_HINT).alias("category"), _rank_of(t["confidence"], 1).alias("rank")))

    def improve(pick: Column, other: Column) -> Column:
        weak = pick.isNull() | F.coalesce(pick["confidence"] == "low", F.lit(False))
        better = _rank_of(other["confidence"]) > _rank_of(F.coalesce(pick["confidence"], F.lit("low")))
        return F.when(weak & other.isNotNull() & better, other).otherwise(pick)

    out = (df.withColumn("_p1", F.coalesce(_best_candidate(F.col("category_candidates")), none))
           .withColumn("_fw", _best_tagged(fw)).withColumn("_am", _best_tagged(am)))
    out = out.withColumn("_p2", improve(F.col("_p1"), F.col("_fw")))
    out = out.withColumn("_p3", improve(F.col("_p2"), F.col("_am")))
    old = _col(df, keep)
    llm = F.coalesce(_col(df, "llm_used", "boolean"), F.lit(False))
    weak = F.col("_p3").isNull() | F.coalesce(F.col("_p3.confidence") == "low", F.lit(False))
    retain = F.coalesce(weak & old.isin(vocab.OFFENSIVE_CATEGORIES) & ~llm, F.lit(False))
    done = F.coalesce(_col(df, "classify_version") == vocab.CLASSIFY_VERSION, F.lit(False))
    return out.withColumns({
        "main_category": F.when(done | retain, old).otherwise(F.coalesce("_p3.category", F.lit(vocab.FALLBACK_CATEGORY))),
        "classification_confidence": F.when(done, _col(df, "classification_confidence"))
        .when(retain, F.lit("low")).otherwise(F.coalesce("_p3.confidence", F.lit("none"))),
        "classify_version": F.lit(vocab.CLASSIFY_VERSION)}).drop("_p1", "_fw", "_am", "_p2", "_p3")


def classify_distribution(df: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit("category").alias("kind"), F.coalesce("main_category", F.lit(vocab.FALLBACK_CATEGORY)).alias("key")),
        F.struct(F.lit("confidence").alias("kind"), F.col("classification_confidence").alias("key")),
        F.struct(F.lit("state").alias("kind"), F.when(F.col("already_done"), F.lit("already_done"))
                 .otherwise(F.lit("newly_done")).alias("key")))
    return df.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count("*").alias("count"))


def understand_counts(df: DataFrame) -> DataFrame:
    """``df`` carries the version before the run and whether a landed result was used."""
    done = F.coalesce(F.col("previous_version") == vocab.TAXONOMY_VERSION, F.lit(False))
    model = F.coalesce("llm_used", F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(done).alias("already_done"),
                  F.count_if(~done & model).alias("processed_by_model"), F.count_if(~done & ~model).alias("fallback"))


def registry(spark) -> DataFrame:
    """Taxonomy registry as a dimension table."""
    return spark.createDataFrame(list(vocab.registry_rows()),
                                 "tag string, taxonomy_group string, framework string, framework_ref string, "
                                 "tactic string, category_hint string")


LANDED_TAG = "struct<tag:string,category_candidate:string,tactic:string,evidence:string,confidence:string>"
LANDED = (f"source_type string, source_summary string, framework_tags array<{LANDED_TAG}>, "
          f"attack_mappings array<{LANDED_TAG}>, governance_tags array<{LANDED_TAG}>, "
          f"category_candidates array<{CANDIDATE}>, main_claims array<string>, "
          "key_entities array<string>, important_numbers array<string>")


def _validated_tags(arr: Column, group: str, limit: int | None, evidence_chars: int | None) -> Column:
    rows = [r for r in vocab.registry_rows() if r[1] == group]

    def table(i: int) -> Column:
        return rules.lit_map({r[0]: r[i] for r in rows}).cast("map<string,string>")

    frame, ref, tactic, hint = (table(i) for i in (2, 3, 4, 5))
    names = rules.lit_array([r[0] for r in rows])
    known = F.filter(F.coalesce(arr, F.array().cast(f"array<{LANDED_TAG}>")), lambda t: F.array_contains(names, t["tag"]))
    return rules.first_items(F.transform(known, lambda t: F.struct(
        t["tag"].alias("tag"),
        F.coalesce(F.element_at(hint, t["tag"]), t["category_candidate"]).alias("category_candidate"),
        F.element_at(frame, t["tag"]).alias("framework"), F.element_at(ref, t["tag"]).alias("framework_ref"),
        F.coalesce(F.element_at(tactic, t["tag"]), t["tactic"], F.lit("")).alias("tactic"),
        rules.first_chars(text.js_trim(F.coalesce(t["evidence"], F.lit(""))), evidence_chars).alias("evidence"),
        rules.enum_exact(t["confidence"], ["high", "medium", "low"], "medium").alias("confidence"))), limit)


def enrichment_validate(df: DataFrame, raw: str, fallback_type: str = "source_type", *, limits: dict[str, int] | None = None) -> DataFrame:
    """Parse landed JSON results in column ``raw`` and keep only what the vocabularies allow.

    ``limits`` may cap a list (by its column) or a text (source_summary, evidence: characters); nothing is cut
    without it.
    """
    most = (limits or {}).get
    out = df.withColumn("_r", F.from_json(raw, LANDED))
    empty = F.array().cast(NO_TAGS)
    st = F.col("_r.source_type")
    summary = F.col("_r.source_summary")
    return out.withColumns({
        "source_type": F.when(st.isin(vocab.ALL_SOURCE_TYPES), st).otherwise(F.coalesce(_col(df, fallback_type), F.lit("unknown"))),
        "source_summary": summary if most("source_summary") is None else F.when(
            F.length(summary) > most("source_summary"), F.concat(F.substring(summary, 1, most("source_summary")), F.lit("…"))).otherwise(summary),
        "framework_tags": _validated_tags(F.col("_r.framework_tags"), "ai_framework_tag", most("framework_tags"), most("evidence")),
        "attack_mappings": _validated_tags(F.col("_r.attack_mappings"), "attack_mapping", most("attack_mappings"), most("evidence")),
        "governance_tags": _validated_tags(F.col("_r.governance_tags"), "governance_tag", most("governance_tags"), most("evidence")),
        "category_candidates": rules.first_items(F.filter(F.coalesce("_r.category_candidates", F.array().cast(f"array<{CANDIDATE}>")),
                                                          lambda c: c["category"].isin(vocab.CATEGORIES)), most("category_candidates")),
        **{c: rules.first_items(F.coalesce(f"_r.{c}", empty), most(c)) for c in ("main_claims", "key_entities", "important_numbers")}}).drop("_r")


def version_number(c: Column) -> Column:
    """The numbers of a name such as ``taxonomy-v6.0`` as an array that compares number by number; none: empty."""
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("bigint"))


def migrate_legacy_tags(df: DataFrame) -> DataFrame:
    """Split a flat ``framework_tags`` array<struct<tag, confidence>> into three groups by registry.

    Rows at the current taxonomy version are left alone; unknown tags are dropped and a
    tag already in its new group is not added again.
    """
    groups = {g: rules.lit_array([r[0] for r in vocab.registry_rows() if r[1] == g])
              for g in ("ai_framework_tag", "attack_mapping", "governance_tag")}
    new = version_number(F.coalesce(_col(df, "taxonomy_version"), F.lit(""))) >= version_number(F.lit(vocab.TAXONOMY_VERSION))

    old = F.col("_old")

    def moved(target: Column, group: str) -> Column:
        have = F.transform(target, lambda t: t["tag"])
        fresh = F.filter(old, lambda t: F.array_contains(groups[group], t["tag"]) & ~F.array_contains(have, t["tag"]))
        first = F.filter(fresh, lambda t, i: F.array_position(F.transform(fresh, lambda x: x["tag"]), t["tag"]) == i + 1)
        return F.concat(target, first)

    # The old tags get their own name: inside a lambda a replaced column's name would mean the new one.
    return df.withColumn("_old", F.col("framework_tags")).withColumns({
        "attack_mappings": F.when(new, F.col("attack_mappings")).otherwise(moved(F.col("attack_mappings"), "attack_mapping")),
        "governance_tags": F.when(new, F.col("governance_tags")).otherwise(moved(F.col("governance_tags"), "governance_tag")),
        "framework_tags": F.when(new, old).otherwise(
            F.filter(old, lambda t: F.array_contains(groups["ai_framework_tag"], t["tag"])))}).drop("_old")


def tags_by_category(df: DataFrame, registry_df: DataFrame) -> DataFrame:
    """Distinct tags and frameworks per category of a tagged corpus.  The collected values come from
    the registry, so a row's arrays are bounded by its size."""
    long = df.select("category", F.explode("framework_tags").alias("t")).select("category", F.col("t.tag").alias("tag")).distinct()
    named = long.join(F.broadcast(registry_df.select("tag", "framework")), "tag")
    return named.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"),
        F.array_join(F.array_sort(F.collect_set("framework")), "|").alias("frameworks"))


def schema_check(df: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """issues: one string per failed field rule (required, enum, min, max)."""
    checks = []
    for name, rule in fields.items():
        c = _col(df, name)
        if rule.get("required"):
            checks.append((f"{name}: required field missing", c.isNull()))
        if "enum" in rule:
            shown = ",".join(rule["enum"][:5])
            checks.append((F.concat(F.lit(f'{name}: "'), c, F.lit(f'" not in enum [{shown}...]')), ~c.isin(rule["enum"])))
        if "min" in rule:
            checks.append((F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(f" below min {rule['min']}")), c < rule["min"]))
        if "max" in rule:
            checks.append((F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(f" above max {rule['max']}")), c > rule["max"]))
    return df.withColumn("issues", flags(*checks)).withColumn("valid", F.size("issues") == 0)


RAW_FIELDS = {
    "id": {"required": True}, "url": {"required": True}, "title": {"required": True},
    "source_type": {"enum": vocab.ALL_SOURCE_TYPES}, "trust_tier": {"enum": vocab.TRUST_TIERS},
}
