"""Stored queries, joins to stored keys, windows over the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cte, query
from catalog.q_functions import sql_clean_plaintext, sql_clean_text
from catalog.views import (AS_OF, TEST_TAGS, as_of, pick, sources, sql_canonical_url, sql_labels, sql_list, sql_map, sql_pick, table,
                           tagged)
from strandline import vocab
from strandline.functions import text, times, urls
from strandline.operators import aggregate, classify, filters, intervals, joins
from strandline.plans import ingest
from strandline.runtime import scratch_path
from strandline.sources import dated, scans, sinks, trigrams

LO, HI = "2024-06-01 00:00:00", "2024-09-01 00:00:00"
PRIORITIES = ["critical", "high", "medium", "low", "background", "odd"]


def ntz(s: str):
    return F.lit(s).cast("timestamp_ntz")


def prioritised(spark, sf):
    """Tagged sources with a stored priority score and label, and a missing category now and then."""
    p = F.col("position")
    return tagged(spark, sf).withColumns({
        "priority_score": ((p * 37) % 101).cast("int"), "priority_label": pick(p, PRIORITIES),
        "category": F.when(p % 9 != 0, F.col("category"))})


cte("prioritised", f"""SELECT * EXCLUDE (category), ((position * 37) % 101)::INT AS priority_score, {sql_pick('position', PRIORITIES)} AS priority_label,
  CASE WHEN position % 9 <> 0 THEN category END AS category FROM tagged""", ["tagged"])


@query("list_sources", f"""SELECT position, id, date_published FROM tagged
  WHERE date_published >= TIMESTAMP '{LO}' AND date_published < TIMESTAMP '{HI}' AND publisher ILIKE '%SRC%' AND list_contains(tags, 'the')
  ORDER BY date_published DESC, id""", ["tagged"])
def _(spark, sf):
    return filters.list_sources(tagged(spark, sf), start=ntz(LO), end=ntz(HI), publisher="SRC", tag="the").select(
        "position", "id", "date_published")


@query("archive_query", f"""SELECT position, id FROM tagged
  WHERE date_published >= TIMESTAMP '{LO}' AND publisher ILIKE '%src%' AND source_type = 'incident' AND trust_tier = 'primary' AND list_contains(tags, 'the')
  ORDER BY date_published DESC, id""", ["tagged"])
def _(spark, sf):
    return filters.list_sources(tagged(spark, sf), start=ntz(LO), publisher="src", source_type="incident", trust_tier="primary",
                                tag="the").select("position", "id")


@query("newest_page", "SELECT position, id, date_published FROM sources ORDER BY date_published DESC NULLS FIRST, id LIMIT 100", ["sources"])
def _(spark, sf):
    """A page of a table laid out by date, stored in two batches, the second of which holds all rows."""
    path = scratch_path(spark, "dated")
    rows = sources(spark, sf).select("position", "id", "date_published")
    for batch in (rows.where("position % 2 = 0"), rows):
        sinks.append_new(batch, path, ["id"], [F.asc("position")], ["month"], dated.by_date)
    return dated.newest_page(spark.read.parquet(path), 100).select("position", "id", "date_published")


@query("dated_window", f"""SELECT position, id FROM sources WHERE date_published >= TIMESTAMP '{LO}' AND date_published < TIMESTAMP '{HI}'""", ["sources"])
def _(spark, sf):
    """A window over the same layout."""
    path = scratch_path(spark, "dated")
    dated.by_date(sources(spark, sf).select("position", "id", "date_published")).write.partitionBy("month").parquet(path)
    return dated.between(spark.read.parquet(path), ntz(LO), ntz(HI)).select("position", "id")


SQL_AS_OF_END = f"(date_trunc('day', TIMESTAMP '{AS_OF}' + INTERVAL 2 HOUR) - INTERVAL 2 HOUR)"


@query("period_query", f"""SELECT position, id, date_published FROM sources
  WHERE date_published >= {SQL_AS_OF_END} - INTERVAL 90 DAY AND date_published < {SQL_AS_OF_END} ORDER BY date_published DESC, id""", ["sources"])
def _(spark, sf):
    return filters.period_query(sources(spark, sf), as_of(), "quarterly").select("position", "id", "date_published")


@query("daily_query", f"""SELECT position, id, date_published FROM sources
  WHERE date_published >= {SQL_AS_OF_END} - INTERVAL 1 DAY AND date_published < {SQL_AS_OF_END} ORDER BY date_published DESC, id""", ["sources"])
def _(spark, sf):
    return filters.period_query(sources(spark, sf), as_of(), "daily").select("position", "id", "date_published")


@query("horizon_load", f"""SELECT position, id FROM sources
  WHERE date_confidence <> 'none' AND date_published > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND date_published >= TIMESTAMP '{LO}'
    AND date_published < TIMESTAMP '{HI}' AND category IN ('llm_threats', 'agentic_ai_threats') ORDER BY date_published DESC, id""", ["sources"])
def _(spark, sf):
    flagged = classify.eligibility(sources(spark, sf), as_of())
    return filters.horizon_load(flagged, ntz(LO), ntz(HI), categories=["llm_threats", "agentic_ai_threats"]).select("position", "id")


def with_hash(spark, sf):
    return sources(spark, sf).withColumn("content_hash", F.sha2("full_text", 256))


@query("known_identifiers", f"""
  SELECT DISTINCT 'id' AS kind, id AS value FROM sources WHERE date_published >= TIMESTAMP '{LO}'
  UNION ALL SELECT DISTINCT 'content_hash', sha256(full_text) FROM sources WHERE date_published >= TIMESTAMP '{LO}'""", ["sources"])
def _(spark, sf):
    return filters.known_identifiers(with_hash(spark, sf), ntz(LO))


@query("lookup_by_key", "SELECT position, title FROM sources WHERE id = (SELECT id FROM sources WHERE position = 42)", ["sources"])
def _(spark, sf):
    s = sources(spark, sf)
    wanted = F.substring(F.sha2(F.lit("doc:42"), 256), 1, 36)
    key = s.where("position = 42").select(F.coalesce(F.col("id"), wanted)).first()
    return filters.lookup_by_key(s, "id", key[0] if key else None).select("position", "title")


def snapshots(spark, sf):
    """One snapshot per reporting day of the events."""
    days = table(spark, sf, "events").groupBy(times.day_bucket(F.col("ts")).alias("w")).agg(F.count("*").alias("count"))
    return days.select(F.concat(F.lit("snapshot-"), F.date_format(times.to_local(F.col("w.end")), "yyyy-MM-dd")).alias("snapshot_id"),
                       F.col("w.start").alias("start_utc"), F.col("w.end").alias("end_utc"), "count")


cte("snapshots", """SELECT 'snapshot-' || strftime(d + INTERVAL 30 HOUR, '%Y-%m-%d') AS snapshot_id, d - INTERVAL 2 HOUR AS start_utc,
  d + INTERVAL 22 HOUR AS end_utc, count(*) AS count FROM (SELECT date_trunc('day', ts + INTERVAL 2 HOUR) AS d FROM events) GROUP BY d""")


@query("list_snapshots", """SELECT * FROM snapshots WHERE end_utc >= TIMESTAMP '2024-01-10' AND start_utc < TIMESTAMP '2024-01-13'
  ORDER BY end_utc DESC""", ["snapshots"])
def _(spark, sf):
    return filters.list_snapshots(snapshots(spark, sf), F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))


@query("snapshot_members", """SELECT s.snapshot_id, e.event_id FROM snapshots s JOIN events e
  ON s.snapshot_id = 'snapshot-' || strftime(e.ts + INTERVAL 26 HOUR, '%Y-%m-%d')""", ["snapshots"])
def _(spark, sf):
    rows = table(spark, sf, "events").select(times.snapshot_key(F.col("ts")).alias("snapshot_id"), F.col("event_id").alias("id"),
                                             F.col("ts").alias("date_published"))
    return filters.snapshot_members(snapshots(spark, sf), rows).select("snapshot_id", F.col("id").alias("event_id"))


@query("snapshot_overlaps", """SELECT s.snapshot_id, o.o_orderkey AS order_id FROM snapshots s JOIN (
    SELECT o_orderkey, min_ts + to_seconds((o_orderkey * 7919) % 7776000) AS a, min_ts + to_seconds((o_orderkey * 7919) % 7776000 + (o_orderkey % 40) * 3600) AS b
    FROM orders, (SELECT min(ts) AS min_ts FROM events)) o ON s.start_utc < o.b AND o.a < s.end_utc""", ["snapshots"])
def _(spark, sf):
    """Which snapshots a period of up to 39 hours touches, for every order; the periods start within 90 days of the first event."""
    first = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    key = F.col("o_orderkey")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    at = micros(F.lit(first)) + (key * 7919) % 7776000 * 1000000
    periods = table(spark, sf, "orders").select(key.alias("order_id"), at.alias("s"), (at + key % 40 * 3600 * 1000000).alias("e"))
    taken = snapshots(spark, sf).select("snapshot_id", micros(F.col("start_utc")).alias("s"), micros(F.col("end_utc")).alias("e"))
    pairs = intervals.overlap_join(periods, taken, left_span=("s", "e"), right_span=("s", "e"))
    return pairs.select(F.col("right.snapshot_id").alias("snapshot_id"), F.col("left.order_id").alias("order_id"))


def reports(spark, sf):
    """One report per customer-day of the orders table stands in for report runs."""
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("deck-"), F.col("o_orderkey").cast("string")).alias("deck_id"),
                    F.col("o_orderdate").alias("generated_at"), F.col("o_custkey").alias("source_count"))


cte("reports", "SELECT 'deck-' || o_orderkey AS deck_id, o_orderdate AS generated_at, o_custkey AS source_count FROM orders")


@query("latest_report", "SELECT deck_id, generated_at FROM reports ORDER BY generated_at DESC, deck_id LIMIT 1", ["reports"])
def _(spark, sf):
    return filters.list_reports(reports(spark, sf), ["deck_id", "generated_at"], 1)


@query("list_reports", "SELECT deck_id, generated_at, source_count FROM reports ORDER BY generated_at DESC, deck_id", ["reports"])
def _(spark, sf):
    return filters.list_reports(reports(spark, sf), ["deck_id", "generated_at", "source_count"])


SQL_SEARCH = "(contains(lower(title), 'ent') OR contains(lower(publisher), 'ent') OR len(list_filter(tags, lambda t: contains(t, 'ent'))) > 0)"


@query("search_archive", f"""SELECT position, id, date_published FROM prioritised
  WHERE coalesce(category, 'uncategorised') = 'uncategorised' AND list_contains(tags, 'elle') AND {SQL_SEARCH}""", ["prioritised"])
def _(spark, sf):
    return filters.search(prioritised(spark, sf), " ENT", category=vocab.UNCATEGORISED, tag="elle").select(
        "position", "id", "date_published")


@query("search_feed", f"SELECT position, priority_score FROM prioritised WHERE priority_label = 'high' AND {SQL_SEARCH}", ["prioritised"])
def _(spark, sf):
    return filters.search(prioritised(spark, sf), "ent", priority="high", sort="priority").select("position", "priority_score")


@query("search_indexed", "SELECT position FROM prioritised WHERE contains(lower(title), 'tion') OR contains(lower(publisher), 'tion') OR len(list_filter(tags, lambda t: contains(lower(t), 'tion'))) > 0", ["prioritised"])
def _(spark, sf):
    """The same substring search through stored trigram lists, built in two batches, the second of which holds all rows."""
    path = scratch_path(spark, "trigrams")
    rows = prioritised(spark, sf).select("position", "title", "publisher", "tags")
    for batch in (rows.where("position % 2 = 0"), rows):
        trigrams.add(batch, path)
    return trigrams.search(spark, path, " TION").select(F.col("key").alias("position"))


@query("group_by_category", f"""
  SELECT b.bucket, p.position, p.priority_score FROM (SELECT unnest({sql_list(vocab.OFFENSIVE_CATEGORIES + ['ai_for_security', 'uncategorised'])}) AS bucket) b
  LEFT JOIN (SELECT *, CASE WHEN list_contains({sql_list(vocab.OFFENSIVE_CATEGORIES + ['ai_for_security'])}, category) THEN category ELSE 'uncategorised' END AS bucket
             FROM prioritised) p USING (bucket)""", ["prioritised"])
def _(spark, sf):
    """The legacy category has no rows here, so its bucket shows as an empty one."""
    order = vocab.OFFENSIVE_CATEGORIES + [vocab.LEGACY_CATEGORY]
    return filters.group_by_category(prioritised(spark, sf), order).select("bucket", "position", "priority_score")


def scored_specificity(spark, sf):
    return prioritised(spark, sf).withColumn("ai_specificity_score", F.col("priority_score"))


@query("purge_filter", """SELECT position, CASE WHEN priority_score < 10 AND trust_tier <> 'curated' THEN 'low_specificity'
  WHEN category IS NULL AND len(tags) = 0 THEN 'unclassified_untagged' END AS purge_reason FROM prioritised""", ["prioritised"])
def _(spark, sf):
    return filters.purge_split(scored_specificity(spark, sf)).select("position", "purge_reason")


@query("filter_published_window", f"""SELECT position, date_published IS NOT NULL AND date_published >= TIMESTAMP '{LO}' AND date_published < TIMESTAMP '{HI}' AS kept,
  CASE WHEN date_published IS NULL THEN 'Missing valid published date' WHEN date_published < TIMESTAMP '{LO}' OR date_published >= TIMESTAMP '{HI}'
       THEN 'Published date outside reporting window' END AS window_reason FROM sources""", ["sources"])
def _(spark, sf):
    return filters.published_window(sources(spark, sf), ntz(LO), ntz(HI)).select("position", "kept", "window_reason")


SQL_REASON = (f"CASE WHEN coalesce(title, '') = '' OR coalesce(url, '') = '' THEN 'Missing title or URL' "
              f"WHEN trust_tier = 'curated' OR list_contains({sql_list(vocab.ALL_SOURCE_TYPES)}, source_type) THEN NULL "
              "ELSE 'Unsupported source_type: ' || source_type END")


@query("filter_acceptable", f"""SELECT position, {SQL_REASON} IS NULL AS accepted, ({SQL_REASON} IS NULL AND trust_tier <> 'curated' AND source_type = 'unknown') AS needs_review,
  {SQL_REASON} AS reason FROM sources""", ["sources"])
def _(spark, sf):
    return filters.filter_acceptable(sources(spark, sf)).select("position", "acceptance.*")


# --- joins ---------------------------------------------------------------------
cte("known", "SELECT DISTINCT id, sha256(full_text) AS h FROM sources WHERE position % 3 = 0", ["sources"])


def known(spark, sf):
    return filters.known_identifiers(with_hash(spark, sf).where("position % 3 = 0"))


@query("join_known_ids", """
  SELECT position, CASE WHEN s.id IN (SELECT id FROM known) THEN 'duplicate_id' WHEN sha256(full_text) IN (SELECT h FROM known) THEN 'duplicate_content' END AS duplicate_kind
  FROM sources s""", ["known"])
def _(spark, sf):
    """Every third row counts as stored, so the others show copies under another id."""
    return classify.join_known(with_hash(spark, sf), known(spark, sf)).select("position", "duplicate_kind")


TRUST_RULES = [("src1", "primary"), ("src", "high"), ("unk", "low")]


@query("lookup_trust_rule", """SELECT position, CASE WHEN contains(lower(publisher), 'src1') THEN 'primary' WHEN contains(lower(publisher), 'src') THEN 'high'
  WHEN contains(lower(publisher), 'unk') THEN 'low' ELSE 'medium' END AS tier FROM sources""", ["sources"])
def _(spark, sf):
    rule_table = spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(TRUST_RULES)], "rule_no int, match string, tier string")
    return joins.first_rule(sources(spark, sf), rule_table, F.lower("publisher"), "tier", "medium").select("position", "tier")


LEGACY_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LEGACY_SOURCE_TYPES.items())


@query("lookup_legacy_type", f"SELECT position, CASE source_type {LEGACY_SQL} ELSE source_type END AS source_type FROM sources", ["sources"])
def _(spark, sf):
    legacy = spark.createDataFrame(list(vocab.LEGACY_SOURCE_TYPES.items()), "source_type string, new_type string")
    return (sources(spark, sf).join(F.broadcast(legacy), "source_type", "left")
            .select("position", F.coalesce("new_type", "source_type").alias("source_type")))


# --- ingest --------------------------------------------------------------------
@query("union_all", "SELECT position, 'a' AS part FROM sources WHERE position % 2 = 0 UNION ALL SELECT position, 'b' FROM sources WHERE position % 3 = 0", ["sources"])
def _(spark, sf):
    s = sources(spark, sf)
    parts = {"a": s.where("position % 2 = 0"), "b": s.where("position % 3 = 0")}
    return joins.union_connectors(parts).select("position", F.col("connector").alias("part"))


@query("union_connectors", "SELECT position, 'c' || position % 4 AS connector FROM sources WHERE position % 4 < 2", ["sources"])
def _(spark, sf):
    """Four connectors by id; only two are asked for."""
    s = sources(spark, sf)
    parts = {f"c{i}": s.where(F.col("position") % 4 == i) for i in range(4)}
    return joins.union_connectors(parts, only=["c0", "c1"]).select("position", "connector")


@query("connector_stats", """SELECT 'c' || position % 4 AS connector, 'success' AS status, count(*) AS count, NULL::VARCHAR AS error FROM sources GROUP BY position % 4
  UNION ALL SELECT 'broken', 'failed', 0, 'read failed'""", ["sources"])
def _(spark, sf):
    rows = sources(spark, sf).withColumn("connector", F.concat(F.lit("c"), (F.col("position") % 4).cast("string")))
    return joins.connector_stats(rows, {"broken": "read failed"})


@query("feed_registry", """SELECT position, source_type, trust_tier, 'rss' AS retrieval_method FROM (
  SELECT s.position, r.source_type, r.trust_tier, r.enabled FROM sources s JOIN (
    SELECT publisher, mode(source_type ORDER BY source_type) AS st, min(source_type) AS source_type, min(trust_tier) AS trust_tier, length(publisher) > 4 AS enabled FROM sources GROUP BY publisher) r USING (publisher)) WHERE enabled""", ["sources"])
def _(spark, sf):
    """The registry is a file the user supplies; here it is derived from the publishers."""
    s = sources(spark, sf)
    registry = s.groupBy("publisher").agg(
        F.min("source_type").alias("source_type"), F.min("trust_tier").alias("trust_tier")).withColumns({
            "retrieval_method": F.lit("rss"), "enabled": F.length("publisher") > 4})
    path = scratch_path(spark, "registry")
    registry.write.json(path)
    return joins.stamp_from_registry(s.drop("source_type", "trust_tier"), scans.feed_registry(spark, path).select(*registry.columns)).select(
        "position", "source_type", "trust_tier", "retrieval_method")


WINDOW_SQL = f"date_published >= TIMESTAMP '{LO}' AND date_published < TIMESTAMP '2025-02-01'"
WINDOW = (LO, "2025-02-01 00:00:00")


ING_QUALITY = (sql_map("trust_tier", vocab.TIER_QUALITY, "5") + """ + CASE WHEN length(cf) > 1000 THEN 20 WHEN length(cf) > 500 THEN 12
     WHEN length(cf) > 200 THEN 6 ELSE 0 END + CASE WHEN date_published IS NOT NULL THEN 8 ELSE 0 END
     + CASE date_confidence WHEN 'exact' THEN 5 WHEN 'estimated' THEN 2 ELSE 0 END""")


def ingested(spark, sf, window=WINDOW):
    w = tuple(ntz(x) for x in window) if window else None
    return ingest.ingest_batch(sources(spark, sf), as_of(), w, tag_rules=TEST_TAGS)


def decided(spark, sf, window=WINDOW):
    w = tuple(ntz(x) for x in window) if window else None
    return ingest.ingest_decisions(sources(spark, sf), as_of(), w)


cte("ing_clean", f"""
  SELECT position, id, date_published, trust_tier, source_type, date_confidence, cu AS url, ct AS title, cp AS publisher, cf AS full_text,
    {ING_QUALITY} AS quality_score,
    trim(regexp_replace(regexp_replace(lower(ct), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm
  FROM (SELECT *, {sql_canonical_url("coalesce(url, '')", vocab.TRACKING_PARAMS)} AS cu, {sql_clean_plaintext('title')} AS ct,
               {sql_clean_plaintext('publisher')} AS cp, {sql_clean_plaintext('full_text')} AS cf FROM sources)""", ["sources"])


def _ingest_ctes(suffix: str, window: str) -> list[str]:
    """Greedy walk over the rows inside the window, then the stage of every row."""
    cte(f"ing_ranked{suffix}", f"""
      SELECT *, row_number() OVER (ORDER BY quality_score DESC, position) AS rk,
        list_filter([CASE WHEN url <> '' THEN 'u:' || {sql_canonical_url('url', vocab.DEDUPE_PARAMS)} END,
          CASE WHEN norm <> '' THEN 't:' || norm END, CASE WHEN length(full_text) > 200 THEN 'h:' || sha256(full_text) END], lambda x: x IS NOT NULL) AS keys
      FROM ing_clean WHERE {window}""", ["ing_clean"])
    cte(f"ing_walk{suffix}", f"""
      SELECT 0::BIGINT AS rk, []::VARCHAR[] AS seen, false AS kept UNION ALL
      SELECT r.rk, CASE WHEN list_has_any(w.seen, r.keys) THEN w.seen ELSE list_concat(w.seen, r.keys) END, NOT list_has_any(w.seen, r.keys)
      FROM ing_walk{suffix} w JOIN ing_ranked{suffix} r ON r.rk = w.rk + 1""", [f"ing_ranked{suffix}"])
    cte(f"ing{suffix}", f"""
      SELECT position, date_published, CASE WHEN NOT coalesce({window}, false) THEN 'window' WHEN NOT kept THEN 'duplicate'
        WHEN {SQL_REASON} IS NOT NULL THEN 'rejected' WHEN NOT usable THEN 'invalid' ELSE 'stored' END AS stage
      FROM (SELECT c.*, w.kept, c.url LIKE 'https:%' AND 50 - CASE WHEN c.publisher IN ('', 'Unknown') THEN 10 ELSE 0 END
            - CASE WHEN c.date_published IS NULL THEN 15 WHEN c.date_confidence = 'low' THEN 5 WHEN c.date_confidence = 'none' THEN 8 ELSE 0 END
            + CASE WHEN length(c.full_text) >= 500 THEN 15 WHEN length(c.full_text) >= 50 THEN 5 ELSE -5 END >= 25 AS usable
            FROM ing_clean c LEFT JOIN ing_ranked{suffix} r USING (position) LEFT JOIN ing_walk{suffix} w ON w.rk = r.rk)""",
        ["ing_clean", f"ing_walk{suffix}"])
    return [f"ing{suffix}"]


IN_WINDOW = _ingest_ctes("_w", WINDOW_SQL)
NO_WINDOW = _ingest_ctes("_all", "true")


@query("ingest_batch", "SELECT position, stage FROM ing_w", IN_WINDOW)
def _(spark, sf):
    return ingested(spark, sf).select("position", "stage")


@query("flagship_top_tags", f"""
  SELECT t AS key, count(*) AS count FROM (SELECT unnest({sql_labels("lower(c.title || '  ' || c.full_text)", TEST_TAGS)}) AS t
    FROM ing_all i JOIN ing_clean c USING (position) WHERE i.stage = 'stored') GROUP BY t ORDER BY count DESC, key LIMIT 10""", [*NO_WINDOW, "ing_clean"])
def _(spark, sf):
    """Clean, deduplicate, accept, validate and tag all records, then the ten most frequent tags."""
    stored = ingested(spark, sf, None).where("stage = 'stored'")
    return aggregate.top_n(aggregate.count_by_array(stored, "tags"), 10)


@query("ingest_no_window", "SELECT position, stage FROM ing_all", NO_WINDOW)
def _(spark, sf):
    return decided(spark, sf, None).select("position", "stage")


@query("funnel_counts", """
  SELECT step, count(*) AS rows FROM (
    SELECT unnest(['raw', 'within_window', 'deduped', 'accepted', 'usable'][1:list_position(['window', 'duplicate', 'rejected', 'invalid', 'stored'], stage)]) AS step FROM ing_w
    UNION ALL SELECT 'removed_' || stage FROM ing_w WHERE stage <> 'stored') GROUP BY step""", IN_WINDOW)
def _(spark, sf):
    return ingest.funnel_counts(decided(spark, sf))


@query("funnel_observed", """
  SELECT s.step, count(x.step) AS rows FROM (SELECT unnest(['raw', 'within_window', 'deduped', 'accepted', 'usable', 'removed_window', 'removed_duplicate', 'removed_rejected', 'removed_invalid']) AS step) s
  LEFT JOIN (SELECT unnest(['raw', 'within_window', 'deduped', 'accepted', 'usable'][1:list_position(['window', 'duplicate', 'rejected', 'invalid', 'stored'], stage)]) AS step FROM ing_w
    UNION ALL SELECT 'removed_' || stage FROM ing_w WHERE stage <> 'stored') x USING (step) GROUP BY s.step""", IN_WINDOW)
def _(spark, sf):
    """The funnel as counted by the pass that writes the rows."""
    seen = ingest.write_observed(decided(spark, sf), scratch_path(spark, "funnel"))
    return spark.createDataFrame(sorted(seen.items()), "step string, rows bigint")


cte("lay_clean", f"""
  SELECT position, id, url, ct AS title, cf AS full_text, {ING_QUALITY} AS quality_score,
    trim(regexp_replace(regexp_replace(lower(ct), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm
  FROM (SELECT *, {sql_clean_text('title')} AS ct, {sql_clean_plaintext('full_text')} AS cf FROM sources)""", ["sources"])
cte("lay_ranked", f"""
  SELECT *, row_number() OVER (ORDER BY quality_score DESC, position) AS rk,
    list_filter([CASE WHEN coalesce(url, '') <> '' THEN 'u:' || {sql_canonical_url('url', vocab.DEDUPE_PARAMS)} END,
      CASE WHEN norm <> '' THEN 't:' || norm END, CASE WHEN length(full_text) > 200 THEN 'h:' || sha256(full_text) END], lambda x: x IS NOT NULL) AS keys,
    list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'),
      lambda x: length(x) > 2 AND NOT list_contains({sql_list(vocab.DEDUPE_STOPWORDS)}, x))) AS tokens FROM lay_clean""", ["lay_clean"])
cte("lay_walk", """SELECT 0::BIGINT AS rk, []::VARCHAR[] AS seen, false AS kept UNION ALL
  SELECT r.rk, CASE WHEN list_has_any(w.seen, r.keys) THEN w.seen ELSE list_concat(w.seen, r.keys) END, NOT list_has_any(w.seen, r.keys)
  FROM lay_walk w JOIN lay_ranked r ON r.rk = w.rk + 1""", ["lay_ranked"])
cte("lay_kept", "SELECT position, tokens, row_number() OVER (ORDER BY r.rk) AS k FROM lay_ranked r JOIN lay_walk w USING (rk) WHERE w.kept", ["lay_walk"])
cte("lay_near", """SELECT a.k AS better, b.k AS worse FROM (SELECT k, tokens, unnest(tokens) AS t FROM lay_kept) a JOIN (SELECT k, tokens, unnest(tokens) AS t FROM lay_kept) b
  ON a.t = b.t AND a.k < b.k GROUP BY a.k, b.k HAVING count(*) >= 3 AND count(*) / (any_value(len(a.tokens)) + any_value(len(b.tokens)) - count(*)) >= 0.85""", ["lay_kept"])
cte("lay_rows", "SELECT t.k, t.position, coalesce(list(p.better) FILTER (p.better IS NOT NULL), []) AS nb FROM lay_kept t LEFT JOIN lay_near p ON p.worse = t.k GROUP BY t.k, t.position",
    ["lay_kept", "lay_near"])
cte("lay_walk2", """SELECT 0::BIGINT AS k, []::BIGINT[] AS keepers, false AS kept UNION ALL
  SELECT r.k, CASE WHEN list_has_any(w.keepers, r.nb) THEN w.keepers ELSE list_append(w.keepers, r.k) END, NOT list_has_any(w.keepers, r.nb)
  FROM lay_walk2 w JOIN lay_rows r ON r.k = w.k + 1""", ["lay_rows"])


@query("cleaning_layer", """SELECT position, 'exact_duplicate' AS reason FROM lay_ranked JOIN lay_walk USING (rk) WHERE NOT kept
  UNION ALL SELECT position, 'near_duplicate_title' FROM lay_rows JOIN lay_walk2 USING (k) WHERE NOT kept""", ["lay_walk", "lay_walk2"])
def _(spark, sf):
    _kept, removed = ingest.cleaning_layer(sources(spark, sf))
    return removed.select("position", "reason")


@query("backfill_runs", """SELECT d - INTERVAL 2 HOUR AS start_utc, d + INTERVAL 22 HOUR AS end_utc, count(*) AS raw, count_if(stage = 'stored')::BIGINT AS saved
  FROM (SELECT *, date_trunc('day', date_published + INTERVAL 2 HOUR) AS d FROM ing_all WHERE date_published IS NOT NULL) GROUP BY d""", NO_WINDOW)
def _(spark, sf):
    return ingest.backfill_runs(decided(spark, sf, None))


@query("curated_import", """
  SELECT 'snapshot-' || strftime(date_published + INTERVAL 26 HOUR, '%Y-%m-%d') AS snapshot_id, count_if(ok)::BIGINT AS count, count_if(NOT ok)::BIGINT AS discarded_count
  FROM (SELECT *, coalesce(url LIKE 'https:%', false) AS ok FROM sources WHERE trust_tier = 'curated' AND date_published IS NOT NULL) GROUP BY 1""", ["sources"])
def _(spark, sf):
    return ingest.curated_import(sources(spark, sf).where("trust_tier = 'curated' and date_published is not null"))
