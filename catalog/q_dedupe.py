"""Deduplication, similarity and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import cte, query
from catalog.views import sources, sql_canonical_url, sql_list, sql_map, table
from strandline import vocab
from strandline.functions import text, urls
from strandline.operators import dedupe, graph, similarity
from strandline.runtime import cut_lineage, scratch_path
from strandline.sources import sinks


def hashed(spark, sf):
    return sources(spark, sf).withColumn("clean_text_hash", F.sha2("full_text", 256))


cte("quality", f"""
  SELECT *, {sql_map('trust_tier', vocab.TIER_QUALITY, '5')}
     + CASE WHEN length(full_text) > 1000 THEN 20 WHEN length(full_text) > 500 THEN 12
            WHEN length(full_text) > 200 THEN 6 ELSE 0 END
     + CASE WHEN date_published IS NOT NULL THEN 8 ELSE 0 END
     + CASE date_confidence WHEN 'exact' THEN 5 WHEN 'estimated' THEN 2 ELSE 0 END
     + CASE WHEN regexp_matches(title || ' ' || full_text, '(?i)CVE-[0-9]{{4}}-[0-9]+') THEN 8 ELSE 0 END AS quality_score
  FROM sources""", ["sources"])

cte("ranked", f"""
  SELECT *, row_number() OVER (ORDER BY quality_score DESC, position) AS rk,
     list_filter([
       CASE WHEN coalesce(url, '') <> '' THEN 'u:' || {sql_canonical_url('url', vocab.DEDUPE_PARAMS)} END,
       CASE WHEN norm <> '' THEN 't:' || norm END,
       CASE WHEN length(full_text) > 200 THEN 'h:' || sha256(full_text) END], lambda x: x IS NOT NULL) AS keys
  FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm
        FROM quality)""", ["quality"])

# The greedy walk itself: one step per row in rank order, carrying the keys seen so far.
cte("walk", """
  SELECT 0::BIGINT AS rk, []::VARCHAR[] AS seen, false AS kept
  UNION ALL
  SELECT r.rk, CASE WHEN list_has_any(w.seen, r.keys) THEN w.seen ELSE list_concat(w.seen, r.keys) END,
         NOT list_has_any(w.seen, r.keys)
  FROM walk w JOIN ranked r ON r.rk = w.rk + 1""", ["ranked"])


@query("quality_score", "SELECT position, quality_score::INT AS quality_score FROM quality", ["quality"])
def _(spark, sf):
    return dedupe.with_quality(sources(spark, sf)).select("position", "quality_score")


@query("dedupe_exact", "SELECT r.position, r.id FROM walk w JOIN ranked r USING (rk) WHERE w.kept", ["ranked", "walk"])
def _(spark, sf):
    kept, _drops = dedupe.dedupe_exact(hashed(spark, sf))
    return kept.select("position", "id")


@query("anti_removed_exact", """
  SELECT DISTINCT s.id AS removed_id, 'exact_duplicate' AS reason FROM sources s
  WHERE s.id NOT IN (SELECT r.id FROM walk w JOIN ranked r USING (rk) WHERE w.kept)""", ["ranked", "walk"])
def _(spark, sf):
    rows = hashed(spark, sf)
    kept, _drops = dedupe.dedupe_exact(rows)
    return (dedupe.anti_by_id(rows, kept).select(F.col("id").alias("removed_id")).distinct()
            .withColumn("reason", F.lit("exact_duplicate")))


cte("near_tokens", f"""
  SELECT position, id, row_number() OVER (ORDER BY quality_score DESC, position) AS rk,
     list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'),
       lambda x: length(x) > 2 AND NOT list_contains({sql_list(vocab.DEDUPE_STOPWORDS)}, x))) AS tokens
  FROM quality""", ["quality"])
cte("near_pairs", """
  SELECT a.rk AS better, b.rk AS worse, count(*) AS shared,
         count(*) / (any_value(len(a.tokens)) + any_value(len(b.tokens)) - count(*)) AS sim
  FROM (SELECT rk, tokens, unnest(tokens) AS t FROM near_tokens) a
  JOIN (SELECT rk, tokens, unnest(tokens) AS t FROM near_tokens) b ON a.t = b.t AND a.rk < b.rk
  GROUP BY ALL HAVING count(*) >= 3
     AND count(*) / (any_value(len(a.tokens)) + any_value(len(b.tokens)) - count(*)) >= 0.85""".replace(
    "GROUP BY ALL", "GROUP BY a.rk, b.rk"), ["near_tokens"])
cte("near_rows", """
  SELECT t.rk, t.id, t.position, coalesce(list(p.better) FILTER (p.better IS NOT NULL), []) AS nb
  FROM near_tokens t LEFT JOIN near_pairs p ON p.worse = t.rk GROUP BY t.rk, t.id, t.position""",
    ["near_tokens", "near_pairs"])
cte("near_walk", """
  SELECT 0::BIGINT AS rk, []::BIGINT[] AS keepers, false AS kept
  UNION ALL
  SELECT r.rk, CASE WHEN list_has_any(w.keepers, r.nb) THEN w.keepers ELSE list_append(w.keepers, r.rk) END,
         NOT list_has_any(w.keepers, r.nb)
  FROM near_walk w JOIN near_rows r ON r.rk = w.rk + 1""", ["near_rows"])


@query("dedupe_near_title", """
  SELECT removed_id, kept_id, round(sim, 2) AS similarity, 'near_duplicate_title' AS reason FROM (
    SELECT x.position, x.id AS removed_id, k.id AS kept_id, p.sim,
           row_number() OVER (PARTITION BY x.rk ORDER BY p.better) AS o
    FROM near_walk w JOIN near_tokens x ON x.rk = w.rk AND NOT w.kept
    JOIN near_pairs p ON p.worse = x.rk JOIN near_walk kw ON kw.rk = p.better AND kw.kept
    JOIN near_tokens k ON k.rk = p.better) WHERE o = 1""", ["near_walk"])
def _(spark, sf):
    rows = dedupe.with_rank(dedupe.with_quality(sources(spark, sf)))
    _kept, drops = dedupe.dedupe_near_title(rows)
    return dedupe.removal_audit(rows, drops, "near_duplicate_title")


cte("near_sets", """
  SELECT array_to_string(list_sort(tokens), ' ') AS k, any_value(list_sort(tokens)) AS tokens,
         any_value(len(tokens)) AS n, count(*) AS m
  FROM near_tokens WHERE len(tokens) >= 3 GROUP BY 1""", ["near_tokens"])


@query("similar_title_join", """
  SELECT least(a.k, b.k) AS title_a, greatest(a.k, b.k) AS title_b, count(*)::INT AS shared,
         round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 4) AS similarity,
         any_value(a.m * b.m)::BIGINT AS record_pairs
  FROM (SELECT *, unnest(tokens) AS t FROM near_sets) a JOIN (SELECT *, unnest(tokens) AS t FROM near_sets) b
    ON a.t = b.t AND a.k < b.k
  GROUP BY a.k, b.k HAVING count(*) >= 3 AND count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85
  UNION ALL SELECT k, k, n::INT, 1.0, (m * (m - 1) // 2)::BIGINT FROM near_sets WHERE m > 1""", ["near_sets"])
def _(spark, sf):
    """Pairs of distinct title token sets; ``record_pairs`` counts the record pairs behind each, so
    copies are counted without being paired."""
    tokens = text.title_tokens(F.col("title"), vocab.DEDUPE_STOPWORDS, 3)
    rows = sources(spark, sf).select(F.array_sort(tokens).alias("tokens")).where(F.size("tokens") >= 3)
    sets = rows.groupBy("tokens").agg(F.count("*").alias("m")).withColumn("set_id", F.array_join("tokens", " "))
    pairs = similarity.similar_sets(sets.select("set_id", "tokens"), [], threshold=0.85, min_shared=3)
    a = sets.select(F.col("set_id").alias("set_a"), F.col("m").alias("ma"))
    b = sets.select(F.col("set_id").alias("set_b"), F.col("m").alias("mb"))
    cross = pairs.join(a, "set_a").join(b, "set_b").select(
        F.col("set_a").alias("title_a"), F.col("set_b").alias("title_b"), "shared",
        F.round("similarity", 4).alias("similarity"), (F.col("ma") * F.col("mb")).alias("record_pairs"))
    same = sets.where("m > 1").select(
        F.col("set_id").alias("title_a"), F.col("set_id").alias("title_b"), F.size("tokens").alias("shared"),
        F.lit(1.0).alias("similarity"), F.expr("m * (m - 1) div 2").alias("record_pairs"))
    return cross.unionByName(same)


cte("cl_tokens", f"""
  SELECT position, id, title, category, quality_score,
     list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'),
       lambda x: length(x) > 3 AND NOT list_contains({sql_list(vocab.CLUSTER_STOPWORDS)}, x))) AS tokens
  FROM quality""", ["quality"])
cte("cl_edges", """
  SELECT a.position AS a, b.position AS b
  FROM (SELECT position, category, tokens, unnest(tokens) AS t FROM cl_tokens) a
  JOIN (SELECT position, category, tokens, unnest(tokens) AS t FROM cl_tokens) b
    ON a.t = b.t AND a.category = b.category AND a.position <> b.position
  GROUP BY a.position, b.position
  HAVING count(*) / (any_value(len(a.tokens)) + any_value(len(b.tokens)) - count(*)) >= 0.35""", ["cl_tokens"])
cte("cl_reach", """
  SELECT position AS node, position AS label FROM cl_tokens
  UNION
  SELECT e.b, r.label FROM cl_reach r JOIN cl_edges e ON e.a = r.node""", ["cl_tokens", "cl_edges"])
cte("cl_nodes", "SELECT node AS position, min(label) AS component FROM cl_reach GROUP BY node", ["cl_reach"])
cte("cl_meta", """
  SELECT component, count(*) AS cluster_size, min(t.id) AS min_id,
         arg_min(t.id, (-t.quality_score)::BIGINT * 1000000000 + t.position) AS rep_id,
         arg_min(t.title, (-t.quality_score)::BIGINT * 1000000000 + t.position) AS rep_title
  FROM cl_nodes n JOIN cl_tokens t USING (position) GROUP BY component""", ["cl_nodes"])
cte("clustered", """
  SELECT t.position, t.id, t.title, t.category, 'cl_' || left(sha256(m.min_id), 12) AS cluster_id, m.cluster_size,
         m.cluster_size > 1 AS is_multi_source, m.cluster_size = 1 OR t.id = m.rep_id AS is_representative,
         m.rep_title AS representative_title, t.category || ' — ' || left(m.rep_title, 50) AS cluster_theme
  FROM cl_nodes n JOIN cl_tokens t USING (position) JOIN cl_meta m USING (component)""", ["cl_meta"])


cte("cl_sets", """
  SELECT category, array_to_string(list_sort(tokens), ' ') AS k, any_value(tokens) AS tokens, any_value(len(tokens)) AS n
  FROM cl_tokens WHERE len(tokens) > 0 GROUP BY 1, 2""", ["cl_tokens"])


@query("category_title_join", """
  SELECT category, least(a.k, b.k) AS title_a, greatest(a.k, b.k) AS title_b, count(*)::INT AS shared,
         round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 4) AS similarity
  FROM (SELECT *, unnest(tokens) AS t FROM cl_sets) a JOIN (SELECT *, unnest(tokens) AS t FROM cl_sets) b
    USING (category, t) WHERE a.k < b.k GROUP BY category, a.k, b.k
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.35""", ["cl_sets"])
def _(spark, sf):
    tokens = text.title_tokens(F.col("title"), vocab.CLUSTER_STOPWORDS, 4)
    sets = (sources(spark, sf).select("category", F.array_sort(tokens).alias("tokens")).where(F.size("tokens") > 0)
            .distinct().withColumn("set_id", F.array_join(F.concat(F.array("category"), F.col("tokens")), " ")))
    pairs = similarity.similar_sets(sets, ["category"], threshold=0.35)
    strip = lambda c: F.regexp_replace(c, "^[^ ]+ ", "")
    return pairs.select(F.substring_index("set_a", " ", 1).alias("category"), strip("set_a").alias("title_a"),
                        strip("set_b").alias("title_b"), "shared", F.round("similarity", 4).alias("similarity"))


def clustered(spark, sf):
    return graph.cluster_records(dedupe.with_quality(sources(spark, sf)), F.col("quality_score"))


def title_links(spark, sf):
    """Links of the title graph over positions: spanning links between titles, copies of one title in a star.

    Titles are cut to tokens once; a set is named by its smallest position, so links need no names joined to them.
    """
    rows = cut_lineage(graph.title_sets(sources(spark, sf)).select("position", "set_id", "tokens", "category"), "title-rows")
    sets = cut_lineage(rows.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.first("category").alias("category"),
                                                  F.min("position").alias("low"), F.count("*").alias("n")), "title-sets")
    pairs = similarity.spanning_links(sets.where(F.size("tokens") > 0).select(F.col("low").alias("set_id"), "tokens", "category"),
                                      ["category"], threshold=0.35)
    copies = (rows.join(sets.where("n > 1").select("set_id", "low"), "set_id").where("position <> low")
              .select(F.col("position").alias("a"), F.col("low").alias("b")))
    return pairs.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).unionByName(copies)


@query("connected_components", "SELECT position, component FROM cl_nodes WHERE position IN (SELECT a FROM cl_edges)",
       ["cl_nodes", "cl_edges"])
def _(spark, sf):
    """Components of the title graph; a node per record, numbered by the smallest position."""
    return graph.connected_components(title_links(spark, sf)).select(F.col("node").alias("position"), "component")


@query("components_by_batch", "SELECT position, component FROM cl_nodes WHERE position IN (SELECT a FROM cl_edges)",
       ["cl_nodes", "cl_edges"])
def _(spark, sf):
    """The same graph, its links stored in two batches, the second of which holds a third of the first again."""
    links = cut_lineage(title_links(spark, sf), "title-links")
    path = scratch_path(spark, "components")
    part = F.pmod(F.xxhash64("a", "b"), F.lit(6))
    for batch in (part < 3, part >= 2):
        sinks.append_links(links.where(batch), path, 16)
    return spark.read.parquet(path).select(F.col("node").alias("position"), "component")


@query("cluster_records", "SELECT * FROM clustered", ["clustered"])
def _(spark, sf):
    return clustered(spark, sf).select(
        "position", "id", "title", "category", "cluster_id", "cluster_size", "is_multi_source",
        "is_representative", "representative_title", "cluster_theme")


@query("cluster_summary", """
  SELECT count(*) AS total_clusters, count_if(cluster_size > 1)::BIGINT AS multi_source_clusters,
         count_if(cluster_size = 1)::BIGINT AS singleton_clusters, max(cluster_size) AS largest_cluster
  FROM cl_meta""", ["cl_meta"])
def _(spark, sf):
    return graph.summarize_clusters(clustered(spark, sf))


@query("cluster_representative", "SELECT cluster_id, id FROM clustered WHERE is_multi_source AND is_representative",
       ["clustered"])
def _(spark, sf):
    return clustered(spark, sf).where("is_multi_source and is_representative").select("cluster_id", "id")


@query("dedupe_by_id", """SELECT position, id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS o FROM sources) WHERE o = 1""", ["sources"])
def _(spark, sf):
    return dedupe.dedupe_by_id(sources(spark, sf)).select("position", "id")


@query("dedupe_first_url", """
  SELECT page_id, url_key FROM (SELECT page_id, url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS o
  FROM (SELECT page_id, """ + sql_canonical_url("url", vocab.TRACKING_PARAMS) + """ AS url_key FROM pages)) WHERE o = 1""")
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumn("url_key", urls.canonical_url(F.col("url")))
    return dedupe.dedupe_first(pages, "url_key", "page_id").select("page_id", "url_key")


@query("dedupe_last_id", """SELECT position, id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY position DESC) AS o FROM sources) WHERE o = 1""", ["sources"])
def _(spark, sf):
    return dedupe.dedupe_last(sources(spark, sf)).select("position", "id")


@query("duplicate_rank", """SELECT position, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY position) > 1 AS seen_before
  FROM (SELECT position, CASE WHEN position % 7 <> 0 THEN title END AS k FROM sources)""", ["sources"])
def _(spark, sf):
    """Every seventh key is missing."""
    keyed = sources(spark, sf).withColumn("k", F.when(F.col("position") % 7 != 0, F.col("title")))
    return dedupe.duplicate_rank(keyed, "k").select("position", "seen_before")


@query("content_hash", "SELECT position, sha256(title || '|' || coalesce(url, '') || '|' || full_text) AS content_hash FROM sources",
       ["sources"])
def _(spark, sf):
    return sources(spark, sf).select("position", text.content_hash(F.col("title"), F.col("url"), F.col("full_text"))
                                     .alias("content_hash"))


@query("clean_text_hash", "SELECT position, sha256(full_text) AS clean_text_hash FROM sources", ["sources"])
def _(spark, sf):
    return hashed(spark, sf).select("position", "clean_text_hash")
