"""Connected components and record clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import text
from strandline.operators import similarity
from strandline.operators.skew import HOT_ROWS, hot_join, lookup_join
from strandline.runtime import Rounds, cut_lineage


def _around(edges: DataFrame, small: bool) -> DataFrame:
    return edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame, small: bool) -> DataFrame:
    """The smallest node around each node, itself included, and the number of its neighbours."""
    least = _around(edges, small).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return least.withColumn("m", F.least("m", "u"))


def _stars(edges: DataFrame, least: DataFrame, small: bool, hot_rows: int) -> DataFrame:
    """One star contraction of canonical edges (u > v).

    Large star: every bigger neighbour of u is attached to the smallest node around u.
    Small star: u and its smaller neighbours are attached to the smallest of them.
    """
    around = _around(edges, small)
    targets = around if small else around.where("v > u")
    moved = lookup_join(targets, least, ["u"], count_col="n", hot_rows=hot_rows)
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node.

    Alternating large-star and small-star contractions: the number of edges never
    grows, long chains halve, and a hub's neighbours are handled row by row.  The rounds
    end when one changes nothing; a round's files are deleted when the next are written.
    """
    canon = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    rounds = Rounds(edges.sparkSession, "cc")
    canon = rounds.put(canon)
    seen = None
    while True:
        for small in (False, True):
            least = rounds.put(_least(canon, small), keep=True)
            canon = rounds.put(_stars(canon, least, small, hot_rows))
        mark = canon.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    roots = canon.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return canon.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def changed_components(stored: DataFrame, links: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, old, component): what new ``links`` (a, b) change in stored (node, component) rows.

    The links are contracted: each end is replaced by its stored component, and only the components that links join
    are searched.  Rows come back for nodes that are new (old is null) and for all nodes of components that are not the
    smallest of those they are joined with; nothing else is touched.  Components are numbered by their smallest node.
    """
    links = cut_lineage(links.select("a", "b").where("a is not null and b is not null").distinct(), "cc-links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = cut_lineage(stored.select("node", "component").join(ends, "node", "left_semi"), "cc-known")
    named = hot_join(links.withColumnRenamed("a", "node"), known, ["node"], how="left", hot_rows=hot_rows) \
        .select(F.coalesce("component", "node").alias("a"), F.col("b").alias("node"))
    named = hot_join(named, known, ["node"], how="left", hot_rows=hot_rows).select("a", F.coalesce("component", "node").alias("b"))
    joined = cut_lineage(connected_components(named.where("a <> b"), hot_rows=hot_rows), "cc-joined")
    moved = joined.where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("to"))
    fresh = ends.join(known.select("node"), "node", "left_anti").withColumn("old", F.lit(None).cast(stored.schema["component"].dataType))
    fresh = fresh.join(moved.withColumnRenamed("old", "node"), "node", "left").select("node", "old", F.coalesce("to", "node").alias("component"))
    held = hot_join(stored.select("node", F.col("component").alias("old")), moved, ["old"], hot_rows=hot_rows).select("node", "old", F.col("to").alias("component"))
    return fresh.unionByName(held)


def title_sets(df: DataFrame, block: str = "category") -> DataFrame:
    """Rows with cluster tokens and the id of their (block, token set)."""
    tokens = text.title_tokens(F.col("title"), vocab.CLUSTER_STOPWORDS, 4)
    return similarity.with_set_id(df.withColumn("tokens", tokens), "tokens", [block], unique="position")


def cluster_records(df: DataFrame, score: Column, *, block: str = "category", threshold: float = 0.35,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add cluster columns: titles in one block whose token sets are linked by similarity.

    The cluster id is ``cl_`` and a hash of the smallest member id, so it does not depend
    on row order.  Clusters that share that record id share it too; ``component`` tells them apart.
    The representative has the highest score, then the lowest position.
    """
    rows = title_sets(df.withColumn("_score", score), block)
    order = F.struct((-F.col("_score")).alias("s"), F.col("position").alias("p"), F.col("id").alias("id"),
                     F.col("title").alias("title"))
    sets = cut_lineage(rows.groupBy("set_id").agg(
        F.first(block).alias(block), F.first("tokens").alias("tokens"), F.count("*").alias("n"),
        F.min(order).alias("best"), F.min("id").alias("min_id")), "cluster-sets")
    pairs = similarity.spanning_links(sets.where(F.size("tokens") > 0).select("set_id", "tokens", block), [block],
                                      threshold=threshold, hot_rows=hot_rows)
    parts = connected_components(pairs.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")),
                                 hot_rows=hot_rows)
    labelled = sets.drop("tokens").join(parts.withColumnRenamed("node", "set_id"), "set_id", "left") \
        .withColumn("component", F.coalesce("component", "set_id"))
    labelled = cut_lineage(labelled, "cluster-labels")
    clusters = labelled.groupBy("component").agg(
        F.sum("n").alias("cluster_size"), F.min("best").alias("best"), F.min("min_id").alias("min_id"),
        F.count("*").alias("_sets"))
    meta = lookup_join(labelled.select("set_id", "n", "component"), cut_lineage(clusters, "cluster-meta"),
                       ["component"], count_col="_sets", hot_rows=hot_rows).select(
        "set_id", "n", "cluster_size", "component",
        F.concat(F.lit("cl_"), F.substring(F.sha2("min_id", 256), 1, 12)).alias("cluster_id"),
        F.col("best.id").alias("representative_id"), F.col("best.title").alias("representative_title"))
    out = lookup_join(rows.drop("_score", "tokens"), cut_lineage(meta, "cluster-sets-meta"), ["set_id"],
                      count_col="n", hot_rows=hot_rows)
    multi = F.col("cluster_size") > 1
    return (out.drop("set_id")
            .withColumn("is_multi_source", multi)
            .withColumn("is_representative", ~multi | (F.col("id") == F.col("representative_id")))
            .withColumn("cluster_theme", F.concat(F.coalesce(F.col(block), F.lit("unknown")), F.lit(" — "),
                                                  F.substring("representative_title", 1, 50))))


def summarize_clusters(clustered: DataFrame) -> DataFrame:
    one = clustered.groupBy("component").agg(F.max("cluster_size").alias("size"))
    return one.agg(
        F.count("*").alias("total_clusters"), F.count_if(F.col("size") > 1).alias("multi_source_clusters"),
        F.count_if(F.col("size") == 1).alias("singleton_clusters"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest_cluster"))


def event_clusters(rows: DataFrame, keys: list[list[str]], titles: DataFrame | None = None, *,
                   blank: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records of one event: equal on one of ``keys`` (tried as separate edge sets), or linked by
    ``titles`` (a, b) pairs.  Returns (position, event), event being the smallest position.

    Rows equal on a key are linked to the key's first position: a star instead of all pairs.  Nulls link nothing;
    empty strings only with ``blank``, which makes them a value like any other.
    """
    parts = []
    for cols in keys:
        named = rows.select("position", *cols)
        for c in cols:
            named = named.where(F.col(c).isNotNull() if blank else F.coalesce(F.col(c), F.lit("")) != "")
        firsts = named.groupBy(*cols).agg(F.min("position").alias("b"), F.count("*").alias("n")).where("n > 1")
        star = lookup_join(named, cut_lineage(firsts, "event-keys"), cols, count_col="n", hot_rows=hot_rows)
        parts.append(star.where("position <> b").select(F.col("position").alias("a"), "b"))
    if titles is not None:
        parts.append(titles.select("a", "b"))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    comp = connected_components(edges, hot_rows=hot_rows).select(F.col("node").alias("position"), "component")
    return rows.select("position").join(comp, "position", "left").select(
        "position", F.coalesce("component", "position").alias("event"))
