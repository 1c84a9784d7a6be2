"""Duplicate removal that keeps the best copy.

Exact and near duplicates are removed greedily in rank order (quality descending,
then input position): a row goes only if a better row that *stays* matches it.  As
a set of DataFrame rounds this is: keep every undecided row that no undecided
better row matches, drop the rows matched by those, repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules, text, urls
from strandline.operators import similarity
from strandline.operators.skew import HOT_ROWS, lookup_join
from strandline.runtime import cut_lineage

POSITION_BITS = 1 << 48


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key.  The rank limit is applied before the shuffle as well, so a hot
    key sends at most one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_by_id(df: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    return first_per_key(df, [key], [F.col(position)])


def dedupe_first(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """First row per non-empty key; rows without a key are dropped."""
    return first_per_key(df.where(F.coalesce(F.col(key), F.lit("")) != ""), [key], [F.col(position)])


def dedupe_last(df: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    return first_per_key(df, [key], [F.col(position).desc()])


def duplicate_rank(df: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Flag every row that repeats an earlier row's key.

    Only the first position per key is needed, so this is a partial aggregate and a
    lookup, not a window over a possibly hot key.  A null key repeats nothing.
    """
    firsts = (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.min(position).alias("_first"), F.count("*").alias("_n")))
    return (lookup_join(df, cut_lineage(firsts, "duplicate-first"), [key], count_col="_n", how="left")
            .withColumn("seen_before", F.coalesce(F.col(position) > F.col("_first"), F.lit(False))).drop("_first"))


def quality_score(tier: Column, full_text: Column, published: Column, confidence: Column,
                  title: Column) -> Column:
    length = rules.text_length(full_text)
    return (rules.lookup(F.coalesce(tier, F.lit("unknown")), vocab.TIER_QUALITY, 5)
            + rules.ladder(length, [(1001, 20), (501, 12), (201, 6)], 0)
            + rules.points((published.isNotNull(), 8), (confidence == "exact", 5),
                           (confidence == "estimated", 2),
                           (text.has_cve(title) | text.has_cve(full_text), 8)))


def with_quality(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_score", quality_score(
        F.col("trust_tier"), F.col("full_text"), F.col("date_published"),
        F.col("date_confidence"), F.col("title")))


def with_rank(df: DataFrame, position: str = "position") -> DataFrame:
    """Unique sortable rank: higher quality first, then lower position."""
    return df.withColumn(
        "rank", (F.lit(127) - F.col("quality_score")).cast("bigint") * POSITION_BITS + F.col(position))


def _first_rank(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("rank").alias("rank"))


def exact_drops(ranked: DataFrame, keys: dict[str, Column], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rank, kept_rank) of every row that loses to a kept row on one of ``keys``.

    ``ranked`` has a unique ``rank``.  A null key never matches.
    """
    named = ranked.select("rank", *[F.sha2(c, 256).alias(k) for k, c in keys.items()])
    named = named.where(" or ".join(f"{k} is not null" for k in keys))
    named = cut_lineage(named, "dedupe-keys")

    # Rows equal on all keys have the same neighbours: only the best of them can stay.
    reps = _first_rank(named, list(keys))
    long = reps.select("rank", F.explode(F.array_compact(F.array(
        *[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k))) for k in keys]))).alias("key"))
    state = long
    decided = None
    while True:
        per_key = state.groupBy("key").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
        per_key = cut_lineage(per_key.where("n > 1"), "dedupe-best")
        if per_key.isEmpty():
            break
        edges = cut_lineage(lookup_join(state, per_key, ["key"], count_col="n", hot_rows=hot_rows),
                            "dedupe-state")
        kept = edges.groupBy("rank").agg(F.bool_and(F.col("rank") == F.col("best")).alias("keep")) \
            .where("keep").select(F.col("rank").alias("best"))
        won = per_key.join(kept, "best", "left_semi")
        lost = (lookup_join(edges.drop("best"), won, ["key"], count_col="n", hot_rows=hot_rows)
                .where("rank <> best").groupBy("rank").agg(F.min("best").alias("kept_rank")))
        lost = cut_lineage(lost, "dedupe-lost")
        decided = lost if decided is None else decided.unionByName(lost)
        state = cut_lineage(
            edges.select("rank", "key").join(lost, "rank", "left_anti").join(
                kept.withColumnRenamed("best", "rank"), "rank", "left_anti"), "dedupe-open")

    # Copies of a representative, found through one group hash so that null keys match.
    group = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("-")) for k in keys]), 256)
    grouped = named.select("rank", group.alias("group"))
    reps_of = grouped.groupBy("group").agg(F.min("rank").alias("rep"), F.count("*").alias("n"))
    copies = lookup_join(grouped, cut_lineage(reps_of.where("n > 1"), "dedupe-groups"), ["group"],
                         count_col="n", hot_rows=hot_rows).where("rank <> rep").select("rank", "rep")
    if decided is None:
        return copies.select("rank", F.col("rep").alias("kept_rank"))
    # A copy follows its representative: to the row that beat it, else to the representative.
    beaten = decided.withColumnRenamed("rank", "rep").withColumnRenamed("kept_rank", "_by")
    followed = copies.join(beaten, "rep", "left").select(
        "rank", F.coalesce("_by", "rep").alias("kept_rank"))
    return decided.unionByName(followed)


def exact_keys(df: DataFrame) -> dict[str, Column]:
    """Canonical URL, normalised title, and the text hash of texts over 200 characters."""
    url = urls.canonical_url_dedupe(F.col("url"))
    title = text.normalize_title(F.col("title"))
    filled = lambda c: F.get(F.transform(F.array(c), lambda x: F.when(x != "", x)), F.lit(0))  # noqa: E731  (c is evaluated once)
    return {
        "url_key": filled(url),
        "title_key": filled(title),
        "hash_key": F.when(rules.text_length(F.col("full_text")) > 200, F.col("clean_text_hash")),
    }


def dedupe_exact(df: DataFrame, keys: dict[str, Column] | None = None, *,
                 hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Return (kept rows, removed (rank, kept_rank)).  Needs quality inputs and ``position``.

    The rank is kept on the rows so that both results can be joined again.
    """
    ranked = with_rank(with_quality(df))
    drops = cut_lineage(exact_drops(ranked, keys or exact_keys(df), hot_rows=hot_rows), "dedupe-drops")
    return ranked.join(drops.select("rank"), "rank", "left_anti"), drops


def near_title_drops(ranked: DataFrame, *, threshold: float = 0.85, min_shared: int = 3,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rank, kept_rank, similarity) of rows whose title is near a kept better row's title."""
    tokens = text.title_tokens(F.col("title"), vocab.DEDUPE_STOPWORDS, 3)
    rows = ranked.select("rank", tokens.alias("tokens")).where(F.size("tokens") >= min_shared)
    rows = cut_lineage(similarity.with_set_id(rows, "tokens", []), "near-sets")
    sets = rows.groupBy("set_id").agg(F.min("rank").alias("rank"), F.first("tokens").alias("tokens"),
                                      F.count("*").alias("n"))
    sets = cut_lineage(sets, "near-titles")
    pairs = similarity.similar_sets(sets.select(F.col("rank").alias("set_id"), "tokens"), [],
                                    threshold=threshold, min_shared=min_shared, hot_rows=hot_rows)
    edges = cut_lineage(pairs.select(F.greatest("set_a", "set_b").alias("rank"),
                                     F.least("set_a", "set_b").alias("best"), "similarity"), "near-edges")
    open_edges, lost_parts = edges, []
    while not open_edges.isEmpty():
        # A title no undecided better title matches stays.
        worse = open_edges.select(F.col("rank").alias("best")).distinct()
        gone = cut_lineage(open_edges.join(worse, "best", "left_anti").select("rank").distinct(), "near-lost")
        lost_parts.append(gone)
        open_edges = cut_lineage(
            open_edges.join(gone, "rank", "left_anti")
            .join(gone.withColumnRenamed("rank", "best"), "best", "left_anti"), "near-open")
    per_set = sets.select("set_id", F.col("rank").alias("rep"), "n")
    if lost_parts:
        lost_all = reduce(DataFrame.unionByName, lost_parts)
        # The audit names the best kept match, whichever round it was kept in.
        best = (edges.join(lost_all.select(F.col("rank").alias("best")), "best", "left_anti")
                .join(lost_all, "rank", "left_semi").groupBy("rank")
                .agg(F.min(F.struct("best", "similarity")).alias("m"))
                .select(F.col("rank").alias("rep"), F.col("m.best").alias("kept_rank"), "m.similarity"))
        per_set = per_set.join(best, "rep", "left")
    else:
        per_set = per_set.withColumns({"kept_rank": F.lit(None).cast("bigint"),
                                       "similarity": F.lit(None).cast("double")})
    joined = lookup_join(rows.select("rank", "set_id"), cut_lineage(per_set, "near-verdicts"), ["set_id"],
                         count_col="n", hot_rows=hot_rows)
    return (joined.where(F.col("kept_rank").isNotNull() | (F.col("rank") != F.col("rep")))
            .select("rank", F.coalesce("kept_rank", "rep").alias("kept_rank"),
                    F.coalesce("similarity", F.lit(1.0)).alias("similarity")))


def dedupe_near_title(df: DataFrame, *, threshold: float = 0.85, min_shared: int = 3,
                      skip: bool = False, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Return (kept rows, audit rows).  ``skip`` really skips; threshold 1.0 still removes
    rows with the same token set."""
    ranked = df if "rank" in df.columns else with_rank(with_quality(df))
    if skip:
        empty = ranked.limit(0).select("rank", F.col("rank").alias("kept_rank"), F.lit(1.0).alias("similarity"))
        return ranked, empty
    drops = cut_lineage(near_title_drops(ranked, threshold=threshold, min_shared=min_shared,
                                         hot_rows=hot_rows), "near-drops")
    return ranked.join(drops.select("rank"), "rank", "left_anti"), drops


def removal_audit(ranked: DataFrame, drops: DataFrame, reason: str) -> DataFrame:
    """Names for both sides of every removal: removed_id, kept_id, reason (and similarity)."""
    names = ranked.select("rank", "id")
    out = (drops.join(names.withColumnRenamed("id", "removed_id"), "rank")
           .join(names.select(F.col("rank").alias("kept_rank"), F.col("id").alias("kept_id")), "kept_rank"))
    extra = [F.round("similarity", 2).alias("similarity")] if "similarity" in drops.columns else []
    return out.select("removed_id", "kept_id", *extra, F.lit(reason).alias("reason"))


def anti_by_id(all_rows: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    return all_rows.join(kept.select(key).distinct(), key, "left_anti")
