"""Ingest composition: normalise, clean, window, deduplicate, accept, validate, tag, flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import rules, text, times, urls
from strandline.operators import classify, dedupe, filters
from strandline.runtime import cut_lineage


def _opt(df: DataFrame, name: str, typ: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(typ)


def _sql(df: DataFrame, name: str, default: str = "''") -> str:
    """An optional text column as SQL, with empty text as the default's trigger."""
    return f"coalesce(nullif({name}, ''), {default})" if name in df.columns else default


def normalize_source(df: DataFrame, as_of: Column) -> DataFrame:
    """Raw items to the record schema with defaults.

    ``has_actual_date`` tells an explicitly null ``date_published_actual`` from an absent one.
    """
    raw_url = F.coalesce(_opt(df, "url"), F.lit(""))
    body = _sql(df, "full_text", _sql(df, "content", _sql(df, "summary")))
    given = _opt(df, "date_published_actual", "timestamp_ntz")
    has_actual = F.coalesce("has_actual_date", F.lit(False)) if "has_actual_date" in df.columns else given.isNotNull()
    tier = F.expr(_sql(df, "trust_tier", "'unknown'"))
    tags = F.coalesce(_opt(df, "tags", "array<string>"), F.array().cast("array<string>"))
    published = F.col("date_published")
    out = df.withColumns({
        "original_url": raw_url, "_canon": urls.canonical_url(urls.upgrade_http(raw_url)), "raw_text": F.expr(body),
        "_body": text.clean_plaintext(body), "_title": text.clean_plaintext(_sql(df, "title")),
        "publisher": text.clean_plaintext(_sql(df, "publisher", "'Unknown'")), "author": text.clean_plaintext(_sql(df, "author")),
        "summary": text.clean_plaintext(_sql(df, "summary")), "raw_html": F.expr(_sql(df, "raw_html"))})
    return out.withColumns({
        "id": urls.source_id(F.col("_canon"), F.concat_ws("|", "_title", "_canon", "_body")),
        "url": F.col("_canon"), "canonical_url": F.col("_canon"), "final_url": F.coalesce(_opt(df, "final_url"), F.col("_canon")),
        "title": F.col("_title"), "full_text": F.col("_body"),
        "date_published_actual": F.when(has_actual, given).otherwise(published),
        "date_discovered": F.coalesce(_opt(df, "date_discovered", "timestamp_ntz"), as_of), "date_collected": as_of,
        "date_confidence": F.coalesce(_opt(df, "date_confidence"),
                                      F.when(published.isNotNull(), F.lit("exact")).otherwise(F.lit("none"))),
        "source_type": F.expr(_sql(df, "source_type", "'unknown'")), "trust_tier": tier,
        "is_curated": F.coalesce(_opt(df, "is_curated", "boolean"), (tier == "curated") | F.array_contains(tags, "curated")),
        "content_hash": F.coalesce(_opt(df, "content_hash"), text.content_hash(F.col("_title"), F.col("_canon"), F.col("_body"))),
        "clean_text_hash": F.sha2("_body", 256)}).drop("_canon", "_title", "_body")


def normalize_sample(df: DataFrame) -> DataFrame:
    """The sample loader's variant: id from title and URL, URL case kept, first row per id."""
    url = urls.canonical_url_sample(F.coalesce("url", F.lit("")))
    title = F.coalesce("title", F.lit(""))
    body = text.clean_plaintext(_sql(df, "text"))
    out = df.select(
        F.substring(F.sha2(F.concat_ws("|", title, url), 256), 1, 36).alias("id"), url.alias("url"), F.trim(title).alias("title"),
        urls.infer_publisher(F.col("publisher"), F.col("url")).alias("publisher"),
        times.parse_date(F.col("published_at")).alias("date_published"), body.alias("full_text"),
        F.sha2(F.concat_ws("|", title, url, body), 256).alias("content_hash"),
        F.monotonically_increasing_id().alias("position") if "position" not in df.columns else F.col("position"))
    return dedupe.dedupe_by_id(out)


def clean_sources(df: DataFrame, *, body_cleaned: bool = False) -> DataFrame:
    """Add cleaned columns to rows not stamped with the current cleaning version.

    ``body_cleaned``: ``full_text`` is ``raw_text`` cleaned, as ``normalize_source`` leaves it; only bodies from which code
    marks are taken are then cleaned again.
    """
    done = F.coalesce(_opt(df, "cleaning_version") == vocab.CLEANING_VERSION, F.lit(False))
    df = df.withColumn("_raw", F.expr(_sql(df, "raw_text", _sql(df, "full_text"))))
    df = df.withColumn("_plain", text.unfenced(F.col("_raw")))
    raw = F.col("_raw")
    if body_cleaned:
        clean = F.when((F.col("_plain") == "") | (F.col("_plain") == raw), F.col("full_text")).otherwise(text.clean_plaintext("_plain"))
    else:
        clean = text.clean_plaintext("CASE WHEN _plain <> '' THEN _plain ELSE _raw END")
    df = df.withColumn("_clean", clean)
    new = {
        "clean_text": F.col("_clean"), "full_text": F.col("_clean"), "title": text.clean_text(_sql(df, "title")), "raw_text": raw,
        "publisher": text.clean_text(_sql(df, "publisher")), "author": text.clean_text(_sql(df, "author")),
        "extracted_code_blocks": text.code_blocks(raw).cast("array<struct<language:string,content:string>>"),
        "extracted_iocs": text.iocs(raw)}
    if "summary" in df.columns:
        new["summary"] = text.clean_plaintext("summary")
    cols = {n: F.when(done, F.col(n)).otherwise(c) if n in df.columns else F.when(~done, c) for n, c in new.items()}
    return df.withColumns({**cols, "cleaning_version": F.lit(vocab.CLEANING_VERSION)}).drop("_raw", "_plain", "_clean")


KEY_COLUMNS = ["url_key", "title_key", "hash_key"]


def _hashed_keys(df: DataFrame) -> list[Column]:
    return [F.sha2(c, 256).alias(k) for k, c in dedupe.exact_keys(df).items()]


def cleaning_layer(df: DataFrame, *, threshold: float = 0.85, skip_near: bool = False):
    """clean -> exact -> near.  Returns (kept, removed) where removed has a reason per row."""
    cleaned = clean_sources(df).withColumn("clean_text_hash", F.sha2("full_text", 256))
    ranked = dedupe.with_rank(dedupe.with_quality(cleaned))
    # The decisions need keys and titles only; texts stay in the source.
    slim = cut_lineage(ranked.select("rank", "id", "position", "title", *_hashed_keys(cleaned)), "cleaned")
    exact = cut_lineage(dedupe.exact_drops(slim, {k: F.col(k) for k in KEY_COLUMNS}), "dedupe-drops")
    left, near = dedupe.dedupe_near_title(slim.join(exact.select("rank"), "rank", "left_anti"), threshold=threshold, skip=skip_near)
    removed = (exact.select("rank", F.lit("exact_duplicate").alias("reason"))
               .unionByName(near.select("rank", F.lit("near_duplicate_title").alias("reason"))))
    kept = ranked.join(left.select("rank"), "rank", "left_semi")
    return kept, slim.select("rank", "id", "position", "title").join(removed, "rank")


def ingest_batch(raw: DataFrame, as_of: Column, window: tuple[Column, Column] | None = None, *,
                 tag_rules: dict | None = None) -> DataFrame:
    """Every input row with the stage it ended at and why, all its columns cleaned and tagged.

    stage: window / duplicate / rejected / invalid / stored.  ``window=None`` skips the
    publish-date filter.  The cleaned rows are written once; decisions are made on their keys and joined by rank, and
    a column that nobody asks for is neither read again nor shuffled.
    """
    rows = cut_lineage(_judged(raw, as_of, window), "ingest-rows")
    decided = _decided(rows.select(*_verdicts(rows))).select("rank", "stage", "reason")
    rows = classify.eligibility(classify.quick_tags(rows.join(decided, "rank"), tag_rules), as_of, window)
    return rows.withColumn("needs_review", F.col("needs_review") | F.col("acceptance.needs_review")) \
        .drop("kept", "window_reason", "acceptance")


def _judged(raw: DataFrame, as_of: Column, window: tuple[Column, Column] | None) -> DataFrame:
    """Rows cleaned, ranked and judged one by one: window, acceptance, validity."""
    cleaned = clean_sources(normalize_source(raw, as_of), body_cleaned=True).withColumn("clean_text_hash", F.sha2("full_text", 256))
    if window is not None:
        cleaned = filters.published_window(cleaned, *window)
    else:
        cleaned = cleaned.withColumn("window_reason", F.lit(None).cast("string")).withColumn("kept", F.lit(True))
    ranked = dedupe.with_rank(dedupe.with_quality(cleaned))
    return classify.structural_validity(filters.filter_acceptable(ranked))


def ingest_decisions(raw: DataFrame, as_of: Column, window: tuple[Column, Column] | None = None) -> DataFrame:
    """rank, position, date_published, stage and reason of every input row: what the funnel, the backfill and other
    counts need.  One pass over the texts writes keys and verdicts; no text is written or shuffled."""
    judged = _judged(raw, as_of, window)
    return _decided(judged.select(*_verdicts(judged)))


def _verdicts(judged: DataFrame) -> list:
    """What decisions are made on: rank, dates, verdicts and hashed keys."""
    return ["rank", "position", "date_published", "kept", "window_reason", "usable", F.col("acceptance.accepted").alias("accepted"),
            F.col("acceptance.reason").alias("why"), *_hashed_keys(judged)]


def _decided(verdicts: DataFrame) -> DataFrame:
    slim = cut_lineage(verdicts, "ingest-verdicts")
    drops = dedupe.exact_drops(slim.where("kept"), {k: F.col(k) for k in KEY_COLUMNS}).select("rank", F.lit(True).alias("_dup"))
    rows = slim.join(drops, "rank", "left").withColumn("_dup", F.coalesce("_dup", F.lit(False)))
    stage = (F.when(~F.col("kept"), F.lit("window")).when(F.col("_dup"), F.lit("duplicate"))
             .when(~F.col("accepted"), F.lit("rejected")).when(~F.col("usable"), F.lit("invalid"))
             .otherwise(F.lit("stored")))
    reason = (F.when(~F.col("kept"), F.col("window_reason")).when(F.col("_dup"), F.lit("duplicate of a better row"))
              .when(~F.col("accepted"), F.col("why"))
              .when(~F.col("usable"), F.lit("Failed validity check")))
    return rows.select("rank", "position", "date_published", stage.alias("stage"), reason.alias("reason"))


STAGES = ["window", "duplicate", "rejected", "invalid", "stored"]


def funnel_counts(ingested: DataFrame) -> DataFrame:
    """(step, rows) of the ingest funnel from one grouped pass over the stage column."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    reached = F.array_position(stages, F.col("stage"))
    steps = F.array(F.lit("raw"), F.lit("within_window"), F.lit("deduped"), F.lit("accepted"), F.lit("usable"))
    passed = F.slice(steps, F.lit(1), reached.cast("int"))
    dropped = F.when(F.col("stage") != "stored", F.array(F.concat(F.lit("removed_"), "stage"))) \
        .otherwise(F.array().cast("array<string>"))
    return ingested.select(F.explode(F.concat(passed, dropped)).alias("step")).groupBy("step").agg(F.count("*").alias("rows"))


def write_observed(ingested: DataFrame, path: str) -> dict[str, int]:
    """Write the rows and return the funnel's counts, observed while they pass: no row is read for counting.

    A repeated write replaces the rows and observes them anew.  Steps that no row reaches count zero.
    """
    seen = Observation("ingest funnel")
    reached = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    names = ["raw", "within_window", "deduped", "accepted", "usable"]
    passed = [F.count_if(reached >= i).alias(n) for i, n in enumerate(names, 1)]
    removed = [F.count_if(F.col("stage") == s).alias(f"removed_{s}") for s in STAGES[:-1]]
    ingested.observe(seen, *passed, *removed).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def backfill_runs(ingested: DataFrame, ts: str = "date_published") -> DataFrame:
    """Raw and saved totals per reporting day: every row is assigned its chunk in one pass."""
    return (ingested.where(F.col(ts).isNotNull()).groupBy(times.day_bucket(F.col(ts)).alias("w"))
            .agg(F.count("*").alias("raw"), F.count_if(F.col("stage") == "stored").alias("saved"))
            .select(F.col("w.start").alias("start_utc"), F.col("w.end").alias("end_utc"), "raw", "saved"))


def curated_import(rows: DataFrame) -> DataFrame:
    """Curated rows per snapshot: usable and dropped counts."""
    checked = classify.structural_validity(rows).withColumn("snapshot_id", times.snapshot_key(F.col("date_published")))
    return checked.groupBy("snapshot_id").agg(F.count_if("usable").alias("count"), F.count_if(~F.col("usable")).alias("discarded_count"))
