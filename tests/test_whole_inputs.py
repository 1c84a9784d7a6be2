"""Signals behind the limits that earlier versions had by default, repeated and missing keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import text, times
from strandline.operators import classify, dedupe, filters, taxonomy
from strandline.operators.skew import lookup_join
from strandline.sources import scans, sinks
from strandline.streaming import ingest as streams

FAR = "neutral words about nothing. " * 400


def test_relevance_reads_the_whole_text(spark):
    phrase = vocab.AI_SIGNALS["high"][0]
    df = spark.createDataFrame([("t", FAR + phrase)], "title string, full_text string")
    assert classify.ai_relevance(df).first()["ai_relevance_score"] > 0
    assert classify.ai_relevance(df, max_chars=2000).first()["ai_relevance_score"] == 0


def test_type_rules_read_the_whole_text(spark):
    df = spark.createDataFrame([("t", FAR + "zzmarker", None)], "title string, full_text string, source_type string")
    rules = [("incident", ["zzmarker"], [])]
    assert classify.source_type_rules(df, rules).first()["source_type"] == "incident"
    assert classify.source_type_rules(df, rules, max_chars=3000).first()["source_type"] == "unknown"


def test_language_reads_the_whole_text(spark):
    df = spark.createDataFrame([("t", "a" * 500 + "é" * 2000)], "title string, full_text string")
    none = F.lit(None).cast("string")
    got = df.select(text.detect_language(F.col("title"), none, F.col("full_text")).alias("whole"),
                    text.detect_language(F.col("title"), none, F.col("full_text"), max_chars=500).alias("head")).first()
    assert (got["whole"], got["head"]) == ("non_english", "en")


def test_taxonomy_lists_are_whole(spark):
    tags = [f"tag{i}" for i in range(14)]
    everything = " ".join(p for _, ps in vocab.TECHNOLOGY_RULES.items() for p in ps) + " " + " ".join(p for _, ps in vocab.GEOGRAPHY_RULES.items() for p in ps)
    df = spark.createDataFrame([("t", everything, "incident", tags)], "title string, full_text string, source_type string, tags array<string>")
    row = taxonomy.rawfact_taxonomy(df).first()
    assert row["rawfact_tags"] == tags
    assert len(row["technology"]) == len(vocab.TECHNOLOGY_RULES) and len(row["geography"]) == len(vocab.GEOGRAPHY_RULES)
    short = taxonomy.rawfact_taxonomy(df, limits={"rawfact_tags": 10, "technology": 8, "geography": 5}).first()
    assert (len(short["rawfact_tags"]), len(short["technology"]), len(short["geography"])) == (10, 8, 5)


def test_queries_return_all_rows_unless_asked(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("date_published"))
    assert filters.list_sources(df).count() == 6000 and filters.list_sources(df, limit=7).count() == 7
    spans = spark.sql("SELECT date'2024-01-01' AS lo, date'2024-03-01' AS hi")
    assert times.day_windows(spans, "lo", "hi").count() == 61 and times.day_windows(spans, "lo", "hi", 14).count() == 14


def test_missing_keys_repeat_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "position long, k string")
    assert [r["seen_before"] for r in dedupe.duplicate_rank(df, "k").orderBy("position").collect()] == [False, False, True, False]
    per_key = spark.createDataFrame([("a", 5, 1)], "k string, n long, v int")
    left = lookup_join(df, per_key, ["k"], count_col="n", how="left", hot_rows=2)
    assert sorted((r["position"], r["v"]) for r in left.collect()) == [(1, 1), (2, None), (3, 1), (4, None)]


@pytest.mark.parametrize("keys", [3, 30])
def test_any_number_of_hot_keys(spark, keys, monkeypatch):
    from strandline.operators import skew
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 5)
    rows = spark.range(900).select((F.col("id") % keys).alias("k"), "id")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
    out = lookup_join(rows, per_key, ["k"], count_col="n", hot_rows=10)
    assert out.count() == 900 and out.where("v <> k").count() == 0


def test_repeated_keys_in_a_batch(spark, tmp_path):
    path = f"{tmp_path}/keyed"
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, v int")
    sinks.replace_by_key(rows, path, "id", 4, order=[F.asc("v")])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v").collect()) == [("a", 1), ("b", 3)]
    sinks.update_by_key(spark.createDataFrame([("a", 8), ("a", 7)], "id string, v int"), path, "id", ["v"], 4, order=[F.asc("v")])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v").collect()) == [("a", 7), ("b", 3)]


def test_every_file_must_hold_an_array(spark, tmp_path):
    for name, body in (("1.json", '[{"title": "a"}]'), ("2.json", '\n [{"title": "b"}, {"title": "c"}]')):
        (tmp_path / name).write_text(body)
    assert scans.json_records(spark, str(tmp_path), "title string").count() == 3
    (tmp_path / "3.json").write_text('{"title": "d"}')
    with pytest.raises(ValueError, match="3.json"):
        scans.json_records(spark, str(tmp_path), "title string")


def test_versions_compare_as_numbers(spark):
    df = spark.createDataFrame([("taxonomy-v10.0",), ("taxonomy-v5.9",), (None,)], "v string")
    new = classify.version_number(F.coalesce("v", F.lit(""))) >= classify.version_number(F.lit("taxonomy-v6.0"))
    assert [r["n"] for r in df.select(new.alias("n")).collect()] == [True, False, False]


def test_metrics_of_every_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i,)], "v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.file_stream(spark, f"{tmp_path}/in", "v long", max_files=1)
    streams.drain(stream, f"{tmp_path}/ck", streams.counted_batch(f"{tmp_path}/metrics", streams.append_batch(f"{tmp_path}/out")))
    rows = streams.run_metrics(spark, f"{tmp_path}/metrics").collect()
    assert len(rows) == 3 and sum(r["input_rows"] for r in rows) == 3


def test_no_text_in_the_shared_folder(spark, monkeypatch):
    """Ingest and scoring write ids, hashes and verdicts; the longest value they write is a hash or a title."""
    from catalog import load_all
    load_all()
    from catalog import q_analysis
    from catalog.views import as_of, sources
    from strandline import runtime
    from strandline.plans import analysis, ingest
    written = []
    for module in [m for n, m in __import__("sys").modules.items() if n.startswith("strandline.") and hasattr(m, "cut_lineage")]:
        monkeypatch.setattr(module, "cut_lineage", lambda df, label, f=runtime.cut_lineage: written.append((label, df.columns)) or f(df, label))
    df = sources(spark, "/root/testdata/sf0.001")
    ingest.funnel_counts(ingest.ingest_decisions(df, as_of())).collect()
    ingest.cleaning_layer(df)[1].count()
    analysis.two_pass_score(q_analysis.base(spark, "/root/testdata/sf0.001"), as_of()).select("position", "rawfact_score").count()
    assert len(written) > 5
    assert not [w for w in written if {"full_text", "clean_text", "raw_text", "raw_html"} & set(w[1])]
