"""Costly columns that a filter reads are written once, not derived again for each use."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import aggregate, score


def test_convergence_reads_written_themes(spark, tmp_path):
    rows = [("a", ["x", "y"]), ("b", ["x", "y", ""]), ("b", ["x"]), ("c", ["z"]), ("a", None), (None, ["x"])]
    spark.createDataFrame(rows, "category string, recurring_themes array<string>").write.parquet(f"{tmp_path}/rows")
    got = aggregate.convergence_edges(spark.read.parquet(f"{tmp_path}/rows"))
    assert not any(str(tmp_path) in f for f in got.inputFiles())
    assert [tuple(r) for r in got.collect()] == [("a", "b", 2, "x|y")]


def test_feed_cards_are_those_of_feed_evidence(spark):
    rows = [(1, "u", "high"), (1, "v", "low"), (2, None, "must_read"), (2, None, "must_read"), (3, None, "low"), (4, "w", None)]
    df = spark.createDataFrame(rows, "position bigint, url string, feed_priority string").withColumns({
        "title": F.concat(F.lit("t"), "position"), "source_summary": F.lit("s"), "main_claims": F.array(F.col("url")),
        "important_numbers": F.array(F.lit("7"))})
    want = score.feed_evidence(df).where("evidence_card is not null")
    got = score.feed_cards(df)
    assert sorted(map(str, got.select("position", "url", "evidence_card").collect())) == sorted(map(str, want.select("position", "url", "evidence_card").collect()))
    assert got.count() == 3
