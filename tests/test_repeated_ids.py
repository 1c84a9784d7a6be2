"""Records that share an id: two pages of one URL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.operators import graph
from strandline.plans import analysis
from strandline.sources import sinks

WORDS = ["alpha", "bravo", "charlie", "delta", "foxtrot", "golf", "hotel", "india"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Eight documents; pages 1 and 2 and pages 3 and 6 have one URL each."""
    root = str(tmp_path_factory.mktemp("twins"))
    docs = spark.createDataFrame([(i, f"{w} {w}ly {w}ness", "en", "src1") for i, w in enumerate(WORDS)], "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{root}/documents.parquet")
    url = {1: "https://a.org/x", 2: "https://a.org/x", 3: "https://a.org/y", 6: "https://a.org/y"}
    spark.createDataFrame([(i, url.get(i, f"https://a.org/{i}"), "") for i in range(8)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.mark.parametrize("name, odd, even", [("sink_sources_upsert", "second", "first")])
def test_upsert_keeps_a_row_for_each_source(spark, tables, name, odd, even):
    rows = entry.queries()[name](spark, tables).collect()
    assert sorted(r["value"] for r in rows) == [even] * 4 + [odd] * 4


def test_replace_and_update_change_the_row_they_name(spark, tables):
    rows = entry.queries()["sink_keyed_replace"](spark, tables).collect()
    assert sorted(r["value"] for r in rows) == ["first"] * 5 + ["second"] * 3
    rows = entry.queries()["sink_enrichment_update"](spark, tables).collect()
    assert sum(r["category"] == "enriched" for r in rows) == 2          # positions 0 and 6; 3 shares the id of 6


def test_one_column_is_still_a_key(spark, tmp_path):
    path = f"{tmp_path}/keyed"
    sinks.replace_by_key(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, n int, v string"), path, "id", 2)
    sinks.replace_by_key(spark.createDataFrame([("a", 2, "z")], "id string, n int, v string"), path, ["id"], 2)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "n", "v").collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_clusters_of_one_record_id_are_counted_apart(spark):
    rows = spark.createDataFrame([(0, "same", "alpha bravo charlie", "c1"), (1, "same", "delta foxtrot golf", "c1"), (2, "other", "delta foxtrot golf", "c1")],
                                 "position long, id string, title string, category string")
    found = graph.cluster_records(rows, F.lit(1))
    assert graph.summarize_clusters(found).first().asDict() == {"total_clusters": 2, "multi_source_clusters": 1, "singleton_clusters": 1, "largest_cluster": 2}
    counted = analysis.rawfact_counts(found.withColumns({"rawfact_priority": F.lit("low"), "evidence_card": F.lit(None).cast("string")})).first()
    assert (counted["clusters"], counted["multi_source_clusters"]) == (2, 1)
