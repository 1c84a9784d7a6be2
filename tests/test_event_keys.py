import __spark_entry__ as entry
from strandline.operators.graph import event_clusters


def test_blank_keys_link_only_when_asked(spark):
    rows = spark.createDataFrame([(1, "", "d1"), (2, "", "d1"), (3, "", "d2"), (4, None, "d1"), (5, None, "d1")], "position long, product string, day string")
    events = lambda **how: {r["position"]: r["event"] for r in event_clusters(rows, [["product", "day"]], **how).collect()}
    assert events() == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert events(blank=True) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_similar_titles_are_one_event(spark, tmp_path):
    """Other CVE, product and day: the titles alone link records 1 and 31, which share a category; 47 has another one, 61 another title."""
    texts = {1: "alpha breach hits cloud servers today", 31: "beta breach hits cloud servers today", 47: "gamma breach hits cloud servers today", 61: "delta something else entirely"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["position"]: r["event_id"] for r in entry.queries()["event_clusters"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 31: 1, 47: 47, 61: 61}
