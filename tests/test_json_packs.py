import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import q_io
from strandline.sources import jsonarray, scans


def test_arrays_are_written_by_ranges_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_io, "ARRAY_ITEMS", 4)
    seen = []
    monkeypatch.setattr(q_io, "scratch_path", lambda s, label: seen.append(f"{tmp_path}/{label}") or seen[-1])
    texts = {i: f'line {i}\n"}}, {{ [{i}' for i in [*range(11), 40]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["scan_json_array"](spark, str(tmp_path)).collect()
    assert sorted(r["text_hash"] for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts.values())
    files = spark.read.text(seen[0]).inputFiles()
    assert len(files) == 4                                                # ids 0-3, 4-7, 8-10 and 40: no task holds more than a range


@pytest.mark.parametrize("more", [[], [0, 49, 50, 119]])
def test_a_range_is_one_file_when_joins_turn_to_broadcasts(spark, tmp_path, monkeypatch, more):
    """Tables whose size is not known beforehand: the plan may change while it runs, the layout of the files may not.  Ids may repeat."""
    monkeypatch.setattr(q_io, "ARRAY_ITEMS", 50)
    seen = []
    monkeypatch.setattr(q_io, "scratch_path", lambda s, label: seen.append(f"{tmp_path}/{label}") or seen[-1])
    ids = [*range(120), *more]
    spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        rows = entry.queries()["scan_json_array"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted(r["title"] for r in rows) == sorted(f"text {i}" for i in ids)
    assert len(spark.read.text(seen[0]).inputFiles()) == 3


@pytest.mark.parametrize("few", [0, 100])
def test_whole_items_stay_where_they_are(spark, tmp_path, monkeypatch, few):
    """Cut items are put together whether their places are broadcast or not; a string that begins outside of an object is an error."""
    monkeypatch.setattr(jsonarray, "FEW_PIECES", few)
    items = ['{"a": 1}', '{"a": {"b": [{}, {"c": "}{"}]}}', '{"a": "\\"}{\\\\"}', '{"a": 2}']
    (tmp_path / "a.json").write_text("[" + ", ".join(items * 5) + "]")
    assert sorted(r["item"] for r in jsonarray.array_items(spark, str(tmp_path / "a.json")).collect()) == sorted(items * 5)
    (tmp_path / "b.json").write_text('["x}y", {"a": 1}]')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|inside an item"):
        scans.json_records(spark, str(tmp_path / "b.json"), "a int").collect()
