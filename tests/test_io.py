"""Scans, sinks and streams on small landed files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strandline.runtime import shared_dir
from strandline.sources import scans, sinks
from strandline.streaming import ingest as streams


def test_json_must_be_an_array(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"title": "a", "url": "u"},\n {"title": "b"}]')
    (tmp_path / "bad.json").write_text('{"title": "a"}')
    assert scans.json_records(spark, str(tmp_path / "ok.json")).count() == 2
    with pytest.raises(Exception, match="does not hold a JSON array"):
        scans.json_records(spark, str(tmp_path / "bad.json")).count()
    with pytest.raises(AnalysisException):
        scans.json_records(spark, str(tmp_path / "missing.json"))


def test_feed_priorities(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss><channel>
      <item><title><![CDATA[A &amp; <b>B</b>]]></title><link>https://x.org/1</link><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate><description>D</description></item>
      <item><title>No link</title></item>
      <item><title>T</title><link>https://x.org/2</link><published>2024-01-02T00:00:00Z</published><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate><summary>S</summary><description>D</description></item>
    </channel></rss>""")
    got = {r.url: r for r in scans.feed(spark, str(tmp_path / "f.xml")).collect()}
    assert set(got) == {"https://x.org/1", "https://x.org/2"}
    assert got["https://x.org/1"].title == "A & B" and got["https://x.org/1"].date_published == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert got["https://x.org/2"].date_published == dt.datetime(2024, 1, 2) and got["https://x.org/2"].full_text == "S"


def test_sinks_repeat_safely(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "id string, v int, position int")
    for _ in range(3):
        sinks.append_new(rows, path, ["id"], [F.asc("position")])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    keyed = str(tmp_path / "k")
    for v in (1, 2):
        sinks.replace_by_key(spark.createDataFrame([("a", v), (f"b{v}", v)], "id string, v int"), keyed, "id", 4)
    assert sorted((r.id, r.v) for r in spark.read.parquet(keyed).collect()) == [("a", 2), ("b1", 1), ("b2", 2)]
    sinks.json_archive(rows, str(tmp_path / "arc"), "2025-03-01", "run-1")
    with pytest.raises(AnalysisException):
        sinks.json_archive(rows, str(tmp_path / "arc"), "2025-03-01", "run-1")


def test_late_events_stream_equals_batch(spark, tmp_path):
    """Three files in time order with rows moved to a later file: 5 minutes and 2 hours late are
    inside the watermark and must be counted."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i), "x" if i % 3 else "y") for i in range(72)]
    late = {5: 1, 20: 1, 40: 2}
    for part in range(3):
        mine = [r for r in rows if late.get(r[0], r[0] // 24) == part]
        spark.createDataFrame(mine, "event_id bigint, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    schema = "event_id bigint, ts timestamp_ntz, event_type string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = streams.window_counts(stream, "ts", ["event_type"], delay="3 days")
    streams.drain(counts, f"{tmp_path}/ck", streams.keep_latest_batch(f"{tmp_path}/out"), mode="update")
    got = streams.latest(spark, f"{tmp_path}/out", ["start_utc", "end_utc", "event_type"])
    want = spark.createDataFrame(rows, schema).groupBy(F.window("ts", "1 day", "1 day", "22 hours").alias("w"), "event_type").count()
    assert sorted((r.start_utc, r.event_type, r.events) for r in got.collect()) == sorted((r.w.start, r.event_type, r["count"]) for r in want.collect())


class FakeSession:
    """A session that only has settings: a cluster's checkpoint folder must be used, and is required."""

    def __init__(self, named, master):
        self.conf = self.sparkContext = self
        self.named, self.master = named, master

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None


def test_shared_dir(spark):
    assert shared_dir(FakeSession("hdfs://x/ck/", "yarn")) == "hdfs://x/ck"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession(None, "yarn"))
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("/tmp/spark-")
