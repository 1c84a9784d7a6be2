"""The stored key index: what a batch reads, splits, repeats and writers that stopped half way."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandline.runtime import subfolders
from strandline.sources import sinks
from strandline.sources.keyindex import KeyIndex, key_hash


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def found(index, spark, values):
    """The asked values that the index says are stored."""
    rows = ids(spark, values)
    return sorted((r["id"] for r in rows.select("id", *key_hash(["id"])).join(index.stored(rows), ["a", "b"], "left_semi").collect()))


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.range(0, 8000, 2).write.parquet(table)
    index = KeyIndex(spark, table + "_keys", table, ["id"], split_rows=150)
    assert index.catch_up() > 0 and index.catch_up() == 0
    buckets = index.directory().count()
    assert buckets >= 16
    assert found(index, spark, [4, 5, None]) == [4]
    assert index.files_read["maps"] <= 3 and 1 <= index.files_read["hashes"] <= 2
    assert found(index, spark, range(9001, 9101, 50)) == []
    assert index.files_read == {"maps": min(2, index.files_read["maps"]), "hashes": 0}     # new keys: no hashes are opened
    assert found(index, spark, []) == [] and index.files_read == {"maps": 0, "hashes": 0}
    asked = random.Random(1).sample(range(10_000), 700)
    assert found(index, spark, asked) == sorted(a for a in asked if a < 8000 and a % 2 == 0)


def test_buckets_split_as_they_grow(spark, tmp_path):
    table = str(tmp_path / "t")
    index = KeyIndex(spark, table + "_keys", table, ["id"], split_rows=100, max_parts=3)
    seen, deepest = [], []
    for part in range(6):
        new = list(range(part * 90, part * 90 + 90))
        ids(spark, new).write.mode("append").parquet(table)
        index.catch_up()
        seen += new
        rows = index.directory().collect()
        assert sum(r["n"] for r in rows) == len(seen)
        assert abs(sum(2.0 ** -r["depth"] for r in rows) - 1) < 1e-9       # the names cover every hash exactly once
        assert all(len(r["parts"]) <= 3 for r in rows)
        deepest.append(max(r["depth"] for r in rows))
    assert deepest == sorted(deepest) and deepest[-1] >= 2
    assert found(index, spark, [*seen, 10_000, -1]) == sorted(seen)
    live = {p for r in index.directory().collect() for p in r["parts"]}
    assert set(subfolders(spark, table + "_keys/parts")) == live           # nothing is left of older versions
    assert len(subfolders(spark, table + "_keys/versions")) == 1


def test_repeated_batches_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, 1, 3), ("a", 1, 4), ("", None, 5)], "x string, y int, v int")
    for _ in range(3):
        sinks.append_new(rows, path, ["x", "y"], [F.asc("v")])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3, 4, 5]
    sinks.append_new(rows.limit(0), path, ["x", "y"], [F.asc("v")])
    assert spark.read.parquet(path).count() == 4


def test_a_writer_that_stopped_half_way(spark, tmp_path):
    """Rows in the table that no index knows are found, and parts that no version names are deleted."""
    path = str(tmp_path / "t")
    sinks.append_new(ids(spark, range(10)), path, ["id"], [F.asc("id")])
    ids(spark, range(10, 15)).write.mode("append").parquet(path)           # the table was written, the index was not
    index = KeyIndex(spark, path + "_keys", path, ["id"])
    index._write(ids(spark, range(500, 505)).select(F.lit("b").alias("bucket"), *key_hash(["id"])))   # a part without a version
    sinks.append_new(ids(spark, range(5, 20)), path, ["id"], [F.asc("id")])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))
    index.catch_up()
    assert found(index, spark, [12, 17, 501]) == [12, 17]
    assert len(subfolders(spark, path + "_keys/parts")) <= 3


def test_partition_names_that_need_escapes(spark, tmp_path):
    path = str(tmp_path / "t t")
    rows = spark.createDataFrame([(1, "a b:c/%é"), (2, "x={y}")], "id long, part string")
    for _ in range(3):
        sinks.append_new(rows, path, ["id"], [F.asc("id")], ["part"])
    assert sorted((r["id"], r["part"]) for r in spark.read.parquet(path).collect()) == [(1, "a b:c/%é"), (2, "x={y}")]
