"""Trigram lists, interval joins and stored partial counts against plain computations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals
from strandline.sources import partials, trigrams


# ---- trigrams ----

def test_search_equals_contains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "CHUNK", 50)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcE é.") for _ in range(rng.randint(0, 9)))
    rows = [(i, rng.choice([None, word()]), word(), rng.choice([None, [word(), None, word()]])) for i in range(300)]
    rows[7] = (7, "A Rare Needle here", "p", ["x"])
    df = spark.createDataFrame(rows, "position long, title string, publisher string, tags array<string>")
    path = str(tmp_path / "ix")
    for part in (df.where("position < 200"), df.where("position >= 150"), df.where("position < 60")):
        trigrams.add(part, path)
    for q in (" NEEDLE", "re needle h", "abc", "b c", "ab", "é", "ce.", "no such", "", "abcabcabcabcabc", "BCE"):
        text = q.strip().lower()
        want = sorted(p for p, title, pub, tags in rows if any(f is not None and text in f.lower() for f in [title, pub, *(tags or [])]) or not text)
        assert sorted(r["key"] for r in trigrams.search(spark, path, q).collect()) == want, q


def test_a_search_opens_few_slabs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "CHUNK", 100)
    df = spark.range(2000).select(F.col("id").alias("position"), F.concat(F.lit("title number "), F.col("id").cast("string")).alias("title"), F.lit("p").alias("publisher"), F.array().cast("array<string>").alias("tags"))
    path = str(tmp_path / "ix")
    trigrams.add(df, path)
    found = trigrams.search(spark, path, "number 1234")
    assert [r["key"] for r in found.collect()] == [1234]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "slab" in plan.split("PartitionFilters")[1][:120]
    near = spark.read.parquet(path + "/rows").where("slab = 12")
    assert near.count() == 100                                     # one of twenty slabs


# ---- intervals ----

@pytest.mark.parametrize("seed, closed, hot", [(1, False, 10**6), (2, True, 10**6), (3, False, 10)])
def test_overlaps_equal_brute_force(spark, seed, closed, hot):
    rng = random.Random(seed)

    def spans(n):
        out = []
        for i in range(n):
            s = rng.randrange(-500, 1000)
            out.append((i, s, s + rng.choice([0, 0, 1, 2, 7, 8, 30, 100, 5000, -3])))
        return [*out, (n, None, 5), (n + 1, 5, None)]
    a, b = spans(150), spans(120)
    left, right = (spark.createDataFrame(x, "i long, s long, e long") for x in (a, b))
    got = sorted((r["left"]["i"], r["right"]["i"]) for r in intervals.overlap_join(left, right, left_span=("s", "e"), right_span=("s", "e"), closed=closed, hot_rows=hot).collect())
    fine = lambda x: [r for r in x if r[1] is not None and r[2] is not None and r[2] >= r[1]]
    want = sorted((i, j) for i, s, e in fine(a) for j, t, f in fine(b) if (s <= f and t <= e if closed else s < f and t < e))
    assert got == want and want


def test_a_long_interval_has_two_bins(spark):
    """One interval over everything and a million points: no row is copied more than a few times."""
    points = spark.range(100_000).select(F.col("id").alias("s"), F.col("id").alias("e"))
    long = spark.createDataFrame([(0, 1 << 40), (5, 6), (70, 90)], "s long, e long")
    pairs = intervals.overlap_join(points, long, left_span=("s", "e"), right_span=("s", "e"), closed=True)
    assert pairs.count() == 100_000 + 2 + 21
    assert intervals.overlap_join(points.limit(0), long, left_span=("s", "e"), right_span=("s", "e")).count() == 0


# ---- partial counts ----

def test_merge_equals_recount_and_replays_count_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, [], ["x"], ["x", "y", None]])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, kind string, tags array<string>")
    metrics = {"kind": F.col("kind"), "tag": F.col("tags")}
    path = str(tmp_path / "p")
    assert partials.merged(spark, path).count() == 0
    table = lambda d: sorted(tuple(r) for r in d.collect())
    for batch in (0, 1, 2, 1, 3):
        partials.store(partials.counts(df.where(F.col("i") % 4 == batch), metrics), path, f"b{batch}")
    whole = table(partials.counts(df, metrics))
    assert table(partials.merged(spark, path)) == whole
    partials.compact(spark, path, path + "-all")
    partials.store(partials.counts(df.where("i % 4 = 1"), metrics), path + "-all", "b1")        # known to the compacted table
    assert table(partials.merged(spark, path + "-all")) == whole
    partials.store(partials.counts(df.limit(1).select(F.lit("new").alias("kind"), F.lit(None).cast("array<string>").alias("tags")), metrics), path + "-all", "b9")
    assert table(partials.merged(spark, path + "-all")) == sorted([*whole, ("kind", "new", 1)])
