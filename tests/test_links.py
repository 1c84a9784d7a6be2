"""Spanning links and components that grow by batches, against all pairs and one run."""

from __future__ import annotations

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from catalog import q_dedupe
from strandline.operators import graph, similarity
from strandline.runtime import cut_lineage
from strandline.sources import sinks


def parts_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed, t, pair_rows, light", [(1, 0.35, 20_000, 64), (2, 0.35, 7, 2), (3, 0.6, 5, 1), (4, 0.2, 9, 3), (5, 0.85, 6, 0)])
def test_spanning_links_connect_what_all_pairs_connect(spark, seed, t, pair_rows, light):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    sets = {i: set(rng.choices(words, [15, 9] + [1] * 38, k=rng.randint(1, 7))) for i in range(150)}
    for i in range(150, 200):                                               # a family of near sets
        sets[i] = {"w0", "w1", "w2", "w3", "w4", f"x{i}"}
    sets = dict({frozenset(v): (k, v) for k, v in sets.items()}.values())    # distinct sets
    block = {i: i % 2 for i in sets}
    df = spark.createDataFrame([(i, sorted(v), str(block[i])) for i, v in sets.items()], "set_id bigint, tokens array<string>, c string")
    true = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if block[a] == block[b] and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
    got = {(r["set_a"], r["set_b"]) for r in similarity.spanning_links(df, ["c"], threshold=t, pair_rows=pair_rows, light_rows=light).collect()}
    assert got <= true
    assert parts_of(sets, got) == parts_of(sets, true)


def test_a_large_family_writes_linear_links(spark):
    """Fifty thousand near titles: 1.25 billion similar pairs, a few links for each title."""
    n = 50_000
    common = [F.lit(f"c{i}") for i in range(5)]
    df = spark.range(n).select(F.col("id").alias("set_id"), F.array(*common, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("tokens"))
    links = cut_lineage(similarity.spanning_links(df, [], threshold=0.35), "test-span")
    assert n - 1 <= links.count() <= 30 * n
    parts = graph.connected_components(links.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))
    assert parts.where("component = 0").count() == n


def stored(spark, path):
    return {r["node"]: r["component"] for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("seed, batches", [(1, 1), (2, 3), (3, 6)])
def test_any_split_into_batches_equals_one_run(spark, tmp_path, seed, batches):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7), (None, 3)]
    rng.shuffle(links)
    path = str(tmp_path / "c")
    for b in [*range(batches), rng.randrange(batches)]:                      # one batch comes again
        sinks.append_links(spark.createDataFrame(links[b::batches], "a long, b long"), path, 8)
    real = [(a, b) for a, b in links if a is not None]
    assert stored(spark, path) == parts_of({n for e in real for n in e}, real)
    assert spark.read.parquet(path).count() == len({n for e in real for n in e})


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.append_links(spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a long, b long"), path, 32)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    touched = sinks.append_links(spark.createDataFrame([(10, 21), (500, 501)], "a long, b long"), path, 32)
    after = files()
    assert touched <= 3
    assert len(set(before) - set(after)) <= 3 and len(set(before) & set(after)) >= 24
    assert stored(spark, path)[20] == stored(spark, path)[11] == 10
    assert sinks.append_links(spark.createDataFrame([(10, 21)], "a long, b long"), path, 32) == 0
    assert files() == after


def test_a_bucket_that_loses_all_its_rows_is_gone(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.append_links(spark.createDataFrame([(5, 6)], "a long, b long"), path, 1000)
    sinks.append_links(spark.createDataFrame([(1, 6)], "a long, b long"), path, 1000)
    assert stored(spark, path) == {1: 1, 5: 1, 6: 1}
    assert spark.read.parquet(path).count() == 3


def test_signatures_bound_the_shared_tokens_and_lose_no_pair(spark):
    rng = random.Random(11)
    sets = [sorted(rng.sample([f"w{i}" for i in range(60)], rng.choice([1, 2, 5, 20, 50]))) for _ in range(120)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "set_id string, tokens array<string>")
    sig = {r["set_id"]: r["sig"] for r in similarity._ordered(df, [], 1, 1_000_000).collect()}
    found = {tuple(sorted((int(r["set_a"]), int(r["set_b"])))) for r in similarity.similar_sets(df, [], threshold=0.35).collect()}
    for i, a in enumerate(sets):
        for j in range(i):
            apart = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(sig[str(i)], sig[str(j)]))
            shared = len(set(a) & set(sets[j]))
            assert 2 * shared <= len(a) + len(sets[j]) - apart
            assert ((j, i) in found) == (shared / (len(a) + len(sets[j]) - shared) >= 0.35)


def test_titles_are_cut_once_and_long_titles_are_linked(spark, tmp_path):
    """The links read what was written of the titles, not the documents again; titles of more tokens than a signature has bits link too."""
    words = [f"word{i:04d}" for i in range(1200)]
    texts = [" ".join(words[:600]), " ".join(words[100:700]), " ".join(words[600:]), "short title", "title short", "other words"]
    docs = [(i * len(graph.vocab.CATEGORIES), t + "\nbody", "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    links = q_dedupe.title_links(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in links.inputFiles())
    step = len(graph.vocab.CATEGORIES)
    assert {(min(r), max(r)) for r in links.collect()} == {(0, step), (3 * step, 4 * step)}


@pytest.mark.parametrize("light", [0, 64])
def test_saturated_signatures_lose_no_link(spark, light):
    rows = [(k, [f"t{i}" for i in range(k * 150, k * 150 + 600)]) for k in range(8)]
    df = spark.createDataFrame(rows, "set_id bigint, tokens array<string>")
    got = {(r["set_a"], r["set_b"]) for r in similarity.spanning_links(df, [], threshold=0.35, light_rows=light).collect()}
    assert got <= {(a, b) for a in range(8) for b in (a + 1, a + 2) if b < 8 and (600 - 150 * (b - a)) / (600 + 150 * (b - a)) >= 0.35}
    assert parts_of(range(8), got) == dict.fromkeys(range(8), 0)
