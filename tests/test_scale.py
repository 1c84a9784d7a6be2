"""Order-dependent and graph operators against brute force, with the hot-key paths forced on."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import dedupe, graph, similarity
from strandline.operators.skew import lookup_join


def test_lookup_join_hot_and_cold(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50 + 1)).alias("k"), F.col("id").alias("v"))
    per = rows.groupBy("k").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    got = lookup_join(rows, per.where("k <> 7"), ["k"], count_col="n", hot_rows=100)
    want = rows.join(per.where("k <> 7").drop("n"), ["k"])
    assert sorted(map(tuple, got.select("k", "v", "low").collect())) == sorted(map(tuple, want.select("k", "v", "low").collect()))
    assert lookup_join(rows, per.where("k <> 7"), ["k"], count_col="n", how="left", hot_rows=100).count() == 1000


def greedy(rows):
    seen, kept = set(), []
    for rank, *keys in sorted(rows):
        mine = {(i, k) for i, k in enumerate(keys) if k is not None}
        if not mine & seen:
            kept.append(rank)
            seen |= mine
    return kept


@pytest.mark.parametrize("seed, hot", [(1, 1_000_000), (2, 5), (3, 5), (4, 2)])
def test_exact_drops_equal_the_greedy_walk(spark, seed, hot):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *[f"k{i}" for i in range(n)]])
    # A third of the rows share one title.
    rows = [(i, pick(60), "hot" if rng.random() < 0.33 else pick(40), pick(80)) for i in range(200)]
    df = spark.createDataFrame(rows, "rank bigint, a string, b string, c string")
    drops = dedupe.exact_drops(df, {c: F.col(c) for c in "abc"}, hot_rows=hot).collect()
    kept = set(greedy(rows))
    assert {r.rank for r in drops} == {r[0] for r in rows} - kept
    assert len(drops) == len({r.rank for r in drops})


def brute_pairs(sets, t, m):
    out = {}
    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        n = len(a & b)
        if n >= m and a | b and n / len(a | b) >= t:
            out[(i, j)] = n
    return out


@pytest.mark.parametrize("seed, t, m, hot", [(1, 0.35, 1, 10**6), (2, 0.35, 1, 3), (3, 0.85, 3, 3), (4, 0.5, 1, 2), (5, 0.5, 2, 4), (6, 0.2, 1, 5), (7, 1.0, 3, 2)])
def test_similar_sets_equal_all_pairs(spark, seed, t, m, hot):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    weights = [20, 12, 8] + [1] * 22
    sets = {}
    for _ in range(150):
        s = frozenset(rng.choices(words, weights, k=rng.randint(1, 7)))
        sets[" ".join(sorted(s))] = s
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "set_id string, tokens array<string>")
    got = similarity.similar_sets(df, [], threshold=t, min_shared=m, hot_rows=hot).collect()
    assert {(r.set_a, r.set_b): r.shared for r in got} == brute_pairs(sets, t, m)
    assert len(got) == len({(r.set_a, r.set_b) for r in got})


@pytest.mark.parametrize("seed, hot", [(1, 10**6), (2, 4)])
def test_components(spark, seed, hot):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g if len(g) > 1}
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), hot_rows=hot).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


TITLES = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "zeta eta theta iota", "zeta eta theta iota kappa", "omicron sigma"]


def records(spark, rng, n):
    rows = [(i, f"id{i}", rng.choice(TITLES) if rng.random() < 0.7 else f"word{i} other{i} third{i}", rng.choice("xy"), rng.choice(["primary", "low"])) for i in range(n)]
    return spark.createDataFrame(rows, "position bigint, id string, title string, category string, trust_tier string").withColumns({
        "full_text": F.lit("t"), "date_published": F.lit(None).cast("timestamp_ntz"), "date_confidence": F.lit("none"), "url": F.lit(None).cast("string"),
        "clean_text_hash": F.lit(None).cast("string")})


@pytest.mark.parametrize("hot", [10**6, 3])
def test_near_titles_keep_one_per_group(spark, hot):
    df = records(spark, random.Random(5), 80)
    kept, drops = dedupe.dedupe_near_title(df, threshold=0.79, hot_rows=hot)
    titles = [r.title for r in kept.collect()]
    assert sum(t in TITLES[:2] for t in titles) == 1 and sum(t in TITLES[2:4] for t in titles) == 1
    assert titles.count(TITLES[4]) == df.where(F.col("title") == TITLES[4]).count()
    assert kept.count() + drops.count() == 80
    assert dedupe.dedupe_near_title(df, skip=True)[0].count() == 80


def test_results_do_not_depend_on_order_or_partitions(spark):
    df = records(spark, random.Random(7), 120)
    score = lambda d: graph.cluster_records(d, F.col("position") % 5, hot_rows=10)
    view = lambda d: sorted(map(tuple, score(d).select("id", "cluster_id", "cluster_size", "is_representative", "cluster_theme").collect()))
    base = view(df)
    assert view(df.repartition(7).orderBy(F.rand(3))) == base
    sizes = {}
    for _id, cid, size, *_ in base:
        sizes.setdefault(cid, []).append(size)
    assert all(len(v) == v[0] for v in sizes.values())


def test_empty_inputs(spark):
    df = records(spark, random.Random(1), 3).limit(0)
    assert dedupe.dedupe_exact(df)[0].count() == 0 and dedupe.dedupe_near_title(df)[0].count() == 0
    assert graph.cluster_records(df, F.lit(1)).count() == 0
    assert graph.summarize_clusters(graph.cluster_records(df, F.lit(1))).first().largest_cluster == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_a_plain_join(spark, how):
    """One key holds half of the rows, some keys are missing, some are unknown."""
    from strandline.operators.skew import hot_join
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 11 != 0, F.col("id") % 90).alias("k"))
    per_key = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    got = hot_join(rows, per_key, ["k"], how=how, hot_rows=100)
    assert sorted(map(repr, got.select(*sorted(got.columns)).collect())) == \
        sorted(map(repr, (p := rows.join(per_key, ["k"], how)).select(*sorted(p.columns)).collect()))


def test_a_word_in_all_titles_stays_within_the_budget(spark):
    """Keys that every set shares are dealt to blocks: no joined key holds more than two blocks of sets."""
    keys = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("set_id"), F.lit(0).alias("block"), F.lit("same word").alias("key"), F.lit(0).alias("pos"))
    dealt = similarity._in_blocks(keys, 100)
    sizes = [r["count"] for r in dealt.groupBy("block", "key", "p", "q").count().collect()]
    assert len(sizes) == 55 and max(sizes) <= 2 * 150
    titles = [f"common shared w{i} x{i // 2} y{i // 3}" for i in range(120)]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(titles)], "set_id long, tokens array<string>")
    got = {(r["set_a"], r["set_b"]) for r in similarity.similar_sets(df, [], threshold=0.35, hot_rows=15).collect()}
    sets = [set(t.split()) for t in titles]
    assert got == {(a, b) for a in range(120) for b in range(a + 1, 120) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.35}
