"""SimHash components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from strandline.llm import simhash
from strandline.llm.common import int64_bits
from strandline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = WORDS.findall((text or "").translate(UPPER))
    shingles = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """{position: smallest position reachable} by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_of_edge_texts(monkeypatch):
    texts = [None, "", " \n\t", "One", "a B c", "a b c d", "É À x Y z", "w " * 500, " a b c d e", "x\x0by\x0cz w v"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    long = " ".join(str(i * i) for i in range(900)) + " " + "y" * 300
    whole = simhash.fingerprint(long)
    monkeypatch.setattr(simhash, "STEP", 64)
    assert simhash.fingerprint(long) == whole == brute_print(long)


def families(rng, groups=40, size=30):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        out.append(base)
        for _ in range(size):
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 4, 5, 8])):
                base ^= 1 << b
            out.append(base)
    return out


def linked(spark, prints, radius, **options):
    df = spark.createDataFrame([(int64_bits(p),) for p in set(prints)], "fp long")
    return [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, radius, **options).collect()]


def same_parts(prints, links, radius):
    distinct = sorted(set(prints))
    place = {p: i for i, p in enumerate(distinct)}
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(distinct))] == brute_components(distinct, radius)


def test_links_connect_what_brute_force_connects(spark):
    prints = families(random.Random(1))
    assert same_parts(prints, linked(spark, prints, 4), 4)
    assert same_parts(prints, linked(spark, prints, 6), 6)
    # Shards larger than a block, as a family of near copies makes them.
    assert same_parts(prints, linked(spark, prints, 4, blocks=5, block_rows=7), 4)


def test_tree_follows_edges_within_the_radius():
    rng = random.Random(2)
    fps = np.array([int64_bits(p) for p in sorted(set(families(rng, 6, 60)))], dtype=np.int64)
    a, b = simhash.shard_links(fps, 4)
    assert same_parts([int(p) & (1 << 64) - 1 for p in fps], [(int(x) & (1 << 64) - 1, int(y) & (1 << 64) - 1) for x, y in zip(a, b)], 4)
    assert len(a) < len(fps)


def test_near_duplicates_with_nulls_and_clashes(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text, "a", 1), (3, text + " more", "b", 2), (3, text + " more", "b", 2), (None, text, "c", 3), (9, None, None, None), (8, "", "d", 4),
            (7, "other words that are short", "e", 5), (None, "alone and null here", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_print(r[1]) for r in rows]
    parts = brute_components(prints)
    least = {}
    for r, p in zip(rows, parts):
        if r[0] is not None:
            least[p] = min(least.get(p, r[0]), r[0])
    assert got == sorted((repr(r[0]), f"{x:016x}", least.get(p)) for r, x, p in zip(rows, prints, parts))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(["3", "7", "8", "None"])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    parts = brute_components(prints)
    want = sorted((i, f"{p:016x}", docs[c][0]) for (i, _), p, c in zip(docs, prints, parts))
    assert sorted(map(tuple, QUERIES["op2_simhash"](spark, SF).collect())) == want
