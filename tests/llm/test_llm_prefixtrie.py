"""The prefix trie against brute force: shared starts, copies, long and empty conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import prefixtrie
from strandline.llm.common import cut_lineage
from strandline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(convs):
    """convs: {id: [(role, text)]} -> the rows of the trie."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        under = children.get(node, [])
        leaves[node] = sum(leaves[u] for u in under) or 1
        saved[node] = sum(saved[u] for u in under) + ((len(members[node]) - 1) * words(node[-1][1]) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in convs.items()}


def spliced(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def built(spark, rows, splice=False, **options):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, conv string")
    turns = cut_lineage(prefixtrie.numbered_turns(df), "test-turns")
    convs = turns.select("conv").distinct()
    if splice:
        turns, convs = prefixtrie.spliced(turns)
        turns = cut_lineage(turns, "test-spliced")
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefixtrie.trie(turns, convs, **options).collect())


def family(rng, n, depth=9, choices=2):
    """Conversations that leave each other at any turn, many of them equal."""
    texts = ["", "a b", "c\td  e", "f g h i"]
    return [(c, t, "user" if t % 2 else "assistant", texts[rng.randrange(choices) if rng.random() < 0.4 else t % 4]) for c in range(n) for t in range(rng.randint(1, depth))]


@pytest.mark.parametrize("size", [1, 3, 4, 16])
def test_equals_brute_force(spark, size):
    rows = family(random.Random(size), 70)
    assert built(spark, rows, size=size) == brute_trie(ordered(rows))


def test_starts_taken_from_another_conversation(spark):
    rng = random.Random(6)
    rows = [(c, t, "user", f"{rng.randrange(3)}") for c in range(0, 130, 1) for t in range(rng.randint(1, 5)) if c % 20 or c < 60]
    want = brute_trie(spliced(ordered(rows)))
    assert built(spark, rows, splice=True) == want
    assert any(r[1] == 0 and r[4] for r in want)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", None), (1, 2, "user", None), (2, None, "", ""), (2, 2, "user", ""), (None, 1, "user", "lost"), (3, -5, "a", "b"), (-4, 1, "a", "b")]
    assert built(spark, rows) == brute_trie(ordered(rows))
    assert built(spark, []) == []
    assert built(spark, [(9, 0, "user", "x " * 100_000)])[1][:2] == (9, 1)


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    """Ranks and digests of a long conversation are put together from several windows."""
    monkeypatch.setattr(prefixtrie, "SPAN", 8)
    rows = [(0, t, "user", f"{t % 3} w") for t in range(300)] + [(1, t, "user", f"{t % 3} w") for t in range(290)] + [(c, 0, "user", "0 w") for c in range(2, 9)]
    assert built(spark, rows) == brute_trie(ordered(rows))


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ID_SPAN", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(6)] + [(c, 0, "user", "turn 0") for c in range(200, 230)]
    assert built(spark, rows) == brute_trie(ordered(rows))


def test_only_turnless_conversations(spark):
    turns = spark.createDataFrame([], "conv long, pos long, ta long, tb long, words long")
    convs = spark.createDataFrame([(7,), (5,)], "conv long")
    assert [tuple(r) for r in prefixtrie.trie(turns, convs).collect()] == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,7").hexdigest())]


def test_blocks_without_siblings_are_not_refined(spark):
    """Forty equal conversations make one group for each block, and every one of them is single."""
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(12)]
    turns = prefixtrie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    groups = prefixtrie._blocks(turns, 4).groupBy(*prefixtrie.CHILD).agg(F.count("*").alias("members"))
    assert sorted((r["block"], r["members"]) for r in groups.collect()) == [(0, 40), (1, 40), (2, 40)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = QUERIES["op12_prefix_trie"](spark, SF)
    want = con.execute(ORACLES["op12_prefix_trie"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
