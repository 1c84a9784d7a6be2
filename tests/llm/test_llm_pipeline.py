"""The pipeline against stages written plainly."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from strandline.llm import neardup, quality, stages  # noqa: E402
from strandline.llm.queries import tokenizer_paths  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts, least=0.8):
    """All pairs of texts with a five-word Jaccard similarity of at least ``least``, found through their shared shingles."""
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    out = set()
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        out |= {(j, i) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= least}
    return out


def plain_groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_near(docs):
    texts = [t for _, _, t in docs]
    first = {}
    copies = {(first.setdefault(t, i), i) for i, t in enumerate(texts)}
    parts = plain_groups(len(docs), similar_pairs(texts) | copies)
    return [d for i, d in enumerate(docs) if parts[i] == i]


def plain_lines(docs, min_sites=10):
    sites, first = {}, {}
    for i, site, text in docs:
        for pos, line in enumerate(text.split("\n")):
            if body := line.strip(" \t\r\u00a0"):
                sites.setdefault(body, set()).add(site)
                first.setdefault(body, (i, pos))
    gone = lambda i, pos, body: body in sites and len(sites[body]) >= min_sites and first[body] != (i, pos)
    return [(i, site, "\n".join(ln for pos, ln in enumerate(text.split("\n")) if not gone(i, pos, ln.strip(" \t\r\u00a0"))))
            for i, site, text in docs]


def test_pipeline_equals_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r["doc_id"], r["source"], r["text"]) for r in table.collect())
    z = model.slope * model.margin([t for _, _, t in rows]) + model.shift
    docs = [r for r, s in zip(rows, z) if s >= 0]
    docs = plain_lines(docs)
    docs = plain_near(docs)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if not any(i in d[2] for i in items)]
    library = Tokenizer.from_file(tokenizer_paths()["json_path"])
    want = []
    for i, _, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) < len(rows)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(1, "some words " * 40, "en", "s1", 440, 7, "k"), (1, "some words " * 40, "en", "s1", 440, 7, "k"), (None, None, None, None, None, None, None),
            (2, "", "en", "s2", 0, 8, "k"), (3, "other text entirely that is kept as it is. " * 20, None, None, None, 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, row string")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= frame.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 5
    assert sorted(repr(r["doc_id"]) for r in stages.near_stage(spark, docs, SF).collect()) == ["1", "2", "3"]


def test_near_groups_equal_brute_force(spark):
    """All of sf0.01: every pair of similarity 0.8 is in one group, and no group has a link below it."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = sorted({t for _, t in docs})
    pairs = similar_pairs(texts)
    want = plain_groups(len(texts), pairs)
    frame = spark.createDataFrame([(f"{i:08d}", i, t) for i, t in enumerate(texts)], "id string, k long, text string")
    found = {int(r["node"]): int(r["component"]) for r in neardup.groups(frame).collect()}
    together = sum(found.get(a, a) == found.get(b, b) for a, b in pairs)
    assert pairs and together / len(pairs) >= 0.95
    assert all(want[a] == want[b] for a, b in found.items())      # groups only join what verified links join


@pytest.mark.parametrize("small", [2, 8])
def test_families_and_shared_passages(spark, monkeypatch, small):
    """Families larger than a band's limit, chains, and texts that share a passage but are not similar."""
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(small)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for size in (30, 12, 2, 1):
        base = [word() for _ in range(120)]
        for _ in range(size):
            new = list(base)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(120)] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(150)]
    for _ in range(12):                                           # neighbours are similar, ends are not
        chain[rng.randrange(150)] = word()
        texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(30)]
    texts += ["", "  \n", "one", "One", "one two three four"]
    texts = sorted(set(texts))
    frame = spark.createDataFrame([(f"{i:08d}", i, t) for i, t in enumerate(texts)] * 2, "id string, k long, text string")
    found = {int(r["node"]): int(r["component"]) for r in neardup.groups(frame).collect()}
    want = plain_groups(len(texts), similar_pairs(texts))
    assert [found.get(i, i) for i in range(len(texts))] == want


def test_keep_one_states_its_cases(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words), (3, words + " more"), (None, words), (8, ""), (7, None), (9, "  "), (5, words), (6, "other " * 9), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, words + " more"), (6, "other " * 9), (7, None), (9, "  ")]
    assert neardup.keep_one(docs.limit(0)).count() == 0
