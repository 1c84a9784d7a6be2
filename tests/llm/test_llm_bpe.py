"""BPE against the tokenizers library: exact ids, exact round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from strandline.llm import bpe  # noqa: E402
from strandline.llm.queries import QUERIES, tokenizer_paths  # noqa: E402

PATHS = tokenizer_paths()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATHS["json_path"])


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_rank_encoder_agrees_below_u0250(library):
    codec = bpe.codec(**PATHS)
    chars = [chr(c) for c in range(0x250)]
    for a in chars:
        for text in (a, f"x{a}", f"{a}y", f" {a}", f"{a} ", f"a {a}{a} b", f"\n{a}'s{a}", f"7{a}8"):
            assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_rank_encoder_agrees_on_random_text(library):
    codec, rng = bpe.codec(**PATHS), random.Random(3)
    pool = [chr(c) for c in range(9, 0x250)] + ["'re", "'s", "  ", "\n\n", "the", "<|endoftext|>", "日本", " ", " ", "🙂"]
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def passage(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(n))


def awkward_texts():
    rng = random.Random(5)
    shared = passage(rng, 900)
    texts = [None, "", " ", "a", "x" * 9000, " " * 5000, "\n" * 3000, "<|endoftext|>" * 3, "日本語のテキスト" * 900,
             shared, shared, "start " + shared, shared + " end", passage(rng, 50) + shared + "'" + shared + "'re", shared[:4000] + "é" + shared[4000:],
             "<|endoftext|>".join([shared, shared]), "".join(shared.split()), shared.replace(" ", " "), shared.replace(" ", "\n\n")]
    return texts + [passage(rng, rng.randint(1, 400)) + shared[k * 50:k * 50 + 2500] for k in range(20)]


def test_ids_equal_the_library(spark, library):
    texts = awkward_texts()
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[9], "x", 2), (3, texts[3], "x", 3), (3, "other", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in bpe.encode(docs, **PATHS, digests=True).collect())
    assert got == sorted((-1 if i is None else i, *want(library, t)) for i, t, _, _ in rows)


def test_chunks_are_reused():
    rng = random.Random(8)
    shared = passage(rng, 2000)
    a, b = bpe.Chunks([shared]), bpe.Chunks([passage(rng, 30) + shared])
    assert len(set(a.a.tolist()) & set(b.a.tolist())) > 0.8 * len(a.start)


def test_ids_and_decode(spark, library):
    texts = awkward_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(docs, **PATHS)
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in ids.collect()} == \
        {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(ids, **PATHS).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), **PATHS, digests=True).count() == 0


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op1_bpe"](spark, SF).collect()}
    assert got == {i: want(library, t) for i, t in docs.items()}
