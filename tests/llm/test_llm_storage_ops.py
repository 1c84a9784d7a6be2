"""Neighbours, archives and resharding against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard

from strandline.llm import ann, reshard, warc
from strandline.llm.common import scratch_path
from strandline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- neighbours -------------------------------------------------------------------------------------

def brute_nearest(ids, x, query, k):
    score = (x * x[query]).sum(axis=-1)
    score[ids == ids[query]] = -np.inf
    best = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), float(score[i])) for i in best if np.isfinite(score[i])]


def clusters(rng, n, d=24, centres=30):
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, d))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = clusters(rng, 6000)
    ids = np.arange(6000) * 3
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 60 = 0")
    got = {}
    for r in ann.search(vectors, asked, k=20, sample=4000, part_rows=200, block_rows=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in range(0, 6000, 20):
        want = brute_nearest(ids, x, q, 20)
        mine = got[int(ids[q])]
        assert sorted(mine) == list(range(1, 21))
        found = [mine[k] for k in range(1, 21)]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hit += len({w[0] for w in want} & {f[0] for f in found})
    assert hit / (300 * 20) >= 0.9


def test_ties_odd_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]),
            (104, [inf, 1.0, 1.0]), (105, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (110, [2.0, 4.0, 6.5])]
    vectors = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(tuple(r) for r in ann.search(vectors, vectors.where("vec_id % 20 = 0 or vec_id > 99"), k=20).collect())
    by = {}
    for q, rank, v, s in got:
        by.setdefault(q, []).append((rank, v, s))
    assert sorted(by) == [0, 20, 40, 110]
    assert [v for _, v, _ in by[0]] == [110, *range(1, 20)] and [v for _, v, _ in by[20]] == [110, *range(19)]
    assert [v for _, v, _ in by[110]] == list(range(20))
    few = vectors.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0"), k=20).count() == 4
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_neighbour_query(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op3_ann"](spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {int(ids[q]): {v for v, _ in brute_nearest(ids, x, q, 20)} for q in range(len(ids)) if ids[q] % 20 == 0}
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) / sum(map(len, want.values())) >= 0.9


def test_probes_follow_the_structure():
    rng = np.random.default_rng(4)
    loose, tight = rng.normal(size=(2400, 48)), clusters(rng, 2400)
    need = []
    for x in (loose, tight):
        fit, unseen = x[300:], x[:300]
        graph = ann.neighbour_graph(fit)
        router = ann.fit_router(fit, graph, ann.balanced_parts(fit, graph, 10), 10)
        need.append(ann.probes_for(router, fit, unseen, 10, 0.95))
    assert need[1] <= 4 < need[0]


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = clusters(rng, 2000)
    graph = ann.neighbour_graph(x)
    part = ann.balanced_parts(x, graph, 10)
    assert np.bincount(part, minlength=10).max() <= 220
    assert (part[graph] == part[:, None]).mean() > 0.7


# ---- archives ---------------------------------------------------------------------------------------

def brute_records(pages):
    texts = {}
    for i, h in pages:
        texts.setdefault(h or "", []).append(i)
    out = []
    for i, h in pages:
        raw = (h or "").encode()
        known = [k for k in texts[h or ""] if k is not None]
        top = max(known, default=None)
        revisit = len(raw) >= 1000 and i is not None and i < top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def odd_pages():
    rng = random.Random(4)
    big = ["<p>" + "".join(rng.choice("abc é日 ") for _ in range(1500)) for _ in range(5)]
    pages = [(i, rng.choice(big)) for i in range(60)] + [(100 + i, "<b>small</b>") for i in range(5)]
    return pages + [(200, None), (201, ""), (None, big[0]), (300, "x" * 1000), (301, "x" * 1000), (302, "y" * 999), (303, "y" * 999), (310, big[1]), (310, big[1]),
                    (400, "\r\n\r\nWARC/1.1\r\n" * 300)]


def test_round_trip(spark):
    pages = odd_pages()
    df = spark.createDataFrame([(i, None if i == 200 else f"http://é.example/{i} x", h, 1, "c") for i, h in pages],
                               "page_id long, url string, html string, payload int, record_type string")
    folder = scratch_path(spark, "test-warc")
    assert warc.write_archives(df, folder, file_bytes=4000) > 3
    rows = warc.read_archives(spark, folder).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    assert got == brute_records(pages)
    html = {}
    for i, h in pages:
        html.setdefault(i, set()).add((h or "").encode())
    assert all(bytes(r["payload"]) in html[r["page_id"]] for r in rows if r["record_type"] == "response")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").collect()
    for f in files:
        assert struct.unpack_from("<I", f["content"])[0] == warc.DICT_MAGIC
    assert warc.round_trip(df.limit(0)).count() == 0


def archive(records, dictionary=b""):
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    packer = zstandard.ZstdCompressor(write_checksum=True, **options)
    lead = struct.pack("<II", warc.DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return lead + b"".join(packer.compress(r) for r in records)


def test_reader_refuses_what_is_wrong():
    good = [warc.make_record(i, i, f"http://a/{i}", (f"<p>{i} " * 400).encode(), None) for i in range(40)]
    dictionary = warc.train_dictionary(good)
    assert dictionary
    data = archive(good, dictionary)
    assert [r["page_id"] for r in warc.read_archive(data)] == list(range(40))
    packed = zstandard.ZstdCompressor().compress(dictionary)
    tail = data[8 + len(dictionary):]
    assert len(list(warc.read_archive(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + tail))) == 40
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(tail))  # the dictionary is missing
    for bad in (data[:-3], data + b"xx", data[:200], tail[:5]):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(bad))
    record = good[3]
    for bad in (record.replace(b"WARC/1.1", b"WURC/1.1"), record.replace(b"<p>3", b"<p>4", 1), record.replace(b"WARC-Date", b"WARC-Dale"), record[:-1],
                record.replace(b"Content-Length: ", b"Content-Length: 9"), record.replace(b"WARC-Type: response", b"WARC-Type: revisit"), record.replace(b"WARC-Type:", b"WARC-Type ")):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(archive([bad])))


def test_archive_query(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op5_warc"](spark, SF).collect()), key=repr) == brute_records(pages)


# ---- resharding -------------------------------------------------------------------------------------

def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        capacity = [rng.randint(0, 5) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(flow[i][j] for i in range(n)) <= capacity[j] for j in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]
        best = min((sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units))
                    if all(to.count(j) <= capacity[j] for j in range(m))), default=0)
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == best
    with pytest.raises(ValueError):
        reshard.min_cost_flow([3], [2], [[0]])


def test_fewest_bytes_move():
    rng = random.Random(2)
    sizes = {(s, f, b): rng.randint(1, 90) for s in range(6) for f in range(4) for b in range(1 + 8 * s)}
    supply = [sum(v for k, v in sizes.items() if k[0] == s) for s in range(6)]
    capacity = reshard.even_capacities(sum(supply), 6)
    flow = reshard.min_cost_flow(supply, capacity, [[int(i != j) for j in range(6)] for i in range(6)])
    assert sum(flow[i][j] for i in range(6) for j in range(6) if i != j) == sum(max(0, a - b) for a, b in zip(supply, capacity))
    moves = reshard.choose_blocks(sizes, flow, capacity)
    load = list(supply)
    for b, to in moves.items():
        load[b[0]] -= sizes[b]
        load[to] += sizes[b]
    assert max(abs(a - b) for a, b in zip(load, capacity)) <= 60
    assert sum(sizes[b] for b in moves) <= sum(max(0, a - b) for a, b in zip(supply, capacity)) + 60 * 6


def check_placement(rows, docs):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == \
        sorted((i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    load = {}
    for r in rows:
        load.setdefault(r["shard"], []).append(r)
    for shard, part in load.items():
        assert 0 <= shard < 16 and sorted(r["slot"] for r in part) == list(range(len(part)))
    total = sum(r["size"] for r in rows)
    return {s: sum(r["size"] for r in p) for s, p in load.items()}, total


def test_half_of_all_rows_equal(spark):
    rng = random.Random(3)
    docs = [(i, "copy " * 20 if i % 2 else "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 300)))) for i in range(3000)] + [(None, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, shard int, file string")
    load, total = check_placement(reshard.reshard_by_bytes(df).collect(), [d for d in docs if d[0] is not None] + [(None, None)])
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 0.01 * total / 16
    assert reshard.reshard_by_bytes(df.limit(0)).count() == 0


def test_third_of_many_rows_equal(spark):
    from pyspark.sql import functions as F
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x" * 20)).otherwise(F.lpad("id", 20, "y")).alias("text"))
    load = {r["shard"]: r["bytes"] for r in reshard.reshard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    assert len(load) == 16 and sum(load.values()) == n * 21
    assert max(load.values()) - min(load.values()) <= 0.01 * n * 21 / 16


def test_only_affected_files_are_rewritten(spark):
    from pyspark.sql import functions as F
    docs = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = scratch_path(spark, "test-shards")
    reshard.write_shards(docs, path, F.pmod("key", F.lit(4)), F.length("text"), shards=4, files=4, blocks=8)
    columns = "key bigint, text string, _size bigint, _row bigint, _block int, shard int, file int"
    old = reshard.read_shards(spark, path, columns)
    one = old.where("shard = 2 and file = 1 and _block = 3").count()
    new = reshard.rewrite(spark, path, {(2, 1, 3): 0}, columns)
    assert new.where("shard = 0 and old_shard = 2").count() == one > 0 and new.count() == 2000
    files = new.select(F.col("shard"), F.input_file_name().alias("f")).distinct().collect()
    rewritten = {f["f"].split("/shard=")[-1].rsplit("/", 1)[0] for f in files if path.split("/")[-1] not in f["f"]}
    assert rewritten == {"0/file=1", "2/file=1"}


def test_reshard_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op7_reshard"](spark, SF).collect()
    load, total = check_placement(rows, docs)
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 0.1 * total / 16
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
