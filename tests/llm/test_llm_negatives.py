"""Hard negatives against brute force: ties, hot labels, wide numbers, odd rows."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import negatives
from strandline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<long>"


def brute(rows, every, positives=5, count=5, least=(80, 100)):
    seen = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            seen[i] = min(seen.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in seen.items():
        if a % every:
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in seen.items() if i != a))
        for p, pid, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [(i, -s) for s, i, other in ranked if other != label and least[0] * -p <= least[1] * -s <= least[1] * -p]
            out += [(a, pid, k, i, -p, s) for k, (i, s) in enumerate(fit[:count], 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", score string, rank int")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("labels, size", [(10, 4), (2, 2), (1, 3)])
def test_equals_brute_force(spark, labels, size):
    rng = random.Random(labels)
    rows = [(i, 0 if rng.random() < 0.34 else rng.randrange(labels), [rng.randint(-3, 6) for _ in range(size)]) for i in range(400)]
    want = brute(rows, 10)
    assert mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, row_block=17, anchor_block=7) == want
    assert bool(want) == (labels > 1)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 4]), (3, 2, [3]), (4, 2, []), (5, None, [3, 4]), (None, 1, [3, 4]), (6, 2, None), (7, 2, [3, None]),
            (0, 1, [3, 4]), (2, 2, [3, 4]), (8, 1, [-3, -4]), (9, 2, [-3, -3]), (10, 3, [0, 0])]
    padded = [(i, label, v if v is None else v + [0] * (2 - len(v))) for i, label, v in rows]
    assert mined(spark, rows, 10) == brute(padded, 10)
    assert mined(spark, [], 10) == []
    assert mined(spark, rows[1:2], 10) == []


def test_wide_numbers_stay_exact(spark):
    rng = random.Random(8)
    for top in (1 << 27, 1 << 30):
        rows = [(i, i % 3, [rng.randint(top - 40, top) for _ in range(4)]) for i in range(60)]
        assert mined(spark, rows, 7) == brute(rows, 7)
    a = np.array([[1 << 62, 1 << 62]])
    assert negatives._products(a, a).tolist() == [[(1 << 63) - 1]]


def test_the_iterator_holds_only_open_windows():
    """A hundred thousand negatives pass a window that closes; nothing is gathered."""
    def rows():
        yield 0, 100, False, 7
        for i in range(100_000):
            yield 0, 100 if i < 2 else 70, True, i
        yield 1, 50, True, 3
        yield 1, 40, False, 9
        yield 1, 40, True, 4
        yield 1, 32, True, 5
        yield 1, 31, True, 6
    assert list(negatives.emit_windows(rows(), 5, 5, (80, 100))) == [(0, 7, 1, 0, 100, 100), (0, 7, 2, 1, 100, 100), (1, 9, 1, 4, 40, 40), (1, 9, 2, 5, 40, 32)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, SF).collect())
    assert got and got == sorted(con.execute(ORACLES["op11_hard_negatives"]).fetchall())
