"""Quality classifier: naive Bayes support vectors.

Every text is a set of hashed n-gram indicators: words, and runs of one to three word shapes (number,
capital, plain, same as the word before) with the characters that follow each word.  Indicators are
scaled by the log-count ratio of the classes, rows are scaled to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent.  Scores are the calibrated margin (a logistic curve fitted
to rows that the weights did not see).

The fit takes at most ``max_rows`` labelled rows (those whose ids hash lowest); scoring takes all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm import words as wd
from strandline.llm.common import hash_sample

FEATURE_BITS = 18
MAX_ROWS = 6000
_LOW = np.uint64((1 << FEATURE_BITS) - 1)


def _indicators(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its distinct features (int64 places below 2**FEATURE_BITS)."""
    last = np.zeros(1 << FEATURE_BITS, dtype=np.int64)
    for first in range(0, len(texts), 128):
        part = texts[first:first + 128]
        w = wd.scan(part)
        runs = w.runs(len(part))
        raw = np.frombuffer(w.data, dtype=np.uint8)
        until = np.minimum(np.concatenate([w.start[1:], [len(raw)]]) if len(w) else w.start, w.end + 3)
        gap = np.zeros(len(w), dtype=np.uint64)
        for k in range(3):
            at = w.end + k
            gap = gap * np.uint64(256) + np.where(at < until, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint64)
        same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])]) if len(w) else w.number
        kind = np.where(same, 3, np.where(w.number, 2, np.where(w.capital, 1, 0))).astype(np.uint64)
        shape = wd.mix(kind * np.uint64(1 << 32) + gap + np.uint64(7))
        two = wd.mix(shape[:-1] * np.uint64(31) + shape[1:]) if len(w) > 1 else shape[:0]
        three = wd.mix(two[:-1] * np.uint64(37) + shape[2:]) if len(w) > 2 else shape[:0]
        lists = [(a & _LOW).astype(np.int64) for a in (wd.mix(w.hash), shape, two, three)]
        for d in range(len(part)):
            s, e = runs[d], runs[d + 1]
            f = np.concatenate([lists[0][s:e], lists[1][s:e], lists[2][s:max(s, e - 1)], lists[3][s:max(s, e - 2)]])
            last[f] = np.arange(len(f))
            yield f[last[f] == np.arange(len(f))]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int,
                            epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of min 0.5 |w|^2 + sum cost_i max(0, 1 - y_i w.x_i); the last weight is the bias."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            f, v = rows[i], values[i]
            slope = y[i] * (float(w[f] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels, classes weighing the same, by Newton's method."""
    hi, lo = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    weight = np.where(y > 0, 0.5 / hi, 0.5 / lo)
    x = np.stack([margin, np.ones_like(margin)])
    a = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        grad = x @ (weight * (p - target)) + 1e-6 * a
        hess = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


@dataclass
class Model:
    weights: np.ndarray    # per feature, ratio included
    bias: float
    slope: float
    shift: float

    def margin(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.weights[f].sum() / np.sqrt(max(len(f), 1)) + self.bias for f in _indicators(texts)])

    def scorer(self, spark: SparkSession):
        """A function from a text column to its score, 0 to 1; null counts as empty."""
        shared = spark.sparkContext.broadcast(self)  # 2**FEATURE_BITS weights, whatever was learnt from

        @pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            m = shared.value
            z = m.slope * m.margin([None if t is None else t for t in texts.tolist()]) + m.shift
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return lambda column: score(F.coalesce(column.cast("string"), F.lit("")))


def fit(rows: list[tuple[int, np.ndarray]], cost: float = 1.0) -> Model:
    """``rows``: (label 0 or 1, features).  With one class only, that class is certain; with none, all scores are 0.5."""
    size = 1 << FEATURE_BITS
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 0.0, 0.0 if not len(y) else 20.0 * float(y[0]))
    pos, neg = np.ones(size), np.ones(size)
    for label, f in rows:
        (pos if label else neg)[f] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    every = np.arange(len(rows))
    aside = every % 4 == 3
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(rows), dtype=bool)
    learn = every[~aside]
    values = [ratio[f] / np.sqrt(max(len(f), 1)) for _, f in rows]
    share = (y[learn] > 0).mean()
    costs = cost * np.where(y[learn] > 0, 0.5 / share, 0.5 / (1 - share))
    w = dual_coordinate_descent([rows[i][1] for i in learn], [values[i] for i in learn], y[learn], costs, size)
    seen = every[aside] if aside.any() else every
    margin = np.array([float(w[rows[i][1]] @ values[i]) + w[-1] for i in seen])
    return Model(w[:-1] * ratio, float(w[-1]), *_logistic(margin, y[seen]))


def _is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold (crc32 of the id mod 3 is 1).

    Rows with a null key or label are left out; repeated labels of a document count as the lowest, repeated
    documents as one row.  Only the sampled ids are broadcast, and only their features reach the driver."""
    ids = F.col(key).cast("long")
    known = labels.select(ids.alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    sample = hash_sample(known.where(~_is_held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y")), "id", max_rows)
    chosen = docs.select(ids.alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype("<i4").tobytes() for f in _indicators(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "y", "f"])

    rows = (chosen.select("id", "y", "text").mapInArrow(features, "id long, y int, f binary")
            .groupBy("id", "y").agg(F.min("f").alias("f")).collect())
    rows.sort(key=lambda r: zlib.crc32(str(r["id"]).encode("ascii")) ^ 0x5bd1e995)
    return fit([(r["y"], np.frombuffer(r["f"], dtype="<i4").astype(np.int64)) for r in rows])


def score_documents(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted for every row.  A null key is in no fold (held_out is false); a null or
    empty text gets the score of a text without indicators; repeated rows score alike; only ``key`` and ``text`` are read."""
    score = model.scorer(docs.sparkSession)
    return docs.select(F.col(key), _is_held_out(F.col(key)).alias("held_out"), score(F.col(text)).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows whose text scores 0.5 or more, with all their columns."""
    return docs.where(model.scorer(docs.sparkSession)(docs[text]) >= 0.5)
