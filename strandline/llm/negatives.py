"""Hard-negative mining by a secondary sort.

Anchors meet all rows in blocks.  A block's task reduces an anchor's pair scores to those that can still count: the
best same-label rows, then, once an anchor's positives are known, the best rows of each positive's score window.  What
is left goes through one shuffle keyed (anchor, descending score, kind, id), the DataFrame form of
``repartitionAndSortWithinPartitions``: rows are dealt out by the anchor alone and arrive sorted by the whole key.
A streaming iterator walks an anchor's rows once from the highest score down.  A positive opens a window, a negative
goes to every open window with room, and a window closes when the scores fall below it; the iterator holds the open
windows of one anchor and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, sorted_groups

POSITIVES = 5
NEGATIVES = 5
LEAST = (80, 100)         # a negative scores at least 80/100 of the positive
ROW_BLOCK = 16_384        # rows of one cell, at most about
ANCHOR_BLOCK = 16_384     # anchors of one cell, at most about
TILE = 4 << 20            # scores a task holds at a time


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, in double precision, as longs."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    """No null vector, no null, infinite or not-a-number component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & fine


# ---- one cell: a block of anchors and a block of rows ------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` longs; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact.  Doubles hold them below 2**53; scores past 64 bits stop at the last long."""
    top = int(max(a.max(initial=0), -int(a.min(initial=0)))) * int(max(b.max(initial=0), -int(b.min(initial=0)))) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; equal scores in the order given."""
    n = len(score)
    at = np.flatnonzero(score >= np.partition(score, n - k)[n - k]) if n > k else np.arange(n)
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _sides(cell: pa.Table) -> tuple[pa.Table, pa.Table, int]:
    ask = np.asarray(cell["ask"])
    width = max(np.diff(np.asarray(cell["v"].combine_chunks().offsets)).max(initial=0), 1)
    rows = cell.filter(pa.array(~ask)).sort_by("id")     # equal scores then stand by id
    return cell.filter(pa.array(ask)), rows, int(width)


def _pairs(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
        pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
        pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))], ["anchor", "score", "id"])


PAIR = "anchor long, score long, id long"


def _best_positives(k: int):
    """A cell's k best rows of the anchor's label, for every anchor of the cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, ["block", "team"]):
            asks, rows, width = _sides(cell)
            ids, labels, v = np.asarray(rows["id"]), np.asarray(rows["label"]), _matrix(rows["v"], width)
            a_ids, a_labels, a_v = np.asarray(asks["id"]), np.asarray(asks["label"]), _matrix(asks["v"], width)
            for label in np.unique(a_labels).tolist():
                mine, own = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                step = max(1, TILE // max(len(own), 1))
                for s in range(0, len(mine), step):
                    part = mine[s:s + step]
                    score = np.ascontiguousarray(_products(a_v[part], v[own]))
                    found = []
                    for i, row in zip(part.tolist(), score, strict=True):
                        other = np.flatnonzero(ids[own] != a_ids[i])
                        best = other[_first(row[other], k)]
                        found.append((int(a_ids[i]), row[best], ids[own][best]))
                    if found:
                        yield _pairs(found)
    return run


def _least_score(positive: int, least: tuple[int, int]) -> int:
    """The least n with least[0] * positive <= least[1] * n."""
    return -(-least[0] * positive // least[1])


def _window_negatives(k: int, least: tuple[int, int]):
    """A cell's k best rows of other labels in each window of the anchor's positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, ["block", "team"]):
            asks, rows, width = _sides(cell)
            ids, labels, v = np.asarray(rows["id"]), np.asarray(rows["label"]), _matrix(rows["v"], width)
            a_ids, a_labels, a_v = np.asarray(asks["id"]), np.asarray(asks["label"]), _matrix(asks["v"], width)
            tops = asks["tops"].to_pylist()
            step = max(1, TILE // max(len(ids), 1))
            for s in range(0, len(a_ids), step):
                found = []
                for i, row in enumerate(np.ascontiguousarray(_products(a_v[s:s + step], v)), s):
                    windows = [(_least_score(p, least), p) for p in set(tops[i]) if _least_score(p, least) <= p]
                    if not windows:
                        continue
                    near = np.flatnonzero((row >= min(w[0] for w in windows)) & (row <= max(w[1] for w in windows)) & (labels != a_labels[i]))
                    score = row[near]
                    keep = set()
                    for low, high in windows:
                        inside = np.flatnonzero((score >= low) & (score <= high))
                        keep.update(inside[_first(score[inside], k)].tolist())
                    at = np.array(sorted(keep), dtype=np.int64)
                    found.append((int(a_ids[i]), score[at], ids[near[at]]))
                if found:
                    yield _pairs(found)
    return run


# ---- the streaming iterator --------------------------------------------------------------------------

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def emit_windows(rows: Iterator[tuple[int, int, bool, int]], positives: int, negatives: int, least: tuple[int, int]) -> Iterator[tuple]:
    """Rows (anchor, score, is_negative, id) sorted by anchor, falling score, positives first, id: the mined tuples.

    Holds at most ``positives`` open windows of one anchor."""
    anchor, opened, windows = None, 0, []
    for a, score, negative, row in rows:
        if a != anchor:
            anchor, opened, windows = a, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([row, score, _least_score(score, least), 0])
            continue
        windows = [w for w in windows if score >= w[2] and w[3] < negatives]
        for w in windows:
            if score <= w[1]:
                w[3] += 1
                yield a, w[0], w[3], row, w[1], score


def _emit(positives: int, negatives: int, least: tuple[int, int]):
    names = [c.split()[0] for c in MINED.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["anchor"].to_pylist(), b["score"].to_pylist(), b["negative"].to_pylist(), b["id"].to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def pack() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        for mined in emit_windows(stream(batches), positives, negatives, least):
            held.append(mined)
            if len(held) == 8192:
                yield pack()
                held = []
        if held:
            yield pack()
    return run


# ---- the operator ------------------------------------------------------------------------------------

def mine(vectors: DataFrame, anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: tuple[int, int] = LEAST,
         row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector`` holds integers, ``label`` an integer; ``anchor`` says which rows are anchors.  A row's score is its
    inner product with the anchor; higher scores come first, ties by smaller id.  The positives of an anchor are its
    first ``positives`` other rows of the same label.  For each of them come the first ``negatives`` rows of other
    labels whose score is at most the positive's and at least least[0]/least[1] of it, ranked from 1.

    Rows with a null id, label, vector or component take no part.  An id stands for one vector: of rows that share
    one, the least by (label, vector) counts, so repeated rows change nothing.  Missing trailing components count
    as zeros; an empty vector scores 0 with every row.  A positive of negative score has an empty window.  Tables
    without rows, anchors or other labels give no rows.  Other columns of ``vectors`` are not looked at.

    The work is anchors times rows, in cells of ``anchor_block`` by ``row_block``; each side is copied to the cells
    of its row or column of the grid.  No group is held whole: labels, hot or not, are cut into the same cells, and
    a cell passes on at most ``positives`` and then positives * negatives rows for each anchor.
    """
    spark = vectors.sparkSession
    mark = F.coalesce(anchor, F.lit(False)).cast("int")
    whole = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                           F.col(vector).cast("array<long>").alias("v"), mark.alias("ask"))
    whole = whole.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    one = whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("ask").alias("ask"))
    rows = cut_lineage(one.select("id", "r.label", "r.v", (F.col("ask") == 1).alias("asks")), "negatives-rows")
    n_rows, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(4 * spark.sparkContext.defaultParallelism, -(-n_rows // row_block))
    teams = max(1, -(-n_asks // anchor_block))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    team = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(teams)).cast("int").alias("team")
    all_blocks, all_teams = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for n, c in ((blocks, "block"), (teams, "team")))

    def cells(asks: DataFrame) -> DataFrame:
        """Every anchor beside every row, a cell of the grid after the other."""
        left = asks.select(all_blocks, team, F.lit(True).alias("ask"), "id", "label", "v", "tops")
        right = rows.select(block, all_teams, F.lit(False).alias("ask"), "id", "label", "v", F.lit(None).cast("array<long>").alias("tops"))
        return left.unionByName(right).repartition("block", "team").sortWithinPartitions("block", "team")

    asks = rows.where("asks").select("id", "label", "v")
    best = cells(asks.withColumn("tops", F.lit(None).cast("array<long>"))).mapInArrow(_best_positives(positives), PAIR)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = cut_lineage(best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"), "negatives-positives")
    tops = chosen.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("tops"))  # at most ``positives`` of them
    near = cells(asks.join(tops, "id")).mapInArrow(_window_negatives(negatives, least), PAIR)
    pairs = chosen.withColumn("negative", F.lit(False)).unionByName(near.withColumn("negative", F.lit(True)))
    packed = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", "id")
    return packed.mapInArrow(_emit(positives, negatives, least), MINED)
