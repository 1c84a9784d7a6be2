"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts, so that neighbours tend to share a part.  A
small softmax classifier learns from it in which parts a vector's neighbours lie.  It puts every vector of the
index into its most probable part and sends a query to several; the candidates found there are reranked by
their exact inner product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, hash_sample, sorted_groups

SAMPLE = 8000             # vectors that the graph and the classifier are fitted on
PART_ROWS = 400           # sampled vectors of one part
RECALL = 0.96             # of neighbours that the probed parts must hold, measured on rows the fit did not see
AIM = 20                  # neighbours that this is measured on
NEIGHBOURS = 10           # of a vector in the graph
BLOCK_ROWS = 8192         # index rows of a part that one task reranks
QUERY_ROWS = 512          # queries that one task reranks


# ---- the fit ----------------------------------------------------------------------------------------

def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """For each row the k rows with the largest inner product (fewer rows: all others), in blocks of rows."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for s in range(0, len(x), 512):
        score = x[s:s + 512] @ x.T
        score[np.arange(len(score)), np.arange(s, s + len(score))] = -np.inf
        out[s:s + 512] = np.argpartition(-score, k - 1, axis=1)[:, :k] if k else out[s:s + 512]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A part for every row, each of at most 1.1 times the mean size, that cuts few edges of the graph.

    Starts from a balanced assignment to spherical k-means centres and moves rows to the part that holds most of
    their neighbours (both directions) while there is room."""
    n = len(x)
    room = int(np.ceil(1.1 * n / parts))
    rng = np.random.default_rng(seed)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = unit[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(rounds):
        near = unit @ centre.T
        order = np.argsort(-near.max(axis=1))
        load = np.zeros(parts, dtype=np.int64)
        for i in order.tolist():
            for p in np.argsort(-near[i]).tolist():
                if load[p] < room:
                    part[i], load[p] = p, load[p] + 1
                    break
        for p in range(parts):
            if load[p]:
                c = unit[part == p].sum(axis=0)
                centre[p] = c / max(np.linalg.norm(c), 1e-12)
    source = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([np.stack([source, graph.ravel()]), np.stack([graph.ravel(), source])], axis=1)
    starts = np.searchsorted(np.sort(both[0]), np.arange(n + 1))
    to = both[1][np.argsort(both[0], kind="stable")]
    load = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[to[starts[i]:starts[i + 1]]], minlength=parts)
            for p in np.argsort(-votes, kind="stable")[:4].tolist():
                if votes[p] <= votes[part[i]]:
                    break
                if load[p] < room:
                    load[part[i]] -= 1
                    load[p] += 1
                    part[i] = p
                    moved += 1
                    break
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """Softmax regression from vectors to parts."""
    weight: np.ndarray     # dimension x parts
    bias: np.ndarray
    scale: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x * self.scale) @ self.weight + self.bias


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, epochs: int = 60, rate: float = 0.05) -> Router:
    """Cross-entropy against the shares of the parts among a row and its neighbours, by Adam on shuffled batches."""
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    scale = 1.0 / max(float(np.sqrt((x ** 2).mean())), 1e-12)
    z = x * scale
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v, step = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)], 0
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            logit = z[rows] @ w + b
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            err = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            grads = [z[rows].T @ err + 1e-5 * w, err.sum(axis=0)]
            step += 1
            for k, (value, g) in enumerate(((w, grads[0]), (b, grads[1]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                value -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-9)
    return Router(w, b, scale)


def probes_for(router: Router, x: np.ndarray, unseen: np.ndarray, parts: int, recall: float) -> int:
    """How many parts a query must be sent to, so that they hold the share ``recall`` of the AIM nearest rows of ``x``
    on average over the ``unseen`` rows.  Clustered vectors need few, vectors without structure need most."""
    if parts == 1 or not len(unseen):
        return parts
    k = min(AIM, len(x))
    near = np.argpartition(-(unseen @ x.T), k - 1, axis=1)[:, :k]
    home = np.argmax(router.logits(x), axis=1)
    place = np.argsort(np.argsort(-router.logits(unseen), axis=1, kind="stable"), axis=1)
    reached = np.take_along_axis(place, home[near], axis=1)
    share = [(reached < t).mean() for t in range(1, parts + 1)]
    return int(np.searchsorted(share, recall)) + 1 if share[-1] >= recall else parts


# ---- search -----------------------------------------------------------------------------------------

def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(router, probes: int):
    """(id, vector, parts): the ``probes`` most probable parts, the best first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logit = router.value.logits(_matrix(batch.column(1)))
            best = np.argsort(-logit, axis=1, kind="stable")[:, :probes].astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * best.shape[1], pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], ["id", "v", "parts"])
    return run


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so equal vectors have equal scores."""
    return (rows * query).sum(axis=-1)


def top_of_block(queries: np.ndarray, qid: np.ndarray, rows: np.ndarray, rid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, row ids, scores) of each query's best ``k`` rows, its own id left out, ties to the smaller id.

    Of rows with one and the same vector only the k + 1 smallest ids can be among the best, so only they stay."""
    order = np.argsort(rid, kind="stable")
    rows, rid = rows[order], rid[order]
    _, same = np.unique(rows, axis=0, return_inverse=True)
    same = same.ravel()
    by = np.argsort(same, kind="stable")
    first = np.searchsorted(same[by], np.arange(same.max() + 1))
    keep = np.sort(by[np.arange(len(by)) - first[same[by]] <= k])
    rows, rid = rows[keep], rid[keep]
    rough = queries @ rows.T
    slack = 1e-9 * (1.0 + np.abs(rough).max()) if rough.size else 0.0
    for i in range(len(queries)):
        score = np.where(rid == qid[i], -np.inf, rough[i])
        if len(score) > k:
            near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - slack)
        else:
            near = np.arange(len(score))
        near = near[rid[near] != qid[i]]
        exact = exact_scores(queries[i], rows[near])
        best = np.lexsort((rid[near], -exact))[:k]
        yield int(qid[i]), rid[near][best], exact[best]


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part", "block", "team"]):
            ask = group.column("ask").to_numpy()
            if not ask.any() or ask.all():
                continue
            ids, v = group.column("id").to_numpy(), _matrix(group.column("v"))
            found = list(top_of_block(v[ask], ids[ask], v[~ask], ids[~ask], k))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
                pa.array(np.concatenate([f[2] for f in found]).astype(np.float64))], ["query_id", "vec_id", "score"])
    return run


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE, part_rows: int = PART_ROWS, probes: int | None = None, recall: float = RECALL,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` the ``k`` nearest found rows of ``vectors``.

    Nearness is the inner product; a row with the query's own id is no candidate; ties go to the smaller id.  Rows
    with a null id, a null or zero vector, a null, infinite or not-a-number component, or a dimension other than
    that of most vectors take no part.  Repeated (id, vector) rows count once; empty tables give no rows.

    Fitted on at most ``sample`` vectors (those whose ids hash lowest); every vector is indexed.  A query goes to
    ``probes`` parts (by default as many as an eighth of the sample, kept out of the fit, needs for ``recall``), and
    on to further ones until they hold more than ``k`` rows.  A part larger than
    ``block_rows`` is searched in blocks by several tasks, whose best rows are merged.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
            F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists(v, lambda c: c != 0))

    whole = clean(vectors)
    common = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], out)
    whole = whole.where(F.size("v") == common["d"]).dropDuplicates(["id", "v"])
    asked = clean(queries).where(F.size("v") == common["d"]).dropDuplicates(["id", "v"])
    picked = hash_sample(whole, "id", sample).collect()  # bounded by ``sample``
    x = np.unique(np.array([r["v"] for r in picked]), axis=0)
    x = x[np.random.default_rng(1).permutation(len(x))]
    x, unseen = x[len(x) // 8:], x[:len(x) // 8]
    parts = max(1, len(x) // part_rows)
    graph = neighbour_graph(x)
    fitted = fit_router(x, graph, balanced_parts(x, graph, parts), parts)
    probes = min(parts, probes or probes_for(fitted, x, unseen, parts, recall))
    router = spark.sparkContext.broadcast(fitted)

    indexed = cut_lineage(whole.mapInArrow(_assign(router, 1), "id long, v array<double>, parts array<int>")
                          .select("id", "v", F.element_at("parts", 1).alias("part")), "ann-index")
    sizes = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each part
    counts = F.array(*[F.lit(sizes.get(p, 0)) for p in range(parts)])
    blocks = F.array(*[F.lit(-(-max(sizes.get(p, 0), 1) // block_rows)) for p in range(parts)])
    ranked = asked.mapInArrow(_assign(router, parts), "id long, v array<double>, parts array<int>")
    held = F.transform("parts", lambda p: F.get(counts, p))
    before = F.transform(held, lambda n, i: F.aggregate(F.slice(held, F.lit(1), i), F.lit(0), lambda a, b: a + b))
    # A part is asked while it is among the first ``probes`` or those before it hold no more than k rows.
    go = ranked.select("id", "v", F.explode(F.filter(F.arrays_zip(F.col("parts").alias("part"), before.alias("before"), F.sequence(F.lit(0), F.size("parts") - 1).alias("i")),
                                                     lambda z: (z["i"] < probes) | (z["before"] <= k))).alias("z"))
    to = go.select("id", "v", F.col("z.part").alias("part"))
    block_of = F.pmod(F.xxhash64("id"), F.get(blocks, F.col("part"))).cast("int")
    n_asked = asked.count()
    teams = max(1, -(-n_asked // (QUERY_ROWS * max(1, parts // probes))))
    team = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(teams)).cast("int")
    q_rows = to.select("part", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("part")) - 1)).alias("block"), team.alias("team"),
                       F.lit(True).alias("ask"), "id", "v")
    i_rows = indexed.select("part", block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"),
                            F.lit(False).alias("ask"), "id", "v")
    keys = ["part", "block", "team"]
    met = q_rows.unionByName(i_rows).repartition(*keys).sortWithinPartitions(*keys)
    best = met.mapInArrow(_rerank(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
