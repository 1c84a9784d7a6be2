"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Two fingerprints that differ in at most r of 64 bits agree on at least m - r of m blocks of bits.
For each choice of m - r blocks, fingerprints with equal bits there form a shard; every pair within
the radius meets in some shard.  A shard's BK-tree keys children by their integer Hamming distance to
the parent, and a search follows only edges whose key lies within the radius of the query's distance.
Trees are built where their shard was shuffled to instead of being broadcast, since all trees together
are as large as the corpus.  Many fingerprints go down a tree at once, as arrays.  m follows the number
of fingerprints, so that a shard of unrelated ones stays small; a shard that is large all the same (a
family of near copies) is cut into blocks, and each pair of blocks is a task of its own.
A shard emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, int64_bits, row_key, sorted_groups
from strandline.operators.graph import connected_components
from strandline.operators.skew import lookup_join

BITS = 64
SEED = 42
STEP = 1 << 20            # bytes of a text that are split into words at once
LEAF = 24                 # a node with fewer points below it is a bucket that is scanned
BLOCK_ROWS = 4096         # fingerprints of one shard in one block
SHARD_MEAN = 1024         # unrelated fingerprints of a shard: a tree of so many is cheaper than more and smaller shards

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = b" \t\n\x0b\x0c\r"


# ---- fingerprints -----------------------------------------------------------------------------------

def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    left = b""
    for start in range(0, len(data), STEP):
        part = left + data[start:start + STEP]
        left = b""
        if start + STEP < len(data):
            cut = max(part.rfind(c) for c in _SPACE) + 1
            part, left = part[:cut], part[cut:]
        yield part.split()
    if left:
        yield left.split()


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the text's word shingles (XXH64, seed 42), repeats included: a bit is set if it is set in
    over half of the hashes.  Fewer words than ``width`` are one shingle; no words give 0."""
    data = (text or "").encode().translate(_LOWER)
    ones, n, carry, join, xxh = np.zeros(BITS, dtype=np.int64), 0, [], b" ".join, xxhash.xxh64_intdigest
    for words in _word_lists(data):
        words = carry + words
        if len(words) >= width:
            shingles = zip(*(words[k:] for k in range(width)))
            h = np.array([xxh(s, SEED) for s in map(join, shingles)], dtype="<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(h)
        carry = words[-(width - 1):] if width > 1 else []
    if n == 0:
        return xxh(join(carry), SEED) if carry else 0
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, *, keys: list[str], text: str = "text", width: int = 4) -> DataFrame:
    """The ``keys`` (longs) and fp for every row; fp holds the 64 bits as a signed long.  A null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [int64_bits(fingerprint(t, width)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], [*keys, "fp"])
    return (docs.select(F.col(text).cast("string").alias("text"), *[F.col(k).cast("long").alias(k) for k in keys])
            .mapInArrow(run, ", ".join(f"`{k}` long" for k in keys) + ", fp long"))


# ---- BK-trees ---------------------------------------------------------------------------------------

class Forest:
    """Components of points that are linked one after another."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, point: int, others: np.ndarray) -> None:
        mine = self.label[point]
        others = others[self.label[others] != mine]
        for other in np.unique(self.label[others]).tolist():
            if other != mine:
                lo, hi = min(mine, other), max(mine, other)
                self.label[self.label == hi] = lo
                mine = lo


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def bk_tree(points: np.ndarray, index: np.ndarray):
    """The tree over ``points[index]``: (pivot, {distance: subtree}), or an array of points as a leaf bucket."""
    if len(index) <= LEAF:
        return index
    pivot, rest = int(index[0]), index[1:]
    d = _distance(points[rest], points[pivot])
    order = np.argsort(d, kind="stable")
    keys, starts = np.unique(d[order], return_index=True)
    return pivot, {int(k): bk_tree(points, part) for k, part in zip(keys, np.split(rest[order], starts[1:]))}


def search(tree, points: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Link every point of ``queries`` (indexes) with the tree's points within ``radius``, edge by edge."""
    todo = [(tree, queries)]
    while todo:
        node, q = todo.pop()
        if isinstance(node, np.ndarray):
            near = _distance(points[node][:, None], points[q][None, :]) <= radius
            for i in range(len(node)):
                forest.link(int(node[i]), q[near[i]])
            continue
        pivot, children = node
        d = _distance(points[q], points[pivot])
        forest.link(pivot, q[d <= radius])
        for key, child in children.items():
            follow = q[np.abs(d - key) <= radius]
            if len(follow):
                todo.append((child, follow))


def shard_links(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of a spanning forest of all links within ``radius``; with ``side``, only links
    from side 0 to side 1 are asked for."""
    points = fps.view(np.uint64)
    forest = Forest(len(points))
    every = np.arange(len(points))
    inside, asking = (every, every) if side is None else (every[side == 0], every[side == 1])
    search(bk_tree(points, inside), points, asking, radius, forest)
    moved = np.flatnonzero(forest.label != every)
    return fps[moved], fps[forest.label[moved]]


def _blocks_for(count: int, radius: int) -> int:
    """Blocks m > radius, so that ``count`` unrelated fingerprints give shards of about SHARD_MEAN."""
    for m in range(radius + 1, radius + 6):
        if count <= SHARD_MEAN << (BITS * (m - radius) // m):
            return m
    return radius + 5


def _masks(m: int, radius: int) -> list[int]:
    edges = [BITS * i // m for i in range(m + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [int64_bits(sum(c)) for c in itertools.combinations(block, m - radius)]


def links(fps: DataFrame, radius: int = 4, *, blocks: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) fingerprint links that connect all pairs of distinct ``fps.fp`` within ``radius`` bits."""
    m = blocks or _blocks_for(fps.count(), radius)
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in _masks(m, radius)]))
                        .alias("table", "value"))
    sizes = shards.groupBy("table", "value").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    sized = shards.join(sizes.select("table", "value", parts.alias("parts")), ["table", "value"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = sized.select("fp", "table", "value", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tasks = pairs.select("fp", "table", "value", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["table", "value", "p", "q"]):
            if group.num_rows < 2:
                continue
            fp = group.column("fp").to_numpy()
            one = group.column("p")[0].as_py() == group.column("q")[0].as_py()
            a, b = shard_links(fp, radius, None if one else group.column("side").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys = ["table", "value", "p", "q"]
    return tasks.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long").distinct()


def components(prints: DataFrame, order: Column, radius: int = 4) -> DataFrame:
    """``prints`` with component_id: the smallest ``order`` reachable over links of at most ``radius`` differing
    bits of fp (nulls are passed over; a component of nulls only has a null id)."""
    groups = cut_lineage(prints.groupBy("fp").agg(F.min(order).alias("least")), "simhash-groups")
    joined = connected_components(cut_lineage(links(groups.select("fp"), radius), "simhash-links"))
    named = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = cut_lineage(named, "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_print = lookup_join(named.select("fp", "component"), cut_lineage(least, "simhash-components"), ["component"], count_col="n") \
        .select("fp", "component_id")
    return prints.join(by_print, "fp")


def near_duplicates(docs: DataFrame, *, radius: int = 4, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``key``, fingerprint (16 hexadecimal digits) and component_id for every row.

    A null or wordless text has fingerprint zero and is linked like any other.  Repeated rows and equal
    texts share a fingerprint, hence a component; an empty table gives no rows.  Only ``key`` and
    ``text`` are read, so other columns cannot clash.
    """
    prints = cut_lineage(fingerprints(docs, keys=[key], text=text, width=width), "simhash-prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return components(prints, F.col(key), radius).select(key, hexed, "component_id")


def keep_one(docs: DataFrame, *, radius: int = 4, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """One row of each component, with all columns: the smallest key (null keys last), then the smallest text hash.

    Of rows equal in key and text one stays.  Texts without words are one component."""
    last = (1 << 63) - 1
    k = row_key(F.col(text).cast("string"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(last)).alias("k"),
                         k["a"].alias("ka"), k["b"].alias("kb"))
    prints = cut_lineage(fingerprints(marked.select("k", "ka", "kb", F.col("row")[text].alias("_text")), keys=["k", "ka", "kb"],
                                      text="_text", width=width), "simhash-prints")
    found = components(prints, F.struct("k", "ka", "kb"), radius)
    chosen = found.where(F.struct("k", "ka", "kb") == F.col("component_id")).select("k", "ka", "kb").distinct()
    again = F.row_number().over(Window.partitionBy("k", "ka", "kb").orderBy("k"))
    return marked.join(chosen, ["k", "ka", "kb"], "left_semi").withColumn("again", again).where("again = 1").select("row.*")
