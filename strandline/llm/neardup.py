"""Near duplicates of whole texts: wide candidates, each verified by exact shingle similarity.

A SimHash of 64 bits cannot tell a shingle similarity of 0.8: such pairs differ in 4 to 17 bits.  So the fingerprints' BK-trees
give only part of the candidates here; the others come from bands of minimal shingle hashes, which pairs of similarity 0.8
share with a probability of 0.9996.  No candidate is a link before the Jaccard similarity of its two texts' distinct
shingles is known to reach the threshold; groups are the components over such links.

The texts of a band that many share are compared with the one in their middle.  A band that this leaves in several groups is
then searched whole, block by block, inside tasks that emit a spanning forest; so nothing is lost and no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.common import cut_lineage, int64_bits, row_key
from strandline.operators.graph import connected_components
from strandline.operators.skew import lookup_join

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5       # 1 - (1 - 0.8**5)**20 = 0.9996
SMALL = 8                 # texts of a band that are compared pair by pair at once
BLOCK = 1024              # texts of a large band in one block; two blocks are searched by one task
SALT_ROWS = 64            # pairs of a band's first text that one copy of it is joined with

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, part by part; fewer words than ``width`` are one shingle, no words none."""
    data = (text or "").encode().translate(simhash._LOWER)
    join, xxh, carry, any_ = b" ".join, xxhash.xxh64_intdigest, [], False
    for words in simhash._word_lists(data):
        words = carry + words
        if len(words) >= width:
            any_ = True
            yield np.array([xxh(s, simhash.SEED) for s in map(join, zip(*(words[k:] for k in range(width)), strict=False))], dtype=np.uint64)
        carry = words[-(width - 1):] if len(words) >= width else words
    if not any_ and carry:
        yield np.array([xxh(join(carry), simhash.SEED)], dtype=np.uint64)


def signature(text: str | None, width: int = WIDTH) -> tuple[int, list[int]] | None:
    """(SimHash, band hashes) of a text, or None for a text without words."""
    ones, n, least = np.zeros(64, dtype=np.int64), 0, np.full(BANDS * ROWS, ~np.uint64(0), dtype=np.uint64)
    for h in shingle_hashes(text, width):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
        for s in range(0, len(h), 4096):
            np.minimum(least, (h[s:s + 4096, None] * _A + _B).min(axis=0), out=least)
    if n == 0:
        return None
    fp = int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    return fp, bands


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t, width) for t in batch.column(0).to_pylist()]
            fp = pa.array([None if f is None else int64_bits(f[0]) for f in found], pa.int64())
            bands = pa.array([None if f is None else [int64_bits(b) for b in f[1]] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fp, bands], ["id", "k", "fp", "bands"])
    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(np.concatenate([*shingle_hashes(t, width), np.zeros(0, dtype=np.uint64)])).view(np.int64) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
    return run


def _forest(similarity: float):
    """Links of a spanning forest over one cell's texts: from text to similar text, each reached once, through their common shingles."""
    def run(cell: pa.Table) -> pa.Table:
        ids, lists = cell["id"], cell["shingles"].combine_chunks()
        codes = np.asarray(lists.flatten().dictionary_encode().indices).astype(np.int64)
        size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        holders = np.repeat(np.arange(len(size)), size)[np.argsort(codes, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
        own = np.concatenate([[0], np.cumsum(size)])
        waiting, a, b = np.ones(len(size), dtype=bool), [], []
        for root in range(len(size)):
            front = [root] if waiting[root] else []
            waiting[root] = False
            while front and waiting.any():
                s = front.pop()
                shared = np.bincount(np.concatenate([holders[first[c]:first[c + 1]] for c in codes[own[s]:own[s + 1]].tolist()]), minlength=len(size))
                at = np.flatnonzero(waiting & (shared > 0))
                at = at[shared[at] / (size[s] + size[at] - shared[at]) >= similarity]
                waiting[at] = False
                front += at.tolist()
                a += [s] * len(at)
                b += at.tolist()
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})
    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, parts) whose shingle sets reach ``similarity``.

    ``a`` may be in very many pairs: its set is copied to as many parts as its pairs ask for.
    """
    wide = cut_lineage(pairs.groupBy("a", "b").agg(F.max("parts").alias("parts")), "near-pairs")
    copies = wide.groupBy("a").agg(F.max("parts").alias("parts"))
    left = sets.join(copies.withColumnRenamed("a", "id"), "id").select(
        F.col("id").alias("a"), F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    met = wide.select("a", "b", part).join(right, "b").join(left, ["a", "part"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return met.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b")


def groups(texts: DataFrame, *, similarity: float = SIMILARITY, width: int = WIDTH, bits: int = 6) -> DataFrame:
    """(id, component) of the texts with a link: ``texts`` has id (string), k (a long) and text, an id standing for one text.

    Links are pairs of different texts whose distinct ``width``-word shingles have a Jaccard similarity of at least
    ``similarity``.  Texts without words have no link.  A component is named by its smallest id.
    """
    signed = texts.select(F.col("text"), "id", "k").mapInArrow(_signatures(width), "id string, k long, fp long, bands array<long>")
    one = cut_lineage(signed.where("fp is not null"), "near-signatures")
    one_each = one.select("id", "fp", "bands").dropDuplicates(["id"])
    bands = cut_lineage(one_each.select("id", F.posexplode("bands").alias("band", "value")), "near-bands")
    sizes = bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    sized = lookup_join(bands, cut_lineage(sizes.withColumn("_n", F.col("n")), "near-sizes"), ["band", "value"], count_col="_n")
    # The text that shares its bands with most others stands in the middle of a family: the others are compared with it.
    weights = sized.groupBy("id").agg(F.sum("n").alias("weight"))
    sized = cut_lineage(sized.join(weights, "id"), "near-weighed")
    middle = sized.where(F.col("n") > SMALL).groupBy("band", "value").agg(F.max_by("id", F.struct("weight", "id")).alias("first"), F.count("*").alias("_n"))
    sized = cut_lineage(lookup_join(sized.drop("weight"), cut_lineage(middle, "near-middles"), ["band", "value"], count_col="_n", how="left"), "near-sized")
    few, many = sized.where(F.col("n") <= SMALL), sized.where(F.col("n") > SMALL)
    stars = many.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts"))
    single = F.lit(1).alias("parts")
    left = few.select("band", "value", F.col("id").alias("a"))
    paired = left.join(few.select("band", "value", F.col("id").alias("b")), ["band", "value"]).where("a < b").select("a", "b", single)
    # The fingerprints' trees: near fingerprints by a spanning forest, equal ones by a star.
    prints = cut_lineage(one_each.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "near-prints")
    tree = simhash.links(prints.select("fp"), bits).join(prints.select(F.col("fp").alias("a"), F.col("first").alias("ia")), "a") \
        .join(prints.select(F.col("fp").alias("b"), F.col("first").alias("ib")), "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), single)
    same = lookup_join(one_each.select("id", "fp"), prints.where("n > 1"), ["fp"], count_col="n", hot_rows=SALT_ROWS)
    equal = same.where("id <> first").join(prints.select("fp", "n"), "fp").select(
        F.col("first").alias("a"), F.col("id").alias("b"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts"))
    pairs = cut_lineage(stars.unionByName(paired).unionByName(tree).unionByName(equal), "near-candidates")

    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    chosen = one.join(asked, "id", "left_semi").groupBy("id").agg(F.min("k").alias("k"))
    needed = texts.join(chosen, ["id", "k"]).dropDuplicates(["id"])
    sets = cut_lineage(needed.select("text", "id").mapInArrow(_shingle_sets(width), "id string, shingles array<long>"), "near-sets")
    links = cut_lineage(_verified(pairs, sets, similarity), "near-links")
    found = cut_lineage(connected_components(links), "near-groups")

    # A band of many texts that its star left in several components is searched whole, in pairs of blocks.
    placed = many.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    apart = cut_lineage(apart.select("band", "value"), "near-apart")
    if apart.isEmpty():
        return found
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = many.join(apart, ["band", "value"]).withColumns({"mine": F.pmod(F.xxhash64("id"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    cells = dealt.select("band", "value", "id", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q")).join(sets, "id")
    more = cells.groupBy("band", "value", "p", "q").applyInArrow(_forest(similarity), "a string, b string")
    return connected_components(cut_lineage(links.unionByName(more.distinct()), "near-links"))


def keep_one(docs: DataFrame, *, similarity: float = SIMILARITY, width: int = WIDTH, bits: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns: the smallest key (null keys last), then the smallest text hash.

    Equal texts are duplicates, also empty and null ones (a null text is an empty one) and texts without words that are
    equal; so of the texts that an earlier stage emptied one stays.  Other texts without words have no duplicates.  A group
    is joined by links of verified similarity alone.  Repeated rows leave one row; an empty table stays empty.
    """
    last = (1 << 63) - 1
    h = row_key(F.col(text).cast("string"))
    name = F.concat(F.lpad(F.hex(h["a"]), 16, "0"), F.lpad(F.hex(h["b"]), 16, "0"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), name.alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(last)).alias("k"))
    found = cut_lineage(groups(marked.select("id", "k", F.col("row")[text].cast("string").alias("text")), similarity=similarity, width=width, bits=bits), "near-found")
    firsts = cut_lineage(marked.groupBy("id").agg(F.min("k").alias("k")), "near-firsts")
    named = firsts.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = named.groupBy("component").agg(F.min(F.struct("k", "id")).alias("first")).select("first.k", "first.id")
    again = F.row_number().over(Window.partitionBy("id", "k").orderBy("k"))
    return marked.join(kept, ["id", "k"], "left_semi").withColumn("again", again).where("again = 1").select("row.*")
