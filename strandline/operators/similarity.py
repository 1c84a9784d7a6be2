"""Set-similarity self-join by prefix filtering.

Two sets with Jaccard >= t must share one of their rarest tokens: sorting every
set's tokens by corpus frequency, a common token lies in both prefixes of length
n - ceil(t*n) + 1.  So only prefixes are joined, each pair is produced at its first
common token only, and size and position bounds reject most candidates before the
sets are compared.  Equal sets must be collapsed by the caller (``with_set_id``), so
a large group of copies is one set.

A token that is in more than ``PAIR_ROWS`` prefixes would still pair too many sets.
Pairs whose first common token is hot share only hot tokens (they sort last), so
they are found through the first *two* common tokens instead, which lie in prefixes
one longer.  Pairs for which one shared token is enough are small (sizes p + q <= (1+t)/t)
and every two of them under one token are results; at t = 0.35 that is a 1-token set
inside 2-token sets, of which there is one per token.

Each set also has a signature of 512 bits, each token turning one of them.  Bits in which two signatures differ come from
tokens that only one set has, so they bound the shared tokens from above; most candidates are rejected by that
bound, and only the others' token arrays are intersected.

Keys that are still longer (two tokens that half of all titles share) are dealt to blocks
of ``PAIR_ROWS`` sets, and every pair of blocks is a join key of its own: no key that is
joined holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import HOT_ROWS, lookup_join
from strandline.runtime import cut_lineage


PAIR_ROWS = 20_000         # sets under one key that are paired with each other
SIG_WORDS = 8              # words of 64 bits of a set's signature
LIGHT_ROWS = 64            # sets under one key below which all pairs are linear in the sets anyway


def with_set_id(df: DataFrame, tokens: str, block: list[str], unique: str | None = None) -> DataFrame:
    """Hash of block and token set.  With ``unique``, rows without tokens stay apart."""
    body = F.array_join(F.array_sort(F.col(tokens)), " ")
    if unique is not None:
        body = F.when(F.size(tokens) == 0, F.concat(F.lit("#"), F.col(unique).cast("string"))).otherwise(body)
    parts = [F.coalesce(F.col(b), F.lit("")) for b in block] + [body]
    return df.withColumn("set_id", F.sha2(F.concat_ws("|", *parts), 256))


def _prefix_length(n: Column, threshold: float, min_shared: int, depth: int) -> Column:
    need = F.greatest(F.ceil(n * threshold - 1e-9), F.lit(max(min_shared, 1)))
    return (n - need + depth).cast("int")


def _ordered(sets: DataFrame, block: list[str], min_shared: int, hot_rows: int) -> DataFrame:
    """set_id, block, n, toks and sig: each set's tokens, the rarest first, and its signature."""
    blk = F.xxhash64(*[F.col(b) for b in block]) if block else F.lit(0).cast("bigint")
    base = sets.select("set_id", blk.alias("block"), F.size("tokens").alias("n"),
                       F.explode("tokens").alias("token"))
    freq = cut_lineage(base.groupBy("token").agg(F.count("*").alias("df")), "sim-frequency")
    keyed = lookup_join(base, freq.withColumn("_n", F.col("df")), ["token"], count_col="_n", hot_rows=hot_rows)
    bit = F.xxhash64("token")
    words = [F.bit_xor(F.when(F.pmod(F.shiftright(bit, 6), F.lit(SIG_WORDS)) == i, F.expr("shiftleft(1L, cast(xxhash64(token) & 63 as int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"s{i}")
             for i in range(SIG_WORDS)]
    ordered = (keyed.groupBy("set_id", "block", "n")
               .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("pairs"), *words)
               .select("set_id", "block", "n", F.col("pairs.token").alias("toks"), F.struct(*[f"s{i}" for i in range(SIG_WORDS)]).alias("sig")))
    return cut_lineage(ordered.where(F.col("n") >= min_shared), "sim-ordered")


def similar_sets(sets: DataFrame, block: list[str], *, threshold: float, min_shared: int = 1,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """All pairs (set_a < set_b, shared, similarity) with Jaccard >= threshold.

    ``sets``: distinct sets as set_id, tokens (array<string>) and the block columns.
    """
    ordered = _ordered(sets, block, min_shared, hot_rows)
    prefix = ordered.select(
        "*", F.posexplode(F.slice("toks", F.lit(1), _prefix_length(F.col("n"), threshold, min_shared, 1)))
        .alias("pos", "token"))
    load = prefix.groupBy("block", "token").agg(F.count("*").alias("load"))
    limit_rows = min(hot_rows, PAIR_ROWS)
    hot = cut_lineage(load.where(F.col("load") > limit_rows).select("block", "token"), "sim-hot")
    if hot.isEmpty():
        return _pair_up(prefix.withColumnRenamed("token", "key"), threshold, min_shared)

    hot_b = hot.withColumnRenamed("token", "key")
    cold = prefix.withColumnRenamed("token", "key").join(hot_b, ["block", "key"], "left_anti")
    out = _pair_up(cold, threshold, min_shared)

    # Deeper prefixes for hot tokens: every ordered pair of tokens starting with a hot one.
    deep = ordered.withColumn(
        "deep", F.slice("toks", F.lit(1), _prefix_length(F.col("n"), threshold, min_shared, 2)))
    first = deep.select("*", F.posexplode("deep").alias("pos", "key")).join(hot_b, ["block", "key"], "left_semi")
    double = first.select(
        "set_id", "block", "n", "toks", "sig", "pos", F.col("key").alias("t1"),
        F.explode(F.slice("deep", F.col("pos") + 2, F.size("deep"))).alias("t2"))
    double = double.withColumn("key", F.concat_ws(" ", "t1", "t2")).drop("t1", "t2")
    out = out.unionByName(_pair_up(double, threshold, min_shared, depth=2, limit_rows=limit_rows))

    # Pairs that share exactly one token: any two sets of sizes p and q with p + q within the
    # limit that hold the hot token.  Sizes are joined size by size, so only results are formed.
    limit = math.floor((1 + threshold) / threshold + 1e-9)
    if min_shared <= 1:
        single = ordered.where(F.col("n") < limit).select("set_id", "block", "n", "toks", F.explode("toks").alias("key")) \
            .join(hot_b, ["block", "key"], "left_semi")
        for p in range(1, limit // 2 + 1):
            for q in range(max(p, 2), limit - p + 1):
                out = out.unionByName(_share_one(single.where(F.col("n") == p), single.where(F.col("n") == q), p, q))
    return out


def _share_one(left: DataFrame, right: DataFrame, p: int, q: int) -> DataFrame:
    a = left.select("block", "key", F.col("set_id").alias("a"), F.col("toks").alias("ta"))
    b = right.select("block", "key", F.col("set_id").alias("b"), F.col("toks").alias("tb"))
    order = F.col("a") < F.col("b") if p == q else F.lit(True)
    pairs = a.join(b, ["block", "key"]).where(order & (F.size(F.array_intersect("ta", "tb")) == 1))
    return pairs.select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"), F.lit(1).alias("shared"),
                        F.lit(1 / (p + q - 1)).alias("similarity"))


def _in_blocks(keys: DataFrame, limit_rows: int) -> DataFrame:
    """``keys`` with columns part, p and q: the rows of a key in more than ``limit_rows`` prefixes are dealt to parts,
    and a row goes to each pair (p <= q) of its part with another one.  All other keys are the one pair (0, 0)."""
    one = F.lit(0)
    load = keys.groupBy("block", "key").agg(F.count("*").alias("load")).where(F.col("load") > limit_rows)
    heavy = cut_lineage(load.withColumn("parts", F.ceil(F.col("load") / limit_rows).cast("int")), "sim-heavy")
    if heavy.isEmpty():
        return keys.select("*", one.alias("part"), one.alias("p"), one.alias("q"))
    dealt = lookup_join(keys, heavy, ["block", "key"], count_col="load", how="left", hot_rows=limit_rows)
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set_id"), parts).cast("int")) \
        .withColumn("other", F.explode(F.sequence(one, parts - 1)))
    return dealt.select("*", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).drop("parts", "other")


def _candidates(keys: DataFrame, on: list[str], cols: list[str], threshold: float, min_shared: int) -> DataFrame:
    """Pairs (columns a_ and b_) of sets under one key whose sizes, positions and signatures admit the threshold."""
    a = keys.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = keys.select(*on, *[F.col(c).alias(f"b_{c}") for c in cols])
    na, nb = F.col("a_n"), F.col("b_n")
    need = F.greatest(F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9), F.lit(max(min_shared, 1)))
    room = F.least(na - F.col("a_pos"), nb - F.col("b_pos"))
    joined = a.join(b, on).where(
        (F.col("a_set_id") < F.col("b_set_id"))
        & (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & (room >= need))
    apart_bits = sum((F.bit_count(F.col("a_sig")[f"s{i}"].bitwiseXOR(F.col("b_sig")[f"s{i}"])) for i in range(SIG_WORDS)), F.lit(0))
    return joined.where(na + nb - apart_bits >= 2 * need)


def _linked(keys: DataFrame, ordered: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs under the keys.  Only signatures go through the join of the keys; the token arrays of the few candidates
    that these leave are looked up afterwards, once for each pair."""
    near = _candidates(keys.select("block", "key", "set_id", "n", "pos", "sig"), ["block", "key"], ["set_id", "n", "pos", "sig"], threshold, 1)
    near = near.select(F.col("a_set_id").alias("set_a"), F.col("b_set_id").alias("set_b")).distinct()
    for side in ("a", "b"):
        near = near.join(ordered.select(F.col("set_id").alias(f"set_{side}"), F.col("toks").alias(f"{side}_toks")), f"set_{side}")
    total = F.size("a_toks") + F.size("b_toks")
    similar = F.exists(F.array(F.size(F.array_intersect("a_toks", "b_toks"))), lambda shared: shared / (total - shared) >= threshold)
    return near.where(similar).select("set_a", "set_b")


def _pair_up(keys: DataFrame, threshold: float, min_shared: int, depth: int = 1, limit_rows: int | None = None) -> DataFrame:
    cols = ["set_id", "n", "toks", "sig", "pos"]
    on = ["block", "key"]
    apart = F.lit(True)
    if limit_rows is not None:
        keys = _in_blocks(keys, limit_rows)
        cols, on = [*cols, "part"], [*on, "p", "q"]
        apart = (F.col("a_part") != F.col("b_part")) | (F.col("p") == F.col("q"))
    joined = _candidates(keys, on, cols, threshold, min_shared).where(apart)
    na, nb = F.col("a_n"), F.col("b_n")
    common = F.array_intersect("a_toks", "b_toks")

    def similar(c: Column) -> Column:
        n = F.size(c)
        return (n >= max(min_shared, depth)) & (n / (na + nb - n) >= threshold) & (F.array_join(F.slice(c, 1, depth), " ") == F.col("key"))

    # The tokens of a candidate are intersected once: as an argument, since a column that is used several times is worked out each time.
    shared = F.size(common)
    sim = shared / (na + nb - shared)
    return (joined.where(F.exists(F.array(common), similar))
            .select(F.col("a_set_id").alias("set_a"), F.col("b_set_id").alias("set_b"),
                    shared.alias("shared"), sim.alias("similarity")))


def _forest(threshold: float):
    """Links of a spanning forest over the sets of one key: a search from set to similar set, each set reached once.

    A set that no waiting set can be similar to by their signatures is left at once; the tokens of a cell in which all are
    so are not even read.
    """
    def run(cell: pa.Table) -> pa.Table:
        ids = cell["set_id"]
        size = np.asarray(cell["n"]).astype(np.int64)
        bits = np.stack([np.asarray(w).view(np.uint64) for w in cell["sig"].combine_chunks().flatten()])
        near_enough = 2 * threshold / (1 + threshold)
        waiting = np.ones(len(size), dtype=bool)
        held = None
        found_a, found_b = [], []
        for root in range(len(size)):
            if not waiting[root]:
                continue
            waiting[root] = False
            front = [root]
            while front and waiting.any():
                s = front.pop()
                both = size + size[s]
                apart = np.bitwise_count(bits ^ bits[:, s:s + 1]).sum(axis=0, dtype=np.int64)
                if not (waiting & (both - apart >= both * near_enough - 1e-6)).any():
                    continue
                if held is None:
                    toks = cell["toks"].combine_chunks()
                    codes = np.asarray(toks.flatten().dictionary_encode().indices).astype(np.int64)
                    rows = np.repeat(np.arange(len(size)), size)
                    held = rows[np.argsort(codes, kind="stable")]          # the sets of each token, token after token
                    first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
                    own = np.concatenate([[0], np.cumsum(size)])
                near = np.concatenate([held[first[c]:first[c + 1]] for c in codes[own[s]:own[s + 1]].tolist()])
                shared = np.bincount(near[waiting[near]], minlength=len(size))
                at = np.flatnonzero(shared)
                at = at[shared[at] / (size[s] + size[at] - shared[at]) >= threshold]
                waiting[at] = False
                front += at.tolist()
                found_a += [s] * len(at)
                found_b += at.tolist()
        return pa.table({"set_a": ids.take(pa.array(found_a, pa.int64())), "set_b": ids.take(pa.array(found_b, pa.int64()))})
    return run


def spanning_links(sets: DataFrame, block: list[str], *, threshold: float, hot_rows: int = HOT_ROWS, pair_rows: int = PAIR_ROWS,
                   light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Similar pairs (set_a, set_b) that connect what all pairs with Jaccard >= threshold connect.

    As in ``similar_sets`` every similar pair meets under a token of both prefixes.  Under a token of few sets the
    pairs are joined.  Under any other token, dealt to pairs of blocks of ``pair_rows`` sets, a spanning forest is found instead, so
    the links are at most linear in the sets: a family of near titles gives a star, not its square.
    """
    ordered = _ordered(sets, block, 1, hot_rows)
    keys = ordered.select("*", F.posexplode(F.slice("toks", F.lit(1), _prefix_length(F.col("n"), threshold, 1, 1))).alias("pos", "key"))
    load = keys.groupBy("block", "key").agg(F.count("*").alias("load"))
    many = cut_lineage(load.where(F.col("load") > light_rows).withColumn("many", F.lit(True)), "span-many")
    if many.isEmpty():
        return _linked(keys, ordered, threshold)
    marked = lookup_join(keys, many, ["block", "key"], count_col="load", how="left", hot_rows=hot_rows)
    few = _linked(marked.where(F.col("many").isNull()), ordered, threshold)
    cells = _in_blocks(marked.where("many").drop("many"), pair_rows).select("block", "key", "p", "q", F.col("set_id").cast("string").alias("set_id"), "n", "sig", "toks")
    kind = sets.schema["set_id"].dataType
    found = cells.groupBy("block", "key", "p", "q").applyInArrow(_forest(threshold), "set_a string, set_b string")
    ends = [F.col(c).cast(kind) for c in ("set_a", "set_b")]
    return few.unionByName(found.select(F.least(*ends).alias("set_a"), F.greatest(*ends).alias("set_b")).distinct())
