"""A prefix trie of conversations by fixed-length block hashing.

Conversations are cut into blocks of ``BLOCK_TURNS`` turns.  The digest of a prefix is the exclusive or of a 128-bit hash
of every (position, turn) in it, so digests of blocks, and of runs of blocks, combine in any order and a long
conversation needs no single task.  Conversations are grouped by successive block digests first: one row stands for all
that run through the same blocks.  Where the block after a prefix has no sibling, its turns are nodes as they stand.
Only where siblings diverge are turn boundaries refined, and there over the distinct blocks, not over conversations.

Sums over subtrees need no walk down the tree.  Every node is owned by its smallest member, a conversation owns the end
of its own path from some depth on, and so a sum over the nodes of a subtree is a sum over members: of what each has
below the node, less what it owns there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage
from strandline.operators.skew import lookup_join

BLOCK_TURNS = 4
SPAN = 1024               # turn numbers, and blocks, of a conversation that one window takes
ID_SPAN = 4096            # conversation ids of one chunk of a list of ids
HOT_CHILDREN = 128        # a node with more children is looked up by broadcast (at most 200,000 nodes are)
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]
CHILD = ["block", "pa", "pb", "da", "db", "n"]


def numbered_turns(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, ta, tb, words): each conversation's turns from 1 on, by turn (null first), hashed and measured.

    A null role or text is empty.  Turns of equal number stand in the order of their hash, repeated rows are turns
    like any other, rows with a null key belong to no conversation.  Ranks are counted inside spans of ``SPAN``
    turn numbers and the spans' sizes added up, so a conversation of any length is dealt to many tasks.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    turn_ = F.col(turn).cast("long")
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), turn_.alias("turn"), F.coalesce(F.floor(turn_ / SPAN), F.lit(-(1 << 62))).alias("span"),
        F.xxhash64(F.lit(1), whole).alias("ta"), F.xxhash64(F.lit(2), whole).alias("tb"), F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "span").orderBy(F.asc_nulls_first("turn"), "ta", "tb")))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carry = rows.groupBy("conv", "span").agg(F.count("*").alias("n")).select("conv", "span", before.alias("carry")).where("carry > 0")
    return ranked.join(carry, ["conv", "span"], "left").select(
        "conv", (F.col("rank") + F.coalesce("carry", F.lit(0))).cast("long").alias("pos"), "ta", "tb", "words")


def spliced(turns: DataFrame, *, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose start is taken from another: (turns, conversations).

    Conversation c gets the first h turns of conversation c - c % group, h being crc32 of c's decimals modulo ``most``, then
    its own turns after its first h.  ``turns`` should be materialised; it is read several times.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    held = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(held, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut_lineage(convs.select("conv", "n", "h", "base", "m"), "trie-splices")
    start = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    taken = convs.where("m > 0").select("conv", "base", "m").join(start, "base").where("pos <= m")
    own = lookup_join(turns, convs.select("conv", "h", "m", "n"), ["conv"], count_col="n").where("pos > h")
    cols = ["conv", "pos", "ta", "tb", "words"]
    return own.withColumn("pos", F.col("pos") - F.col("h") + F.col("m")).select(*cols).unionByName(taken.select(*cols)), convs.select("conv")


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """(conv, block, n, pa, pb, da, db, w, cum, turns): every block of every conversation.

    p and d are the digests of the prefixes that end before and with the block, w its words, cum the words before it.
    """
    salted = [F.xxhash64(F.lit(seed), "pos", "ta", "tb").alias(c) for seed, c in ((1, "a"), (2, "b"))]
    each = turns.select("conv", F.floor((F.col("pos") - 1) / size).alias("block"), "pos", *salted, "words")
    own = each.groupBy("conv", "block").agg(
        F.count("*").alias("n"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("words").alias("w"),
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("turns"))  # at most ``size`` of them
    own = own.withColumn("span", F.floor(F.col("block") / SPAN))
    sums = [("xa", F.bit_xor), ("xb", F.bit_xor), ("w", F.sum)]
    within = Window.partitionBy("conv", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # Runs of SPAN blocks are summed before they are joined, so most conversations have no row here.
    long = turns.where(F.col("pos") > size * SPAN).select("conv").distinct()
    parts = each.withColumn("span", F.floor(F.col("block") / SPAN)).join(long, "conv", "left_semi") \
        .groupBy("conv", "span").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("words").alias("w"))
    carry = parts.select("conv", "span", *[f(c).over(across).alias(f"carry_{c}") for c, f in sums]).where("span > 0")
    run = own.select("*", *[f(c).over(within).alias(f"run_{c}") for c, f in sums]).join(carry, ["conv", "span"], "left")
    zero = F.lit(0).cast("long")

    def before(c: str) -> Column:
        one, two = F.coalesce(f"run_{c}", zero), F.coalesce(f"carry_{c}", zero)
        return one + two if c == "w" else one.bitwiseXOR(two)
    pa_, pb_ = before("xa"), before("xb")
    return run.select("conv", "block", "n", pa_.alias("pa"), pb_.alias("pb"), pa_.bitwiseXOR(F.col("xa")).alias("da"),
                      pb_.bitwiseXOR(F.col("xb")).alias("db"), "w", before("w").alias("cum"), "turns")


def _per_turn(value) -> Column:
    """An array with ``value(turns up to and with this one, turns from this one on, this one)`` for every turn of a block."""
    return F.transform("turns", lambda t, i: value(F.slice("turns", F.lit(1), i + 1), F.slice("turns", i + 1, F.size("turns")), t))


def _xor(start: str, turns: Column, field: str) -> Column:
    return F.aggregate(turns, F.col(start), lambda x, t: x.bitwiseXOR(t[field]))


def _sum(turns: Column, value) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda x, t: x + value(t))


def _nodes(groups: DataFrame, values: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """A row for each node below the root: depth, a, b, ``values`` (equal in all groups of the node) and the sums over groups.

    ``groups`` have ``single``; nodes in a block without siblings come straight from it.  ``sums`` end in _min for a minimum.
    """
    fields = {"depth": lambda up, on, t: t["pos"], "a": lambda up, on, t: _xor("pa", up, "a"), "b": lambda up, on, t: _xor("pb", up, "b"), **values, **sums}
    each = groups.select("single", F.inline(_per_turn(lambda up, on, t: F.struct(*[f(up, on, t).alias(c) for c, f in fields.items()]))))
    aggregates = [F.first(c).alias(c) for c in values] + [(F.min(c) if c.endswith("_min") else F.sum(c)).alias(c) for c in sums]
    refined = each.where(~F.col("single")).drop("single").groupBy(*NODE).agg(*aggregates)
    return each.where("single").drop("single").unionByName(refined)


def _id_list_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks of ids, joined by commas as they pass; only the hash's state is held."""
    held, last, digest = [], None, None
    for b in batches:
        for *node, ids in zip(*[b[c].to_pylist() for c in (*NODE, "ids")], strict=True):
            if node != last:
                if digest is not None:
                    held.append((*last, digest.hexdigest()))
                last, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(held) >= 8192:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), h, strict=True)) for h in held])
            held = []
    if digest is not None:
        held.append((*last, digest.hexdigest()))
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), h, strict=True)) for h in held])


def _ends(blocks: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """(depth, a, b, ends_sha256) of every node that a conversation ends in."""
    last = lengths.where("len > 0").select("conv", "len", F.floor((F.col("len") - 1) / size).alias("block"))
    ended = last.join(blocks.select("conv", "block", "da", "db"), ["conv", "block"]).select("conv", F.col("len").alias("depth"), F.col("da").alias("a"), F.col("db").alias("b"))
    zero = F.lit(0).cast("long")
    ended = ended.unionByName(lengths.where("len = 0").select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ended.groupBy(*NODE, F.floor(F.col("conv") / ID_SPAN).alias("chunk")).agg(ids.alias("ids"))  # at most ID_SPAN ids each
    packed = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return packed.mapInArrow(_id_list_digest, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, *, size: int = BLOCK_TURNS) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one (the root, depth 0) included.

    ``turns``: conv, pos (from 1, without gaps), ta, tb (a hash of the turn), words.  ``conversations``: conv, each once;
    those without turns are members of the root alone.  Returns conv_id (the smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree,
    (n_convs - 1) times the words of each node's last turn) and ends_sha256 (of the ascending ids of the members
    that end there, comma-joined).  Without conversations there is no root and no row.
    """
    zero = F.lit(0).cast("long")
    blocks = cut_lineage(_blocks(turns, size), "trie-blocks")
    lengths = cut_lineage(conversations.join(turns.groupBy("conv").agg(F.max("pos").alias("len")), "conv", "left")
                          .select("conv", F.coalesce("len", zero).alias("len")), "trie-lengths")
    root_id = lengths.agg(F.min("conv")).first()[0]
    groups = cut_lineage(blocks.groupBy(*CHILD).agg(F.count("*").alias("members"), F.min("conv").alias("least"), F.first("turns").alias("turns")), "trie-groups")
    alone = groups.groupBy("block", "pa", "pb").agg(F.count("*").alias("siblings"), *[F.min(c).alias(c) for c in ("da", "db", "n")]) \
        .where("siblings = 1").select(*CHILD, F.lit(True).alias("single"))
    groups = cut_lineage(groups.join(alone, CHILD, "left").withColumn("single", F.coalesce("single", F.lit(False))), "trie-groups")

    # Which nodes there are, and who owns them.
    nodes = _nodes(groups, {"parent_a": lambda up, on, t: _xor("pa", up, "a").bitwiseXOR(t["a"]), "parent_b": lambda up, on, t: _xor("pb", up, "b").bitwiseXOR(t["b"])},
                   {"members": lambda up, on, t: F.col("members"), "conv_min": lambda up, on, t: F.col("least")})
    nodes = cut_lineage(nodes, "trie-nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")
    owners = nodes.groupBy(F.col("conv_min").alias("conv")).agg(F.min("depth").alias("since"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))

    # What each conversation shares (has, but does not own): the words before ``since``.
    since = owners.withColumn("block", F.floor((F.col("since") - 1) / size))
    shared = since.join(blocks.select("conv", "block", "cum", "turns"), ["conv", "block"]).select(
        "conv", "since", "leaf", (F.col("cum") + _sum(F.filter("turns", lambda t: t["pos"] < F.col("since")), lambda t: t["words"])).alias("shared"))
    every = F.lit((1 << 63) - 1)
    per_conv = blocks.groupBy("conv").agg(F.max(F.col("cum") + F.col("w")).alias("all"), F.count("*").alias("_n")).join(shared, "conv", "left").select(
        "conv", "_n", F.coalesce("since", every).alias("since"), F.coalesce("leaf", zero).alias("leaf"), F.coalesce("shared", "all").alias("shared"))
    placed = lookup_join(blocks.select("conv", *CHILD, (F.col("cum") + F.col("w")).alias("upto")), cut_lineage(per_conv, "trie-owners"), ["conv"], count_col="_n")
    below = placed.groupBy(*CHILD).agg(F.sum("leaf").alias("leaves"), F.sum(F.greatest(zero, F.col("shared") - F.col("upto"))).alias("tail"),
                                       F.min(F.struct("conv", "since")).alias("owner"))
    summed = groups.join(below, CHILD)
    sums = _nodes(summed, {}, {
        "n_leaves": lambda up, on, t: F.col("leaves"),
        "saved_tokens": lambda up, on, t: F.col("tail") + F.col("members") * _sum(on, lambda x: x["words"])
        - _sum(F.filter(on, lambda x: x["pos"] >= F.col("owner.since")), lambda x: x["words"])})
    sums = cut_lineage(sums, "trie-sums")

    # A node's parent has another owner only where the conversation's own path begins.
    heads = nodes.join(owners.select(F.col("conv").alias("conv_min"), F.col("since").alias("depth")), ["conv_min", "depth"], "left_semi").where("depth > 1") \
        .select("conv_min", (F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b"))
    up = nodes.select(*NODE, F.col("conv_min").alias("parent"), "n_children")
    joined = lookup_join(heads, up, NODE, count_col="n_children", hot_rows=HOT_CHILDREN).select("conv_min", (F.col("depth") + 1).alias("depth"), "parent")
    parent = F.when(F.col("depth") == 1, F.lit(root_id)).otherwise(F.coalesce("parent", "conv_min"))
    inner = nodes.join(joined, ["conv_min", "depth"], "left").join(sums, NODE).select(
        *NODE, F.col("conv_min").alias("conv_id"), parent.cast("long").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")

    # The root sums up the nodes of depth 1 and has all conversations.
    firsts = nodes.where("depth = 1").join(sums, NODE)
    tops = [lengths.agg(F.count("*").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens")),
            firsts.agg(zero.alias("n_convs"), F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), zero).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))]
    root = reduce(DataFrame.unionByName, tops).agg(*[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(root_id).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
                       "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")
    out = inner.unionByName(root).join(_ends(blocks, lengths, size), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
