"""Minimum-cost-flow resharding.

Old shards (a folder of files by shard and file number) get new capacities.  A minimum-cost flow from old
shards to new ones, where staying is free, says how many bytes to transfer from which shard to which, so the
fewest bytes move.  A transfer is filled with whole files and then with blocks of as many more files as it takes
(a block holds a few rows); only files that lose blocks are rewritten, all others stay as they lie.

The solver sees at most (shards x FILES x BLOCKS) block sizes, whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import scratch_path

SHARDS = 16
FILES = 16                # files of a shard
BLOCKS = 128              # blocks of a file
PART = "shard int, file int"


# ---- the flow ---------------------------------------------------------------------------------------

def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] >= 0 with row sums ``supply`` and column sums at most ``capacity`` at the least total cost.

    Successive shortest paths, each found by relaxing edges until nothing changes (a path back over a flow has a
    negative cost); there are only as many nodes as shards."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards have less room than the old ones hold")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        dist: dict[tuple[int, int], int] = {(0, i): 0 for i in range(n) if left[i]}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        changed = True
        while changed:
            changed = False
            for (side, k), d in list(dist.items()):
                steps = ([((1, j), cost[k][j]) for j in range(m)] if side == 0
                         else [((0, i), -cost[i][k]) for i in range(n) if flow[i][k]])
                for to, c in steps:
                    if d + c < dist.get(to, 1 << 62):
                        dist[to], came[to], changed = d + c, (side, k), True
        end = min((d, node) for node, d in dist.items() if node[0] == 1 and room[node[1]])[1]
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0][1]], room[end[1]], *(flow[b[1]][a[1]] for a, b in steps if a[0] == 1)])
        for a, b in steps:
            if a[0] == 0:
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def choose_blocks(sizes: dict[tuple[int, int, int], int], flow: list[list[int]], capacity: list[int]) -> dict[tuple[int, int, int], int]:
    """The new shard of every block (old shard, file, block) that moves.

    Each transfer takes the largest whole file that still fits, again and again, then the largest blocks that
    fit, first of files that have lost some already, then of the smallest whole ones, until less than a block is
    left.  What rounding leaves over is evened out by moving single blocks from the fullest shard that has one
    small enough to the emptiest shard, until no such move brings the two closer."""
    files: dict[tuple[int, int], int] = defaultdict(int)
    by_file: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
        files[b[:2]] += sizes[b]
        by_file[b[:2]].append(b)
    moves: dict[tuple[int, int, int], int] = {}
    for i, row in enumerate(flow):
        whole = sorted((f for f in files if f[0] == i), key=lambda f: (-files[f], f))
        drained: list[tuple[int, int]] = []
        for j, amount in enumerate(row):
            if i == j or amount <= 0:
                continue
            for f in list(whole):
                if files[f] <= amount:
                    amount -= files[f]
                    moves |= {b: j for b in by_file[f]}
                    whole.remove(f)
            for f in drained + whole[::-1]:
                stay = []
                # A whole file is only broken up for a block of the usual size; less is left to the evening below.
                if f in drained or amount * len(by_file[f]) >= files[f]:
                    for b in by_file[f]:
                        if sizes[b] <= amount:
                            amount -= sizes[b]
                            files[f] -= sizes[b]
                            moves[b] = j
                        else:
                            stay.append(b)
                    if len(stay) < len(by_file[f]) and f in whole:
                        whole.remove(f)
                        drained.append(f)
                    by_file[f] = stay
    held: list[list[tuple[int, tuple[int, int, int]]]] = [[] for _ in capacity]
    load = [0] * len(capacity)
    for b, s in sizes.items():
        at = moves.get(b, b[0])
        held[at].append((s, b))
        load[at] += s
    for blocks in held:
        blocks.sort()
    # Every move lowers the sum of the squared differences, so the loop ends.
    while True:
        order = sorted(range(len(load)), key=lambda k: (capacity[k] - load[k], k))
        under = order[-1]
        for over in order[:-1]:
            gap = (load[over] - capacity[over]) - (load[under] - capacity[under])
            half = bisect_left(held[over], (gap / 2,))
            near = [(abs(gap - 2 * s), b, s) for s, b in held[over][max(half - 1, 0):half + 1] if 0 < s < gap]
            if near:
                break
        else:
            break
        _, b, s = min(near)
        held[over].remove((s, b))
        insort(held[under], (s, b))
        load[over] -= s
        load[under] += s
        if under == b[0]:
            moves.pop(b, None)
        else:
            moves[b] = under
    return moves


# ---- files ------------------------------------------------------------------------------------------

def write_shards(docs: DataFrame, path: str, home: Column, size: Column, *, shards: int = SHARDS, files: int = FILES, blocks: int = BLOCKS) -> None:
    """Write ``docs`` as shard=/file=/ folders: ``home`` (0 to shards - 1) says the shard; file and block are dealt
    by the row's place in its partition, so equal rows spread as well as others.  Adds columns _size, _block and _row."""
    place = F.monotonically_increasing_id()
    dealt = docs.select(*docs.columns, size.cast("long").alias("_size"), home.cast("int").alias("shard"), place.alias("_row"))
    code = F.pmod(F.xxhash64("_row"), F.lit(files * blocks)).cast("int")
    dealt = dealt.withColumn("file", F.pmod(code, F.lit(files))).withColumn("_block", F.floor(code / files).cast("int"))
    # Four tasks for a file, so that a hot shard of equal texts is written by many.
    dealt.repartition("shard", "file", F.col("_block") % 4).write.partitionBy("shard", "file").parquet(path)


def read_shards(spark: SparkSession, path: str, columns) -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def plan(sharded: DataFrame, capacity: list[int] | None = None, *, old_shards: int = SHARDS, new_shards: int = SHARDS,
         move_cost: list[list[int]] | None = None) -> dict[tuple[int, int, int], int]:
    """Which blocks move where.  Only sums per block (a bounded number) reach the driver."""
    rows = sharded.groupBy("shard", "file", "_block").agg(F.sum("_size").alias("size")).collect()
    sizes = {(r["shard"], r["file"], r["_block"]): r["size"] for r in rows}
    supply = [0] * old_shards
    for (s, _, _), size in sizes.items():
        supply[s] += size
    capacity = capacity or even_capacities(sum(supply), new_shards)
    cost = move_cost or [[int(i != j) for j in range(len(capacity))] for i in range(old_shards)]
    return choose_blocks(sizes, min_cost_flow(supply, capacity, cost), capacity)


def rewrite(spark: SparkSession, path: str, moves: dict[tuple[int, int, int], int], columns) -> DataFrame:
    """Carry out ``moves``: rewrite the files that lose blocks, leave the others where they are, and return the rows
    of the new layout (columns ``shard`` and ``old_shard``)."""
    old = read_shards(spark, path, columns)
    if not moves:
        return old.withColumn("old_shard", F.col("shard"))
    touched = sorted({m[:2] for m in moves})
    affected = spark.createDataFrame(touched, PART)
    target = spark.createDataFrame([(*b, to) for b, to in moves.items()], "shard int, file int, _block int, new_shard int")
    # Both tables are bounded by the numbers of files and blocks.
    changed = old.join(F.broadcast(affected), ["shard", "file"], "left_semi") \
        .join(F.broadcast(target), ["shard", "file", "_block"], "left") \
        .withColumn("old_shard", F.col("shard")).withColumn("shard", F.coalesce("new_shard", "shard")).drop("new_shard")
    new_path = scratch_path(spark, "reshard-new")
    changed.write.partitionBy("shard", "file").parquet(new_path)
    whole = spark.read.schema(changed.schema).parquet(new_path)
    kept = old.join(F.broadcast(affected), ["shard", "file"], "left_anti").withColumn("old_shard", F.col("shard"))
    return kept.unionByName(whole)


def with_slots(rows: DataFrame, *, files: int = FILES, blocks: int = BLOCKS) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps within each shard.  Rows are counted block by block, so no window holds
    more than one block; the offsets of the blocks (a bounded table) are summed on their own."""
    from pyspark.sql import Window
    block = ["shard", "old_shard", "file", "_block"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*block, F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_row"))
    return rows.withColumn("_inside", inside - 1).join(F.broadcast(offsets), block) \
        .withColumn("slot", (F.col("_offset") + F.col("_inside")).cast("long")).drop("_offset", "_inside")


def reshard_by_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes: ``key``, ``text``, size, shard, old_shard, slot.

    A row's size is its text's length in UTF-8 plus 1 (null: 1).  The old shards keep equal texts together (they are
    dealt by the text's hash); resharding then moves the fewest bytes, so a group of equal texts is split only where
    it would not fit.  Null keys and repeated rows are rows like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    home = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(shards))
    path = scratch_path(spark, "reshard-old")
    write_shards(body, path, home, size, shards=shards)
    columns = f"key {body.schema['key'].dataType.simpleString()}, text string, _size bigint, _row bigint, _block int, {PART}"
    moves = plan(read_shards(spark, path, columns), old_shards=shards, new_shards=shards)
    rows = rewrite(spark, path, moves, columns)
    # The text is reread for the digests only, not carried through the numbering.
    narrow = rows.select("key", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.col("_size").alias("size"), "shard", "old_shard", "file", "_block", "_row")
    return with_slots(narrow).select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "old_shard")
