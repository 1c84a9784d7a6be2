"""Stored trigram posting lists, so that a substring search reads what can hold it.

Every searched field of a row is lower-cased and cut into its three-character pieces; a piece's posting list says which rows
have it.  A search intersects the lists of its own pieces and then verifies the few rows left on the fields themselves, so
it finds exactly what ``contains`` finds.  Lists are stored in order of their piece, in chunks of ``CHUNK`` row numbers, and
rows in slabs of as many; a search opens the chunks of its pieces and the slabs of its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import cut_lineage
from strandline.sources.sinks import append_new, read_table

CHUNK = 65_536            # row numbers of one chunk of a list, and of one slab of rows
SHARDS = 64               # folders that pieces are dealt to


def _field_list(fields: list[str], lists: list[str]) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.array(*[F.lower(F.col(c)) for c in fields])] + [F.transform(F.coalesce(F.col(c), none), F.lower) for c in lists]
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def pieces(text: Column) -> Column:
    """The distinct three-character pieces of a text; none if it is shorter."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, 3)))).otherwise(F.array().cast("array<string>"))


def _shard(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(SHARDS)).cast("int")


def add(df: DataFrame, path: str, *, key: str = "position", fields: tuple[str, ...] = ("title", "publisher"), lists: tuple[str, ...] = ("tags",)) -> None:
    """Index the rows of ``df`` whose ``key`` (a long, never null) is not indexed yet.

    Lists are written before rows: a writer that stops between leaves numbers in lists that no row answers to, which a
    search drops, and the batch may come again.
    """
    rows = cut_lineage(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), _field_list(list(fields), list(lists)).alias("fields")), "trigram-rows")
    stored = read_table(df.sparkSession, f"{path}/rows")
    new = rows if stored is None else rows.join(stored.select("key"), "key", "left_anti")
    each = new.select("key", F.explode(F.array_distinct(F.flatten(F.transform("fields", pieces)))).alias("piece"))
    lists_ = each.groupBy("piece", F.floor(F.col("key") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_set("key")).alias("keys"))  # at most CHUNK keys
    lists_.withColumn("shard", _shard(F.col("piece"))).repartition("shard").sortWithinPartitions("shard", "piece", "chunk") \
        .write.mode("append").partitionBy("shard").parquet(f"{path}/lists")
    append_new(rows.withColumn("slab", F.floor(F.col("key") / CHUNK)), f"{path}/rows", ["key"], [F.col("fields")], ["slab"])


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(key) of the rows with a field that contains ``text``, trimmed and in any case; blank text finds every row."""
    stored = read_table(spark, f"{path}/rows")
    if stored is None:
        return spark.createDataFrame([], "key long")
    wanted = text.strip().lower()
    hit = F.exists("fields", lambda f: F.contains(f, F.lit(wanted)))
    if not wanted:
        return stored.select("key")
    own = sorted({wanted[i:i + 3] for i in range(len(wanted) - 2)})
    if not own:                                                     # one or two characters are no piece: all rows are read
        return stored.where(hit).select("key")
    shards = [r[0] for r in spark.createDataFrame([(p,) for p in own], "piece string").select(_shard(F.col("piece"))).distinct().collect()]
    lists = read_table(spark, f"{path}/lists").where(F.col("shard").isin(shards) & F.col("piece").isin(own))
    # Chunks in which a piece is missing drop out before any list is opened up.
    full = lists.groupBy("chunk").agg(F.countDistinct("piece").alias("n")).where(F.col("n") == len(own)).select("chunk")
    near = lists.join(full, "chunk", "left_semi").select("piece", F.explode("keys").alias("key")).distinct()
    near = cut_lineage(near.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("key"), "trigram-near")
    slabs = [r[0] for r in near.select(F.floor(F.col("key") / CHUNK)).distinct().collect()]  # one number for each CHUNK rows
    return stored.where(F.col("slab").isin(slabs)).join(near, "key", "left_semi").where(hit).select("key")
