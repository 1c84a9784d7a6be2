"""A stored index of a table's keys, so that a batch reads only what may hold its keys.

Keys are hashed to 128 bits and filed in buckets named by the first bits of the hash.  A bucket has its hashes and a bitmap
with one bit for the last bits of each.  A batch looks its keys up in three steps: the directory (a row for each bucket)
says which bucket a key belongs to; the bitmaps of just those buckets say which keys are certainly new; the hashes of just
the buckets that some key may be in decide the rest.  Buckets that outgrow ``split_rows`` are split by further bits, and
those written in many batches are written anew as one.

The index is derived data.  It records which files of the table it covers and takes in the others when it is used, so a
writer that stops between the table and the index costs a later reading of those files, nothing else.  Every change is
a new version of the directory, complete or not there at all; files that no directory names are deleted by the next change.
One writer at a time, as for the table itself.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import cut_lineage, drop_path, path_exists, subfolders

SPLIT_ROWS = 1_000_000    # keys of a bucket before it is split
MAX_PARTS = 16            # batches that a bucket's files may stem from
MAP_BITS = 25             # bits of a bucket's bitmap: 2**25, 32 for each key of a full bucket, kept in pieces of 4 KB
PIECE_BITS = 15

DIRECTORY = "bucket string, depth int, n long, parts array<string>"
FILES = "file string"
HASH = ["a", "b"]


def key_hash(keys: list[str]) -> list[Column]:
    """128 bits of a row's keys as two longs; null keys are equal to each other and to nothing else."""
    whole = F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    return [F.xxhash64(F.lit(1), whole).alias("a"), F.xxhash64(F.lit(2), whole).alias("b")]


def _bucket(depth: Column | int) -> Column:
    """Name of the bucket of ``depth`` leading bits."""
    bits = F.lpad(F.bin("a"), 64, "0")
    return F.concat(F.lit("b"), F.substring(bits, F.lit(1), F.lit(depth) if isinstance(depth, int) else depth))


def _piece() -> Column:
    """Which 4 KB of its bucket's bitmap a key's bit is in."""
    return F.shiftright(F.col("b").bitwiseAND(F.lit((1 << MAP_BITS) - 1)), PIECE_BITS).cast("int")


def _bit() -> Column:
    return F.col("b").bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).cast("int")


class KeyIndex:
    """The index at ``root`` of the table at ``table`` by ``keys``.  ``files_read`` holds what the last look-up opened."""

    def __init__(self, spark: SparkSession, root: str, table: str, keys: list[str], *, split_rows: int = SPLIT_ROWS, max_parts: int = MAX_PARTS):
        self.spark, self.root, self.table, self.keys = spark, root.rstrip("/"), table, keys
        self.split_rows, self.max_parts = split_rows, max_parts
        self.files_read: dict[str, int] = {}

    # ---- versions ----

    def _version(self) -> str | None:
        done = subfolders(self.spark, f"{self.root}/versions")
        return done[-1] if done else None

    def _of_version(self, what: str, schema: str) -> DataFrame:
        version = self._version()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}/{what}")

    def directory(self) -> DataFrame:
        """bucket, depth, n (keys) and parts (folders that hold them), a row for each bucket."""
        return self._of_version("directory", DIRECTORY)

    def _publish(self, directory: DataFrame, files: DataFrame) -> None:
        """A new version: written aside, then renamed, so that it is there as a whole; then what it does not name is deleted."""
        old = self._version()
        number = 1 if old is None else int(old[1:]) + 1
        aside, final = f"{self.root}/aside-{uuid.uuid4().hex}", f"{self.root}/versions/v{number:010d}"
        directory.write.parquet(f"{aside}/directory")
        files.write.parquet(f"{aside}/files")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(final).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path(f"{self.root}/versions"))
        if not store.rename(path(aside), path(final)):
            raise RuntimeError(f"another writer published {final}")
        live = {r[0] for r in self.directory().select(F.explode("parts")).distinct().collect()}  # at most max_parts a bucket, shared by many buckets
        for name in subfolders(self.spark, f"{self.root}/parts"):
            if name not in live:
                drop_path(self.spark, f"{self.root}/parts/{name}")
        for name in subfolders(self.spark, f"{self.root}/versions")[:-1]:
            drop_path(self.spark, f"{self.root}/versions/{name}")
        for name in subfolders(self.spark, self.root):
            if name.startswith("aside-"):
                drop_path(self.spark, f"{self.root}/{name}")

    # ---- reading ----

    def _located(self, hashes: DataFrame, directory: DataFrame) -> DataFrame:
        """``hashes`` with their bucket: a key has one name for each depth in use, and one of them is a bucket's."""
        depths = [r[0] for r in directory.select("depth").distinct().orderBy("depth").collect()]  # at most 64
        if not depths:
            return hashes.withColumn("bucket", F.lit("b"))
        named = hashes.withColumn("bucket", F.explode(F.array(*[_bucket(d) for d in depths])))
        return named.join(directory.select("bucket"), "bucket")

    def _open(self, what: str, directory: DataFrame, schema: str) -> DataFrame:
        """The hashes or bitmaps of the directory's rows; only their folders are opened."""
        rows = directory.select("bucket", F.explode("parts").alias("part")).collect()  # names of buckets that the batch touches
        paths = [f"{self.root}/parts/{r['part']}/{what}/bucket={r['bucket']}" for r in rows]
        self.files_read[what] = len(paths)
        if not paths:
            return self.spark.createDataFrame([], schema + ", bucket string")
        # The buckets' names come from the files' own column, since folders of several parts share no base.
        return self.spark.read.schema(schema + ", name string").parquet(*paths).withColumnRenamed("name", "bucket")

    def stored(self, batch: DataFrame) -> DataFrame:
        """(a, b) of the batch's keys that the table has.  ``batch`` has the key columns."""
        self.files_read = {"maps": 0, "hashes": 0}
        directory = self.directory()
        asked = cut_lineage(self._located(batch.select(*key_hash(self.keys)).distinct(), directory), "keys-asked")
        near = directory.join(asked.select("bucket").distinct(), "bucket", "left_semi")
        maps = self._open("maps", near, "piece int, map binary")
        byte = F.conv(F.hex(F.substring("map", F.shiftright(_bit(), 3) + 1, F.lit(1))), 16, 10).cast("long")
        is_set = F.getbit(byte, _bit().bitwiseAND(F.lit(7))) == 1
        maybe = asked.withColumn("piece", _piece()).join(maps, ["bucket", "piece"]).where(is_set).select("bucket", *HASH).distinct()
        maybe = cut_lineage(maybe, "keys-maybe")
        hit = directory.join(maybe.select("bucket").distinct(), "bucket", "left_semi")
        return maybe.join(self._open("hashes", hit, "a long, b long").select(*HASH), HASH, "left_semi").select(*HASH)

    # ---- writing ----

    def _write(self, hashes: DataFrame) -> tuple[str, DataFrame]:
        """Hashes with their buckets as a new part: (its name, keys for each bucket)."""
        name = uuid.uuid4().hex
        rows = cut_lineage(hashes.select("bucket", *HASH), "keys-part")
        place = F.struct(_piece().alias("piece"), (_bit() + 1).alias("bit"))
        maps = rows.select("bucket", place.alias("p")).groupBy("bucket", F.col("p.piece").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p.bit")).alias("map"))
        for what, df in (("hashes", rows), ("maps", maps)):
            df.withColumn("name", F.col("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/parts/{name}/{what}")
        return name, rows.groupBy("bucket").agg(F.count("*").alias("added"))

    def catch_up(self) -> int:
        """Take in the table's files that the index does not cover; returns how many there were."""
        if not path_exists(self.spark, self.table):
            return 0
        files = [unquote(f) for f in self.spark.read.parquet(self.table).inputFiles()]  # Spark names them as URLs
        covered = {r[0] for r in self._of_version("files", FILES).collect()}  # names of the table's files
        missing = sorted(set(files) - covered)
        if not missing:
            return 0
        directory = cut_lineage(self.directory(), "keys-directory")
        new = self.spark.read.option("basePath", self.table).parquet(*missing).select(*key_hash(self.keys)).distinct()
        name, added = self._write(self._located(new, directory))
        grown = directory.join(added, "bucket", "full").select(
            "bucket", F.coalesce("depth", F.lit(0)).alias("depth"), (F.coalesce("n", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("n"),
            F.when(F.col("added").isNull(), F.col("parts")).otherwise(F.concat(F.coalesce("parts", F.array().cast("array<string>")), F.array(F.lit(name)))).alias("parts"))
        directory = cut_lineage(grown, "keys-directory")
        full = (F.col("n") > self.split_rows) | (F.size("parts") > self.max_parts)
        if not directory.where(full).isEmpty():
            more = F.ceil(F.log2(F.greatest(F.col("n") / self.split_rows, F.lit(1.0)))).cast("int")
            due = cut_lineage(directory.where(full).select("bucket", (F.col("depth") + more).alias("to"), "parts"), "keys-due")
            rows = self._open("hashes", due, "a long, b long").join(due.select("bucket", "to"), "bucket")
            name, added = self._write(rows.select(_bucket(F.col("to")).alias("bucket"), *HASH).distinct())
            made = added.select("bucket", (F.length("bucket") - 1).alias("depth"), F.col("added").alias("n"), F.array(F.lit(name)).alias("parts"))
            directory = cut_lineage(directory.where(~full).unionByName(made), "keys-directory")
            # A split may leave a half without keys; its name must be there for keys to come.
            directory = self._with_empty_halves(directory, due)
        self._publish(directory, self.spark.createDataFrame([(f,) for f in sorted(files)], FILES))
        return len(missing)

    def _with_empty_halves(self, directory: DataFrame, due: DataFrame) -> DataFrame:
        grow = F.col("to") - (F.length("bucket") - 1)
        ends = F.transform(F.sequence(F.lit(0), (F.pow(F.lit(2), grow) - 1).cast("int")), lambda i: F.when(grow == 0, F.lit("")).otherwise(F.lpad(F.bin(i), grow, "0")))
        names = due.select(F.explode(F.transform(ends, lambda e: F.concat("bucket", e))).alias("bucket"), F.col("to").alias("depth"))
        empty = names.join(directory.select("bucket"), "bucket", "left_anti").select(
            "bucket", "depth", F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("parts"))
        return directory.unionByName(empty)
