"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import cut_lineage, scratch_path

__all__ = ["bit_test", "cut_lineage", "drop_path", "hash_bitmap", "hash_sample", "int64_bits", "row_key", "scratch_path", "sorted_groups", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate folder through Hadoop, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def row_key(text: str | Column, name: str = "text_key") -> Column:
    """128 bits that stand for a text beside its document id, as two longs."""
    col = F.col(text) if isinstance(text, str) else text
    body = F.coalesce(col, F.lit(""))
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b")).alias(name)


def hash_bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, one set for the low bits of each hash of ``column`` (a long).

    Its size is fixed by ``bits`` whatever the table holds: Spark builds it in buckets of 32,768 bits,
    of which there are at most 2**bits / 32,768, and only those reach the driver.  A test against it
    can say yes wrongly, never no wrongly; so it may only spare work, not decide.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = (hashes.select(place.alias("p"))
             .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")))
    out = np.zeros(max(1 << bits, 32768) // 8, dtype=np.uint8)
    for bucket, m in parts.collect():  # bounded: 2**bits / 32768 rows of 4 KB
        out[(bucket - 1) * 4096: bucket * 4096] = np.frombuffer(m, dtype=np.uint8)
    return out


def bit_test(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) may be in the bitmap."""
    place = hashes & np.uint64((1 << bits) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hash_sample(df: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those whose ``column`` hashes lowest: a sample for fitting.

    The table is counted first and a hash threshold lets about twice as many rows through, so neither a task
    nor the driver sees more than that, however many tasks there are.
    """
    span = 1 << 30
    total = max(df.count(), 1)
    bar = min(span, 2 * rows * span // total + 64 * span // total + 1)
    h = F.xxhash64(column)
    return df.where(F.pmod(h, F.lit(span)) < bar).orderBy(F.pmod(h, F.lit(span)), column).limit(rows)


def int64_bits(value: int) -> int:
    """An unsigned 64-bit number as Spark's signed long with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted input, each as one table; a run may span record batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        first = []
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k))
            first.append((col[0].as_py(), col[-1].as_py()))
            valid = ~np.asarray(col.is_null())
            values = np.asarray(col.fill_null(0))
            change[1:] |= (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
        cuts = np.flatnonzero(change).tolist()
        here = tuple(f for f, _ in first)
        if held and here != last:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for c in cuts:
            held.append(batch.slice(start, c - start))
            yield pa.Table.from_batches(held)
            held, start = [], c
        held.append(batch.slice(start))
        last = tuple(x for _, x in first)
    if held:
        yield pa.Table.from_batches(held)
