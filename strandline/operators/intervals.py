"""Joins on overlapping intervals, by bins of the intervals' own size.

An interval is filed at the level whose bins are at least as long as itself, so in at most two bins however long it is.
Two intervals meet at the higher of their levels: each looks for the other in the bins of its own level and of all higher
ones in use.  Of the bins that a pair shares only the first counts, and overlap is verified, so each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import HOT_ROWS, MAX_HOT_KEYS
from strandline.runtime import cut_lineage


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _spanned(df: DataFrame, start: str, end: str) -> DataFrame:
    """The rows as one struct with s, e (longs) and their level; rows without a start or an end, or with e < s, have no overlap."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.where("s is not null and e is not null and e >= s")
    return rows.withColumn("level", F.ceil(F.log2((F.col("e") - F.col("s") + 1).cast("double"))).cast("int"))


def overlap_join(left: DataFrame, right: DataFrame, *, left_span: tuple[str, str], right_span: tuple[str, str], closed: bool = False,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of rows (structs ``left``, ``right``) whose intervals of whole numbers overlap.

    Half-open intervals overlap where each starts before the other ends; ``closed`` ones may also touch.  A bin that
    more than ``hot_rows`` left rows look into is split, its right rows are copied to each part.
    """
    a, b = (cut_lineage(_spanned(df, *span), "intervals") for df, span in ((left, left_span), (right, right_span)))
    levels = {side: sorted(r[0] for r in df.select("level").distinct().collect()) for side, df in (("a", a), ("b", b))}  # at most 64 each

    def binned(df: DataFrame, others: list[int], strictly: bool) -> DataFrame:
        """Rows in the bins of their own level (unless ``strictly``) and of each higher level of the other side."""
        own = F.col("level")
        up = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: (x > own) if strictly else (x >= own))
        each = df.withColumn("at", F.explode(up))
        return each.withColumn("bin", F.explode(F.sequence(_bin(F.col("s"), F.col("at")), _bin(F.col("e"), F.col("at")))))

    def filed(df: DataFrame) -> DataFrame:
        return df.withColumn("at", F.col("level")).withColumn("bin", F.explode(F.sequence(_bin(F.col("s"), F.col("at")), _bin(F.col("e"), F.col("at")))))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        load = x.groupBy("at", "bin").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
        hot = cut_lineage(load.orderBy(F.desc("n"), "at", "bin").limit(MAX_HOT_KEYS).select("at", "bin", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")), "intervals-hot")
        x, y = (df.select("at", "bin", F.col("row").alias(name), F.col("s").alias(f"{name}_s"), F.col("e").alias(f"{name}_e")) for df, name in ((x, "left"), (y, "right")))
        keys = ["at", "bin"]
        if not hot.isEmpty():
            parts = F.coalesce("parts", F.lit(1))
            x = x.join(F.broadcast(hot), keys, "left").withColumn("part", F.pmod(F.xxhash64("left_s", "left_e", "left"), parts).cast("int")).drop("parts")
            y = y.join(F.broadcast(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
            keys = [*keys, "part"]
        first = F.greatest(_bin(F.col("left_s"), F.col("at")), _bin(F.col("right_s"), F.col("at")))
        ls, le, rs, re = (F.col(c) for c in ("left_s", "left_e", "right_s", "right_e"))
        touch = ((ls <= re) & (rs <= le)) if closed else ((ls < re) & (rs < le))
        return x.join(y, keys).where((F.col("bin") == first) & touch).select("left", "right")

    # Right rows of the same or a higher level are met in their own bins, right rows of a lower level in the left ones'.
    return meet(binned(a, levels["b"], False), filed(b)).unionByName(meet(filed(a), binned(b, levels["a"], True)))
