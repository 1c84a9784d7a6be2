"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut_lineage

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 200_000


def lookup_join(rows: DataFrame, per_key: DataFrame, on: list[str], *, count_col: str,
                how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` with ``per_key``, which has one row per key and the key's row count.

    The ``MAX_HOT_KEYS`` keys with the most rows above ``hot_rows`` are looked up by broadcast,
    so their rows never move; all other keys go through an ordinary shuffle join.  A key outside
    that bounded table has at most total / MAX_HOT_KEYS rows, whatever the number of hot keys.
    As in any equi-join a null key matches nothing: an inner join drops such rows, a left join
    keeps them with null results.  ``rows`` and ``per_key`` are read more than once; pass
    materialised ones where they are dear.
    """
    hot = (per_key.where(F.col(count_col) > hot_rows).orderBy(F.desc(count_col), *on).limit(MAX_HOT_KEYS)
           .select(*per_key.columns))
    if hot.isEmpty():
        return rows.join(per_key.drop(count_col), on, how)
    hot_keys = F.broadcast(hot.select(*on))
    hot_part = rows.join(F.broadcast(hot.drop(count_col)), on, "inner")
    cold = rows.join(hot_keys, on, "left_anti")
    return hot_part.unionByName(cold.join(per_key.drop(count_col), on, how))


def hot_join(rows: DataFrame, per_key: DataFrame, on: list[str], *, how: str = "inner",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """``lookup_join`` for a ``per_key`` table (one row per key) that does not know the keys' row counts.

    The rows' keys are counted first (with map-side combine), and only the keys above ``hot_rows``
    are kept, at most ``MAX_HOT_KEYS``.  ``how`` may be inner, left, left_semi or left_anti.
    """
    counted = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    keys = cut_lineage(counted.orderBy(F.desc("_n"), *on).limit(MAX_HOT_KEYS).select(*on), "hot-keys")
    if keys.isEmpty():
        return rows.join(per_key, on, how)
    few = F.broadcast(keys)
    hot = rows.join(few, on, "left_semi").join(F.broadcast(per_key.join(few, on, "left_semi")), on, how)
    return hot.unionByName(rows.join(few, on, "left_anti").join(per_key.join(few, on, "left_anti"), on, how))
