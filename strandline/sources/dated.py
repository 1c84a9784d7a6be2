"""Tables laid out by date, so that windows and newest-first pages open few files.

Rows are written by month, and inside a month in runs of falling dates; undated rows have a folder of their own.  A busy
month, or many undated rows, is dealt to several files by date and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import filters

MONTH = "month"
UNDATED = "undated"


def month_of(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(UNDATED))


def by_date(df: DataFrame, ts: str = "date_published", tie: str = "id") -> DataFrame:
    """``df`` with its month, in the order it is to be written: ``layout`` of ``sinks.append_new`` with ``partition_by=["month"]``."""
    rows = df.withColumn(MONTH, month_of(F.col(ts)))
    return rows.repartitionByRange(MONTH, ts, tie).sortWithinPartitions(MONTH, F.desc(ts), tie)


def between(stored: DataFrame, start: Column | None = None, end: Column | None = None, ts: str = "date_published") -> DataFrame:
    """Rows dated in [start, end); only the months of that window are opened."""
    out = stored
    if start is not None:
        out = out.where((F.col(MONTH) >= F.date_format(start, "yyyy-MM")) & (F.col(MONTH) != UNDATED) & (F.col(ts) >= start))
    if end is not None:
        out = out.where((F.col(MONTH) <= F.date_format(end, "yyyy-MM")) & (F.col(ts) < end))
    return out


def newest_page(stored: DataFrame, limit: int, where: Column | None = None, ts: str = "date_published", tie: str = "id") -> DataFrame:
    """The first ``limit`` rows of ``filters.newest`` (undated rows in front, then newest first) that satisfy ``where``.

    Months are opened from the front, one, then twice as many, until they hold a page; equal to sorting all rows.
    """
    months = [r[0] for r in stored.select(MONTH).distinct().collect()]     # a name for each month
    months.sort(key=lambda m: (m == UNDATED, m), reverse=True)
    rows = stored if where is None else stored.where(where)
    take = 1
    while True:
        some = rows.where(F.col(MONTH).isin(months[:take])) if take < len(months) else rows
        if take >= len(months) or some.limit(limit).count() >= limit:
            return filters.newest(some.withColumnRenamed(ts, "date_published"), tie).limit(limit).withColumnRenamed("date_published", ts)
        take *= 2
