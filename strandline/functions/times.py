"""Reporting windows.  Local time is UTC+8; a reporting day runs 06:00 to 06:00 local,
which is 22:00 to 22:00 UTC.  Every function takes ``as_of`` instead of a wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_HOURS = 8
DAY_START = 6
PERIOD_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90}


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def to_local(ts: Column) -> Column:
    return ts + hours(LOCAL_HOURS)


def trunc(unit: str, ts: Column) -> Column:
    """date_trunc that keeps TIMESTAMP_NTZ inputs NTZ."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def window_end(as_of: Column) -> Column:
    shift = LOCAL_HOURS - DAY_START
    return trunc("day", as_of + hours(shift)) - hours(shift)


def period_window(as_of: Column, period: str = "daily") -> Column:
    """struct<start_utc, end_utc> of the last complete period at ``as_of``."""
    end = window_end(as_of)
    return F.struct((end - days(PERIOD_DAYS.get(period, 1))).alias("start_utc"), end.alias("end_utc"))


def daily_window(as_of: Column) -> Column:
    return period_window(as_of, "daily")


def year_window(as_of: Column) -> Column:
    start = F.add_months(F.to_date(as_of), -12).cast("timestamp_ntz") + (as_of - trunc("day", as_of))
    return F.struct(start.alias("start_utc"), as_of.alias("end_utc"))


def day_bucket(ts: Column) -> Column:
    """The reporting day a timestamp falls into, as a struct<start, end>."""
    return F.window(ts, "1 day", "1 day", f"{24 - (LOCAL_HOURS - DAY_START)} hours")


def iso_week_key(ts: Column) -> Column:
    local = to_local(ts)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), local).cast("int"),
                           F.weekofyear(local))


def iso_week_window(as_of: Column, offset: int = 0) -> Column:
    """Local Monday 00:00 to the next Monday, cut at ``as_of`` while the week is running."""
    monday = trunc("week", to_local(as_of)) + days(7 * offset)
    end = monday + days(7)
    complete = end <= to_local(as_of)
    return F.struct(
        iso_week_key(monday - hours(LOCAL_HOURS)).alias("week_key"),
        (monday - hours(LOCAL_HOURS)).alias("start_utc"),
        F.when(complete, end - hours(LOCAL_HOURS)).otherwise(as_of).alias("end_utc"),
        complete.alias("is_complete"),
    )


def in_window(ts: Column, start: Column, end: Column) -> Column:
    return F.coalesce((ts >= start) & (ts < end), F.lit(False))


def within_days(ts: Column, n: int, as_of: Column) -> Column:
    """Younger than ``n`` days at ``as_of``; future timestamps count as recent."""
    return F.coalesce(ts > as_of - days(n), F.lit(False))


def age_band(ts: Column, as_of: Column) -> Column:
    age = F.when(ts.isNotNull(), F.lit(0))
    for limit, points in reversed([(30, 5), (90, 3), (180, 2), (365, 1)]):
        age = F.when(ts >= as_of - days(limit), F.lit(points)).otherwise(age)
    return F.coalesce(age, F.lit(0))


def day_windows(df: DataFrame, start: str, end: str, max_days: int | None = None) -> DataFrame:
    """One row per local calendar day of each input row's [start, end] dates; all, or the first ``max_days``."""
    last = F.col(end) if max_days is None else F.least(F.col(end), F.date_add(F.col(start), max_days - 1))
    day = df.withColumn("day", F.explode(F.sequence(F.col(start), last)))
    begin = F.col("day").cast("timestamp_ntz") - hours(LOCAL_HOURS)
    return day.withColumn("start_utc", begin).withColumn("end_utc", begin + days(1))


def week_chunks(df: DataFrame, start: str, end: str) -> DataFrame:
    """Consecutive 7-day chunks of each row's [start, end); the last one is cut."""
    step = F.sequence(F.col(start), F.col(end), days(7))
    out = df.withColumn("chunk_start", F.explode(step)).where(F.col("chunk_start") < F.col(end))
    return out.withColumn("chunk_end", F.least(F.col("chunk_start") + days(7), F.col(end)))


def snapshot_key(ts: Column) -> Column:
    """``snapshot-<local date of the reporting day's end>``."""
    shift = LOCAL_HOURS - DAY_START
    return F.concat(F.lit("snapshot-"),
                    F.date_format(ts + hours(shift) + days(1), "yyyy-MM-dd"))


def format_local(ts: Column) -> Column:
    return F.coalesce(F.date_format(to_local(ts), "dd MMM yyyy, HH:mm"), F.lit("No date"))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parse_date(text: Column) -> Column:
    """Lenient timestamp parsing to UTC wall time; anything unparsable is null.

    ISO-8601 is tried first, then the RFC-822 form of feeds without its weekday.
    """
    clean = F.trim(text)
    rfc = F.regexp_replace(clean, r"^[A-Za-z]{3},\s*", "")
    numeric_zone = F.regexp_replace(rfc, r"\b(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(clean),
        F.try_to_timestamp(numeric_zone, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(numeric_zone, F.lit("d MMM yyyy HH:mm Z")),
    ).cast("timestamp_ntz")


def serial_date(n: Column) -> Column:
    """Spreadsheet serial day number (epoch 1899-12-30) to a timestamp."""
    whole = F.floor(n)
    date = F.date_add(F.lit("1899-12-30").cast("date"), whole.cast("int"))
    seconds = F.round((n - whole) * 86400).cast("int")
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
