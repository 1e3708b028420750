"""Calendar tables, and joins of points with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_month(now: Column) -> tuple[Column, Column]:
    """The first and the last day of the month before."""
    first = F.trunc(F.add_months(now, -1), "month")
    return first, F.last_day(first)


def is_weekday(day: Column) -> Column:
    """Monday to Friday; holidays aren't known."""
    return F.weekday(day) < 5


def context(now: Column) -> Column:
    """struct<current_datetime, current_year, current_month, last_year, last_month, days_in_last_month, weekdays_in_last_month>."""
    first, last = last_month(now)
    days = F.sequence(first, last)
    return F.struct(
        F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("current_datetime"),
        F.year(now).alias("current_year"),
        F.month(now).alias("current_month"),
        F.year(first).alias("last_year"),
        F.month(first).alias("last_month"),
        F.size(days).alias("days_in_last_month"),
        F.size(F.filter(days, is_weekday)).alias("weekdays_in_last_month"),
    )


def days_of_last_month(moments: DataFrame, now: str = "now") -> DataFrame:
    """moments(now, ...) -> with a row for each day of the month before: day, start and end (as times), weekday (1 is Monday), working."""
    first, last = last_month(F.col(now))
    out = moments.withColumn("day", F.explode(F.sequence(first, last)))
    start = F.col("day").cast("timestamp_ntz")
    return out.withColumns({"start": start, "end": start + F.expr("INTERVAL 1 DAY"), "weekday": F.weekday("day") + 1, "working": is_weekday(F.col("day"))})


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, seconds: int = 86_400, on: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """points and intervals where start <= point < end, and the columns `on` are equal.

    Both sides meet on slices of time of `seconds`: a point falls into one, an interval is repeated for each that it touches, so
    this is an equi-join whose hot slices Spark can split. Choose slices about as long as the intervals are. how: inner, left or
    left_semi of the points. The names of the two sides must differ, but for `on`.
    """
    slice_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds).cast("long")
    near = points.withColumn("_slice", slice_of(F.col(point)))
    until = F.col(end).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_of", F.explode(F.sequence(slice_of(F.col(start)), slice_of(until))))
    for c in on:
        spread = spread.withColumnRenamed(c, f"_on_{c}")
    match = (F.col("_slice") == F.col("_of")) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    for c in on:
        match = match & (F.col(c) == F.col(f"_on_{c}"))
    return near.join(spread, match, how).drop("_slice", "_of", *[f"_on_{c}" for c in on])
