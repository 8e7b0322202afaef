"""Month ranges, time of day, weekdays and stamps. All times are zone-free (``timestamp_ntz``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_SECONDS = 86400
LAST_SECOND = DAY_SECONDS - 1
MICRO = 1_000_000


def micro_hours(hours: Column) -> Column:
    """Hours as whole millionths, whose sums do not depend on the order of the rows."""
    return F.round(hours * MICRO).cast("bigint")


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    """First day of ``yyyyMM`` and first day of the month after it."""
    first = dt.datetime.strptime(month, "%Y%m").date()
    return first, (first + dt.timedelta(days=31)).replace(day=1)


def day_in_month(day: Column, month: str) -> Column:
    """Range test on a date column, so that a Parquet scan can skip row groups."""
    lo, hi = month_bounds(month)
    return (day >= F.lit(lo)) & (day < F.lit(hi))


def ts_in_month(ts: Column, month: str) -> Column:
    """Range test on a timestamp_ntz column, so that a Parquet scan can skip row groups."""
    lo, hi = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in month_bounds(month))
    return (ts >= lo) & (ts < hi)


def month_days(spark: SparkSession, month: str) -> DataFrame:
    """One row per calendar day of the month."""
    lo, hi = month_bounds(month)
    days = F.sequence(F.lit(lo), F.lit(hi - dt.timedelta(days=1)))
    return spark.range(1).select(F.explode(days).alias("day"))


def days_between(first: Column, last: Column) -> Column:
    """Array of days, both ends included; empty when ``first`` is after ``last``."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def parse_stamp(text: Column, fmt: str = "yyyyMMddHHmmss") -> Column:
    return F.to_timestamp_ntz(text, F.lit(fmt))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970, the wall-clock time read as UTC."""
    days = F.datediff(F.to_date(ts), F.lit(dt.date(1970, 1, 1))).cast("bigint")
    return (days * DAY_SECONDS + second_of_day(ts)) * 1000


def millis_to_text(millis: Column, fmt: str = "yyyyMMddHHmmss") -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (millis / 1000).cast("decimal(18,6)")
    return F.date_format(epoch + F.make_dt_interval(secs=seconds), fmt)


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(epoch_millis(a) - epoch_millis(b)) / 1000
