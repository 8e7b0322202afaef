"""Counts spread over a fixed list of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderlens.constants import PROVINCES

ELSE = -1
PROVINCE_COLUMNS = [f"p_{p}" for p in PROVINCES] + ["p_else"]


def province_bucket(prov: str = "prov") -> Column:
    """The province code, or ELSE for codes outside the report list."""
    return F.expr(f"if({prov} in ({', '.join(map(str, PROVINCES))}), {prov}, {ELSE})")


def spread_counts(df: DataFrame, keys: list[str], bucket: str, columns: dict[int, str]) -> DataFrame:
    """Rows per ``keys`` in one column per bucket value, 0 where there are none.

    Counting per (keys, bucket) comes first, so a hot key is combined before any shuffle.
    """
    wide = df.groupBy(*keys).pivot(bucket, list(columns)).count()
    names = list(columns.values())
    return wide.toDF(*keys, *names).fillna(0, names)


def spread_provinces(df: DataFrame, keys: list[str]) -> DataFrame:
    columns = dict(zip([*PROVINCES, ELSE], PROVINCE_COLUMNS))
    return spread_counts(df.withColumn("bucket", province_bucket()), keys, "bucket", columns)


def total_of(columns: list[str]) -> Column:
    return F.expr(" + ".join(columns))
