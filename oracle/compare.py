"""Run a registered query in Spark and its statement in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_cell, value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Row count of the Spark result, and what differs from DuckDB (nothing if equal)."""
    spark_rows = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return len(spark_rows), [f"columns {sorted(df.columns)} <> {sorted(names)}"]
    ours, theirs = _bag(df.columns, spark_rows), _bag(names, result.fetchall())
    if ours == theirs:
        return len(spark_rows), []
    return len(spark_rows), [
        f"{sum(ours.values())} rows <> {sum(theirs.values())}",
        f"only in Spark: {list((ours - theirs).items())[:3]}",
        f"only in DuckDB: {list((theirs - ours).items())[:3]}",
    ]
