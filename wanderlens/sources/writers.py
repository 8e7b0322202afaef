"""Result sets as partitioned Parquet or as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv")


PARTITION = ["province", "month"]


def folder_of(out: str, name: str, province: str, month: str | None = None) -> str:
    at = f"{out.rstrip('/')}/{name}/province={province}"
    return f"{at}/month={month}" if month else at


def in_partitions(parts: dict[tuple, DataFrame], keys: list[str]) -> DataFrame:
    """One table of several, each with the values of its partition as columns.

    The values are literals, so a filter on them leaves only the parts that it asks for in the plan.
    """
    frames = [
        df.select("*", *[F.lit(value).alias(key) for key, value in zip(keys, of, strict=True)]) for of, df in parts.items()
    ]
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table


def write_partitions(
    parts: dict[tuple, DataFrame], out: str, name: str, fmt: str = "parquet", keys: list[str] = PARTITION,
) -> list[str]:
    """Write a table for several partitions in one job, replacing these partitions only; returns their folders.

    Rows are dealt by partition with files of even size. A partition that turns out empty is replaced
    by an empty one.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    folders = {of: folder_of(out, name, *of) for of in parts}
    table = in_partitions(parts, keys)
    spark = table.sparkSession
    before = {of: _files(spark, folder) for of, folder in folders.items()}
    dealt = table.hint("rebalance", *keys)
    if fmt == "csv":
        dealt = dealt.select(*[_as_text(f) for f in dealt.schema.fields])
    _save(dealt.write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys), f"{out.rstrip('/')}/{name}", fmt)
    for of, df in parts.items():
        if _files(spark, folders[of]) == before[of]:  # no row was written, and file names are never used twice
            empty = df.limit(0)
            _save((empty.select(*[_as_text(f) for f in empty.schema.fields]) if fmt == "csv" else empty).write, folders[of], fmt)
    return list(folders.values())


def _files(spark: SparkSession, folder: str) -> set[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in store.listStatus(path)} if store.exists(path) else set()


def write_result(df: DataFrame, out: str, name: str, province: str, month: str, fmt: str = "parquet") -> str:
    """Write one result of a province and month, replacing that partition only; returns its folder."""
    return write_partitions({(province, month): df}, out, name, fmt)[0]


def _save(writer: DataFrameWriter, folder: str, fmt: str) -> None:
    if fmt == "csv":
        writer.mode("overwrite").csv(folder, nullValue="None", emptyValue="", dateFormat="yyyyMMdd")
    else:
        writer.mode("overwrite").parquet(folder)


def _as_text(field: T.StructField):
    if isinstance(field.dataType, T.ArrayType):
        return F.concat_ws("#", F.col(field.name)).alias(field.name)
    return F.col(field.name)
