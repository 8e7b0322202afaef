"""Readers of the raw text layouts and of typed Parquet tables.

Text lines are checked while reading: a line with a wrong number of fields or a value that does not
parse fails the job, except in the base-station file, where such lines are dropped.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from wanderlens.sources.schemas import TABLES, VISITOR
from wanderlens.sources.writers import PARTITION, write_partitions

# The field order of each raw layout. Fields that no operator uses are plain strings.
RAW_LAYOUTS = {
    "record": "user_id string, ts timestamp_ntz, cell_id string, lng double, lat double, prov int",
    "stop": "day date, user_id string, ts timestamp_ntz, cell_id string, dur_h double, lng double, lat double",
    "place": "user_id string, cell_id string, lng double, lat double",
    "visitor": VISITOR,
    "transport": "user_id string, transport int",
    "spot": "sid string, name string, status string, slng string, slat string, cid string, clng string, "
            "clat string, dist string",
}
STATION_FIELDS = {"cell_id": 3, "radius_m": 11, "lng": 12, "lat": 13}
STATION_WIDTH = 14
CALL_FIELDS = {"call_ts": 1, "caller": 3, "callee": 4, "dur_ms": 5}
POI_FIELDS = {"name": 0, "lat": 2, "lng": 3, "tags": 7, "price": 8}
POI_SCORES = range(10, 18)
CALL_WIDTH, POI_WIDTH, PRICED_POI_WIDTH = 6, 8, 18
NO_PRICE = -1.0
UNKNOWN = "None"
STAMP, DAY = "yyyyMMddHHmmss", "yyyyMMdd"


def _strict(spark: SparkSession) -> DataFrameReader:
    """A reader that checks every field of a line, also those that the query does not use."""
    return spark.read.options(
        mode="FAILFAST", columnPruning=False, timestampNTZFormat=STAMP, dateFormat=DAY,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def read_csv(spark: SparkSession, layout: str, path: str) -> DataFrame:
    """One of the strict comma-separated layouts; unknown coordinates and cells become NULL."""
    return _strict(spark).option("nullValue", UNKNOWN).schema(RAW_LAYOUTS[layout]).csv(path)


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Spot and cell ids; lines whose spot id is not a number are headers."""
    lines = _strict(spark).schema(RAW_LAYOUTS["spot"]).csv(path)
    return lines.filter(F.col("sid").rlike("^[0-9]+$")).select(
        F.col("sid").cast("int").alias("scenic_id"), F.col("cid").alias("cell_id")
    )


def _field(fields: Column, position: int) -> Column:
    """A field of a split line, NULL if it is blank or missing."""
    return F.nullif(F.trim(F.get(fields, F.lit(position))), F.lit(""))


def _split(lines: DataFrame, separator: str, least: int) -> DataFrame:
    """Fields of each line; a line with fewer than ``least`` fails the job."""
    fields = F.split("value", separator)
    short = F.raise_error(F.concat(F.lit(f"fewer than {least} fields: "), F.substring("value", 1, 80)))
    return lines.select(F.when(F.size(fields) >= least, fields).otherwise(short).alias("f"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Base stations from lines of 14 fields, counted up to the last field that is not blank."""
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    lines = spark.read.text(path).select(fields.alias("f")).filter(F.size("f") == STATION_WIDTH)
    known = {name: _field(F.col("f"), i) for name, i in STATION_FIELDS.items()}
    return lines.select(
        known["cell_id"].alias("cell_id"),
        *[F.nullif(known[c], F.lit(UNKNOWN)).cast("double").alias(c) for c in ("lng", "lat", "radius_m")],
    )


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Call records; a blank end of a call is NULL."""
    lines = _split(spark.read.text(path), ",", CALL_WIDTH)
    part = {name: _field(F.col("f"), i) for name, i in CALL_FIELDS.items()}
    return lines.select(
        F.to_timestamp_ntz(part["call_ts"], F.lit(STAMP)).alias("call_ts"),
        part["caller"].alias("caller"), part["callee"].alias("callee"), part["dur_ms"].cast("bigint").alias("dur_ms"),
    )


def read_poi(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest from pipe-separated lines.

    Equal lines are one POI. Hotels of one label are told apart by name, position, price and scores,
    so these make the key; a line without the priced width has neither price nor scores.
    """
    lines = _split(spark.read.text(path).distinct(), r"\|", POI_WIDTH)
    part = {name: _field(F.col("f"), i) for name, i in POI_FIELDS.items()}
    priced = F.size("f") == PRICED_POI_WIDTH
    valued = [F.when(priced, _field(F.col("f"), i)) for i in (POI_FIELDS["price"], *POI_SCORES)]
    known = [F.coalesce(x, F.lit("-1")) for x in (part["name"], part["lng"], part["lat"], *valued)]
    return lines.select(
        F.xxhash64(*known).alias("poi_id"), part["name"].alias("name"), part["tags"].alias("tags"),
        part["lng"].cast("double").alias("lng"), part["lat"].cast("double").alias("lat"),
        F.coalesce(F.when(priced, part["price"].cast("double")), F.lit(NO_PRICE)).alias("price"),
    )


# Where each raw input lies below the root, by province and month.
RAW_PATHS = {
    "visitor_record": "DataClean/tmp/{province}/{month}/{month}TotalOther.csv",
    "local_record": "DataClean/tmp/{province}/{month}/{month}TrueLocal.csv",
    "visitor_stop": "Extraction/{province}/{month}/{month}OtherStop.csv",
    "local_stop": "Extraction/{province}/{month}/{month}LocalStop.csv",
    "user_home": "Extraction/{province}/{month}/{month}Home.csv",
    "user_work": "Extraction/{province}/{month}/{month}Work.csv",
    "cdr": "SplitData/{province}/{month}/{month}CC.csv",
    "poi": "BasicInfo/POI/{province}/{province}.csv",
    "scenic_spot": "BasicInfo/ScenicSpot/{province}.csv",
    "base_station": "BasicInfo/BaseStation/{province}.csv",
}


class RawInputs:
    """The input tables read from text files. ``paths`` replaces single locations."""

    def __init__(self, spark: SparkSession, root: str, province: str, month: str, paths: dict[str, str] | None = None):
        self.spark = spark
        self._paths = {
            name: f"{root.rstrip('/')}/{path.format(province=province, month=month)}"
            for name, path in {**RAW_PATHS, **(paths or {})}.items()
        }

    def _csv(self, name: str, layout: str) -> DataFrame:
        return read_csv(self.spark, layout, self._paths[name])

    @cached_property
    def visitor_record(self) -> DataFrame:
        return self._csv("visitor_record", "record")

    @cached_property
    def local_record(self) -> DataFrame:
        return self._csv("local_record", "record")

    @cached_property
    def visitor_stop(self) -> DataFrame:
        return self._csv("visitor_stop", "stop")

    @cached_property
    def local_stop(self) -> DataFrame:
        return self._csv("local_stop", "stop")

    @cached_property
    def user_home(self) -> DataFrame:
        return self._csv("user_home", "place")

    @cached_property
    def user_work(self) -> DataFrame:
        return self._csv("user_work", "place")

    @cached_property
    def scenic_spot(self) -> DataFrame:
        return read_spots(self.spark, self._paths["scenic_spot"])

    @cached_property
    def cdr(self) -> DataFrame:
        return read_calls(self.spark, self._paths["cdr"])

    @cached_property
    def base_station(self) -> DataFrame:
        return read_stations(self.spark, self._paths["base_station"])

    @cached_property
    def poi(self) -> DataFrame:
        return read_poi(self.spark, self._paths["poi"])


class ParquetInputs:
    """The input tables read from ``root/<table>``, partitioned by province and month."""

    def __init__(self, spark: SparkSession, root: str, province: str, month: str):
        self._spark, self._root, self._province, self._month = spark, root.rstrip("/"), province, month

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self._spark.read.parquet(f"{self._root}/{name}")
        for key, value in (("province", self._province), ("month", self._month)):
            if key in table.columns:
                table = table.filter(F.col(key).cast("string") == value).drop(key)
        return table


def raw_table(spark: SparkSession, root: str, name: str, provinces: list[str], months: list[str]) -> dict[tuple, DataFrame]:
    """One raw input of several provinces and months, by (province, month), or by province where it has no months."""
    by_month = "{month}" in RAW_PATHS[name]
    keys = [(p, m) for p in provinces for m in months] if by_month else [(p,) for p in provinces]
    return {key: getattr(RawInputs(spark, root, key[0], key[-1]), name) for key in keys}


def import_raw(spark: SparkSession, root: str, out: str, provinces: list[str], months: list[str]) -> list[str]:
    """Store the raw text of several provinces and months as typed Parquet tables that ``ParquetInputs`` reads.

    Each table is one job; partitions of other provinces and months stay as they are.
    """
    folders = []
    for name in RAW_PATHS:
        parts = raw_table(spark, root, name, provinces, months)
        folders += write_partitions(parts, out, name, keys=PARTITION[: len(next(iter(parts)))])
    return folders
