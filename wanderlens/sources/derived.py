"""The ten input tables, derived from the generated ``events``, ``customer`` and ``part`` tables.

Even users are visitors with a stay of 2 to 18 days, odd users are residents; cells, homes, work
places and call partners follow by integer arithmetic from the stored columns. The stored events
lie in one month; some are repeated a month earlier or later, or at the same moment, and some
residents have a second home or work place. User ids leave as text, cell ids as numbers.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderlens.functions.times import month_bounds, ts_in_month

# Base stations by (application, folder). They are one small table that most inputs join, so they
# are kept for the session: Spark then knows their measured size when it chooses a join.
_STATIONS: dict[tuple[str, str], DataFrame] = {}

_IN_STAY = "user_id % 2 = 0 and day(ts) between 1 + (user_id*7)%15 and 2 + (user_id*7)%15 + (user_id*5)%17"

_CELL = """cast(case k % 5 when 0 then (user_id % 6)*5
                when 1 then (user_id % 4)*5 + 51
                else (user_id*13 + (k % 8)*7) % 100 end as bigint)"""



def _around(month: str) -> tuple[dt.date, dt.date]:
    """Bounds that hold the month and whatever is repeated into it."""
    first, end = month_bounds(month)
    return first - dt.timedelta(days=31), end + dt.timedelta(days=31)


_COPIES = """case when event_id % 23 = 0 then array(ts, ts - interval 31 days)
    when event_id % 29 = 0 then array(ts, ts + interval 31 days)
    when event_id % 31 = 0 then array(ts, ts) else array(ts) end"""

_POI_WORDS = ["快捷", "公寓", "家庭旅馆", "客栈", "青年", "商务", "招待所", "温泉", "海景", "情侣", "短租", "别墅", ""]


def _text_id(user: str):
    return F.concat(F.lit("u"), F.col(user))


class DerivedInputs:
    """Lazily built inputs of one folder; ``month`` limits the event scan by pushed-down range."""

    def __init__(self, spark: SparkSession, folder: str, month: str | None = None):
        self.spark, self.folder, self.month = spark, str(folder), month
        self._tables: dict[str, DataFrame] = {}

    def all_months(self) -> DerivedInputs:
        """The same inputs without the month limit."""
        whole = DerivedInputs(self.spark, self.folder)
        whole._tables = self._tables
        return whole

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def _events(self, month: str | None) -> DataFrame:
        events = self._table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        if month:  # the wider range is what reaches the files
            first, end = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in _around(month))
            events = events.filter((F.col("ts") >= first) & (F.col("ts") < end))
        events = events.withColumn("ts", F.explode(F.expr(_COPIES)))
        if month:
            events = events.filter(ts_in_month(F.col("ts"), month))
        # As a generated column the parsed JSON is not copied into every expression and filter that
        # uses ``k``: each row is parsed once, after the filters on the stored columns.
        return events.select(
            "user_id",
            F.expr("cast(date_trunc('second', ts) as timestamp_ntz)").alias("ts"),
            "event_type",
            "value",
            F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k"),
        )

    @cached_property
    def base_station(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _STATIONS:
            stations = self._events(None).select("k").distinct().select(
                F.col("k").cast("bigint").alias("cell_id"),
                F.expr("""cast(case k%10 when 1 then 110.293096+k*0.0002 when 3 then 110.466232+k*0.0002
                    when 7 then 109.499415+k*0.0002 else 108.8+((k*37)%100)*0.022 end as double)""").alias("lng"),
                F.expr("""cast(case k%10 when 1 then 20.026518 when 3 then 19.945878
                    when 7 then 18.302055 else 18.3+((k*53)%100)*0.018 end as double)""").alias("lat"),
                F.expr("cast(case when k%5=0 then null else 500+(k%7)*2000 end as double)").alias("radius_m"),
            ).persist()
            stations.count()
            _STATIONS[key] = stations
        return _STATIONS[key]

    @cached_property
    def scenic_spot(self) -> DataFrame:
        return self.base_station.filter("cell_id % 3 = 0").select(
            F.expr("cast(1 + cell_id % 25 as int)").alias("scenic_id"), "cell_id"
        )

    def _moves(self) -> DataFrame:
        moves = self._events(self.month).withColumn("cell_id", F.expr(_CELL))
        return moves.join(self.base_station.select("cell_id", "lng", "lat"), "cell_id")

    @cached_property
    def visitor_record(self) -> DataFrame:
        origin = self._table("customer").select(
            F.col("c_custkey").alias("user_id"), F.expr("300 + c_nationkey").alias("prov")
        )
        return (
            self._moves().filter(_IN_STAY).join(origin, "user_id")
            .select(_text_id("user_id").alias("user_id"), "ts", "cell_id", "lng", "lat", "prov")
        )

    @cached_property
    def local_record(self) -> DataFrame:
        return self._moves().filter("user_id % 2 = 1").select(
            _text_id("user_id").alias("user_id"), "ts", "cell_id", "lng", "lat", F.lit(327).alias("prov")
        )

    def _stops(self, condition: str) -> DataFrame:
        return self._moves().filter("event_type <> 'error'").filter(condition).select(
            F.to_date("ts").alias("day"), _text_id("user_id").alias("user_id"), "ts", "cell_id",
            F.expr("0.5d + value / 20").alias("dur_h"), "lng", "lat",
        )

    @cached_property
    def visitor_stop(self) -> DataFrame:
        return self._stops(_IN_STAY)

    @cached_property
    def local_stop(self) -> DataFrame:
        return self._stops("user_id % 2 = 1")

    def _place(self, cell: str, unknown: str, second: str, has_second: str) -> DataFrame:
        users = self._table("events").select("user_id").filter("user_id % 2 = 1").distinct()
        cells = f"case when {has_second} then array({cell}, {second}) else array({cell}) end"
        at = users.withColumn("cell_id", F.explode(F.expr(f"cast({cells} as array<bigint>)")))
        known = ~F.expr(unknown)
        return at.join(self.base_station, "cell_id").select(
            _text_id("user_id").alias("user_id"), "cell_id", F.when(known, F.col("lng")).alias("lng"), F.when(known, F.col("lat")).alias("lat")
        )

    @cached_property
    def user_home(self) -> DataFrame:
        return self._place("(user_id % 6)*5", "user_id % 11 = 0", "(user_id*13 + 14) % 100", "user_id % 7 = 3")

    @cached_property
    def user_work(self) -> DataFrame:
        return self._place("(user_id % 4)*5 + 51", "user_id % 13 = 0", "(user_id*13 + 21) % 100", "user_id % 9 = 4")

    @cached_property
    def cdr(self) -> DataFrame:
        user_count = self._table("events").agg(F.max("user_id") + 1).scalar()
        partner = F.expr("""cast(case when k%2 = 0 then user_id + 1 + k%7
                                 else (user_id div 8)*8 + k%3 end as bigint)""")
        return self._events(self.month).filter("user_id % 4 <> 0 or k % 10 = 0").select(
            F.col("ts").alias("call_ts"),
            _text_id("user_id").alias("caller"),
            F.when(F.col("k") != 99, F.concat(F.lit("u"), F.pmod(partner, user_count))).alias("callee"),
            F.expr("cast(round(value * 100) as bigint) * 600").alias("dur_ms"),
        )

    @cached_property
    def poi(self) -> DataFrame:
        words = ",".join(f"'{w}'" for w in _POI_WORDS)
        return (
            self._table("part").withColumn("cell_id", F.expr("p_partkey % 100"))
            .join(self.base_station, "cell_id")
            .select(
                F.col("p_partkey").alias("poi_id"),
                F.expr(f"concat(p_name, ' ', element_at(array({words}), 1 + p_size % 13))").alias("name"),
                F.expr("""case p_type when 'STANDARD' then '酒店;星级酒店' when 'SMALL' then '酒店;快捷酒店'
                    when 'LARGE' then '酒店;公寓式酒店' when 'ECONOMY' then '酒店'
                    when 'MEDIUM' then '酒店;其他' else '购物' end""").alias("tags"),
                F.expr("cast(lng + (p_size-25)*0.002 as double)").alias("lng"),
                F.expr("cast(lat + (p_size-25)*0.001 as double)").alias("lat"),
                F.col("p_retailprice").alias("price"),
            )
        )
