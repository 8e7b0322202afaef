"""Scenic spots and visitor flows: counts by origin, day and hour, stays, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.constants import SHOPPING_TAG
from wanderlens.functions.counts import (
    PROVINCE_COLUMNS,
    province_bucket,
    spread_counts,
    spread_provinces,
    total_of,
)
from wanderlens.functions.scores import first_tag
from wanderlens.functions.times import MICRO, day_in_month, micro_hours, month_days, ts_in_month
from wanderlens.operators.spatial import nearest_distance

OPEN_HOUR, CLOSE_HOUR = 7, 20


def spot_stops(stops: DataFrame, spots: DataFrame, month: str | None = None) -> DataFrame:
    """Stops of at least an hour at a scenic spot, from 7:00 to 20:59, optionally of one month."""
    kept = stops.filter((F.col("dur_h") >= 1) & F.hour("ts").between(OPEN_HOUR, CLOSE_HOUR))
    if month:
        kept = kept.filter(day_in_month(F.col("day"), month))
    at = spots.select("cell_id", F.col("scenic_id").alias("spot"))
    return kept.select("day", "user_id", "ts", "cell_id", "dur_h").join(at, "cell_id").drop("cell_id")


def visitor_rows(visitors: DataFrame) -> DataFrame:
    """Visitor rows per user: more than one for a user seen with several provinces."""
    return visitors.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


def visitor_flow_by_prov(records: DataFrame, visitors: DataFrame, month: str) -> DataFrame:
    """Distinct (user, province) by province for the month and for each of its days.

    The days of a (user, province) are kept as bits, so one aggregation serves both grains.
    """
    presence = (
        records.filter(ts_in_month(F.col("ts"), month))
        .groupBy("user_id", "prov").agg(F.bit_or(F.expr("shiftleft(1L, day(ts))")).alias("days"))
        .join(visitors.select("user_id"), "user_id", "left_semi")
    )
    seen_on = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda d: F.getbit("days", d) == 1)
    names = F.transform(seen_on, lambda d: F.concat(F.lit(month), F.lpad(d.cast("string"), 2, "0")))
    rows = presence.select("prov", F.explode(F.concat(F.array(F.lit(month)), names)).alias("period"))
    flow = spread_provinces(rows, ["period"])
    return flow.select("period", total_of(PROVINCE_COLUMNS).alias("total"), *PROVINCE_COLUMNS)


def _person_days(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Distinct (spot, day, user, province). Users are made distinct before the visitor join."""
    people = visits.select("spot", "day", "user_id").distinct()
    return people.join(visitors.select("user_id", "prov").distinct(), "user_id")


def spot_flow_prov_month(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Person-days by province per spot."""
    return spread_provinces(_person_days(visits, visitors), ["spot"])


def spot_flow_prov_day(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitors by province per spot and day."""
    return spread_provinces(_person_days(visits, visitors), ["spot", "day"])


def spot_flow_month(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Person-days per spot: the total and one column per day of the month."""
    people = visits.select("spot", "day", "user_id").distinct().join(
        visitors.select("user_id"), "user_id", "left_semi"
    )
    columns = {d: f"d{d}" for d in range(1, 32)}
    flow = spread_counts(people.withColumn("dom", F.dayofmonth("day")), ["spot"], "dom", columns)
    return flow.select("spot", total_of(list(columns.values())).alias("total"), *columns.values())


def spot_flow_day_hour(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitors per spot, day and hour of their stops."""
    people = visits.select("spot", "day", "user_id", F.hour("ts").alias("hour")).distinct().join(
        visitors.select("user_id"), "user_id", "left_semi"
    )
    return spread_counts(people, ["spot", "day"], "hour", {h: f"h{h}" for h in range(24)})


def transport_by_prov(transport: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitors by province per transport mode."""
    return spread_provinces(transport.join(visitors.select("user_id", "prov"), "user_id"), ["transport"])


def prov_by_transport(transport: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitors by transport mode per province."""
    joined = transport.join(visitors.select("user_id", "prov"), "user_id")
    return spread_counts(joined, ["prov"], "transport", {m: f"m{m}" for m in range(4)})


def _stay_hours(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Millionths of hours per (spot, user, day), once per visitor row of the user as a join would."""
    stays = visits.groupBy("spot", "user_id", "day").agg(F.sum(micro_hours(F.col("dur_h"))).alias("micro"))
    return stays.join(visitor_rows(visitors), "user_id").select(
        "spot", (F.col("micro") * F.col("n_rows")).alias("micro")
    )


def spot_avg_stay(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Mean hours of a visitor's day at the spot."""
    return _stay_hours(visits, visitors).groupBy("spot").agg((F.avg("micro") / MICRO).alias("avg_hours"))


def spot_stay_hist(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitor days per spot by whole hours: 1, 2, 3, 4, and 5 or more."""
    whole = F.floor(F.col("micro") / MICRO)
    buckets = [F.count_if(whole == h).alias(f"b{h}") for h in range(1, 5)]
    return _stay_hours(visits, visitors).groupBy("spot").agg(*buckets, F.count_if(whole >= 5).alias("b5plus"))


def stay_days_hist(visitors: DataFrame, min_days: int = 3, max_days: int = 15) -> DataFrame:
    """Distinct users per length of stay, 0 for lengths that do not occur."""
    lengths = visitors.sparkSession.range(min_days, max_days + 1).select(F.col("id").cast("int").alias("stay_days"))
    counts = visitors.select("stay_days", "user_id").distinct().groupBy("stay_days").agg(F.count(F.lit(1)).alias("n"))
    return lengths.join(counts, "stay_days", "left").fillna({"n": 0})


def daily_in_out(visitors: DataFrame, month: str) -> DataFrame:
    """Distinct users arriving and leaving on each day of the month."""
    calendar = month_days(visitors.sparkSession, month)
    for day, name in (("first_date", "n_in"), ("last_date", "n_out")):
        counts = (
            visitors.select(F.col(day).alias("day"), "user_id").distinct()
            .groupBy("day").agg(F.count(F.lit(1)).alias(name))
        )
        calendar = calendar.join(counts, "day", "left")
    return calendar.fillna(0)


def spot_rank(spots: DataFrame, flow: DataFrame, stays: DataFrame) -> DataFrame:
    """Flow, mean stay and flow x stay / 1000 of every spot, 0 where nobody came."""
    ranked = (
        spots.select(F.col("scenic_id").alias("spot")).distinct()
        .join(flow.select("spot", F.col("total").alias("flow")), "spot", "left")
        .join(stays.select("spot", "avg_hours"), "spot", "left")
        .fillna({"flow": 0, "avg_hours": 0.0})
    )
    return ranked.withColumn("cum_hours", F.col("flow") * F.col("avg_hours") / 1000)


def spot_concentration(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Geographic concentration 100 * sqrt(sum of squared province shares) per spot, on person-days."""
    by_prov = (
        _person_days(visits, visitors).withColumn("bucket", province_bucket())
        .groupBy("spot", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    index = F.sqrt(F.sum(F.col("n") * F.col("n"))) / F.sum("n") * 100
    return by_prov.groupBy("spot").agg(index.alias("g"))


def nearest_poi_dist(spots: DataFrame, stations: DataFrame, poi: DataFrame, tag: str = SHOPPING_TAG) -> DataFrame:
    """Distance from each spot, over all its cells, to the nearest POI with ``tag`` as first tag."""
    cells = spots.select(F.col("scenic_id").alias("spot"), "cell_id").join(
        stations.select("cell_id", "lng", "lat"), "cell_id"
    )
    shops = poi.filter(first_tag(F.col("tags")) == tag)
    return nearest_distance(cells, shops, "spot")
