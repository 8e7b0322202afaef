"""Visitors: detection, arrival and departure, lodging, behaviour features and the wide profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wanderlens.constants import DUTY_FREE_SPOT, HUB_KM, UNKNOWN_MODE
from wanderlens.functions.geo import distance_km, transport_mode
from wanderlens.functions.times import MICRO, epoch_millis, micro_hours, ts_in_month
from wanderlens.operators.lodging import UNMATCHED, cell_hotel_labels
from wanderlens.operators.social import contact_pairs
from wanderlens.operators.spine import fill_spine, on_spine

DEFAULT_TYPE = "bird"


def detect_visitors(records: DataFrame, month: str, min_days: int = 3, max_days: int = 15) -> DataFrame:
    """First day, last day and length of stay per (user, province), for stays within the limits."""
    stays = (
        records.filter(ts_in_month(F.col("ts"), month))
        .groupBy("user_id", "prov")
        .agg(F.to_date(F.min("ts")).alias("first_date"), F.to_date(F.max("ts")).alias("last_date"))
    )
    days = F.datediff("last_date", "first_date") + 1
    return stays.withColumn("stay_days", days).filter(F.col("stay_days").between(min_days, max_days))


def _transport(visitors: DataFrame, stops: DataFrame, stations: DataFrame, leaving: bool, max_km: float) -> DataFrame:
    # Stops are reduced to one moment per (user, day, cell) on the map side, then to the edge days of the
    # visitors: the stations meet two days of a visitor at most. At one moment the smallest cell id counts.
    when, edge_day = (-epoch_millis(F.col("ts")), "last_date") if leaving else (epoch_millis(F.col("ts")), "first_date")
    per_cell = stops.groupBy("user_id", F.to_date("ts").alias("edge_day"), "cell_id").agg(F.min(when).alias("when"))
    days = visitors.select("user_id", F.col(edge_day).alias("edge_day"))
    located = per_cell.join(days, ["user_id", "edge_day"]).join(stations.select("cell_id", "lng", "lat"), "cell_id")
    per_user = located.groupBy("user_id").agg(F.min(F.struct("when", "cell_id", "lng", "lat")).alias("edge"))
    return per_user.select(
        "user_id", transport_mode(F.col("edge.lng"), F.col("edge.lat"), max_km).alias("transport")
    )


@on_spine(transport=UNKNOWN_MODE)
def transport_in(visitors: DataFrame, stops: DataFrame, stations: DataFrame, max_km: float = HUB_KM) -> DataFrame:
    """Transport mode at the earliest stop of the first day."""
    return _transport(visitors, stops, stations, False, max_km)


@on_spine(transport=UNKNOWN_MODE)
def transport_out(visitors: DataFrame, stops: DataFrame, stations: DataFrame, max_km: float = HUB_KM) -> DataFrame:
    """Transport mode at the latest stop of the last day."""
    return _transport(visitors, stops, stations, True, max_km)


def month_stops(stops: DataFrame, month: str) -> DataFrame:
    """Stops of at least an hour in the month."""
    return stops.filter(ts_in_month(F.col("ts"), month) & (F.col("dur_h") >= 1))


@on_spine()
def visitor_home(visitors: DataFrame, stops: DataFrame, stations: DataFrame, month: str) -> DataFrame:
    """Lodging: the cell with most night hours; unknown if that cell has no station row."""
    per_cell = (
        month_stops(stops, month).filter(F.hour("ts") <= 6)
        .groupBy("user_id", "cell_id").agg(F.sum(micro_hours(F.col("dur_h"))).alias("micro"))
    )
    longest = F.min_by("cell_id", F.struct(-F.col("micro"), "cell_id"))
    homes = per_cell.groupBy("user_id").agg(longest.alias("home_cell"))
    return homes.join(
        stations.select(F.col("cell_id").alias("home_cell"), "lng", "lat"), "home_cell"
    ).select("user_id", "home_cell", "lng", "lat")


def _calls_per_day(visitors: DataFrame, cdr: DataFrame) -> DataFrame:
    """Mean calls per active day of each visitor. A user with several visitor rows counts each call
    once per row, as a join on the user does."""
    per_day = (
        cdr.select(F.to_date("call_ts").alias("day"), F.explode(F.array("caller", "callee")).alias("user_id"))
        .filter("user_id is not null")
        .groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("calls"))
    )
    per_user = per_day.groupBy("user_id").agg(F.avg("calls").alias("mean_calls"))
    rows = visitors.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_user.join(rows, "user_id").select(
        "user_id", (F.col("mean_calls") * F.col("n_rows")).alias("mean_calls")
    )


@on_spine(call_level=1)
def call_strength(visitors: DataFrame, cdr: DataFrame) -> DataFrame:
    """Level 1, 2 or 3 for fewer than 3, 3 to 6, more than 6 calls per active day."""
    mean = F.col("mean_calls")
    level = F.when(mean < 3, 1).when(mean <= 6, 2).otherwise(3)
    return _calls_per_day(visitors, cdr).select("user_id", level.alias("call_level"))


def visitor_kinds(visitors: DataFrame, residents: DataFrame, cdr: DataFrame) -> DataFrame:
    """Users that are "bird" or "business"; visitors that are neither are left out.

    Bird: 25 days or more, or at least half of the user's distinct contacts are visitors; that
    second count exists for residents only. Business: 3 calls per active day on a stay of up to
    7 days, and not bird.
    """
    pairs = contact_pairs(cdr)
    contacts = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("contacts"))
    visiting = visitors.select(F.col("user_id").alias("contact"), "stay_days").distinct()
    visitor_contacts = (
        pairs.join(residents.select("user_id").distinct(), "user_id", "left_semi")
        .join(visiting, "contact")
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("visitor_contacts"))
    )
    half = F.coalesce("visitor_contacts", F.lit(0)) >= F.col("contacts") / 2
    social = contacts.join(visitor_contacts, "user_id", "left").filter(half).select("user_id")
    long_stays = visitors.filter("stay_days >= 25").select("user_id")
    birds = social.unionByName(long_stays).distinct().withColumn("bird", F.lit("bird"))
    busy = _calls_per_day(visitors.filter("stay_days <= 7"), cdr).filter("mean_calls >= 3").select("user_id")
    return birds.join(busy, "user_id", "full").select(
        "user_id", F.coalesce("bird", F.lit("business")).alias("visitor_type")
    )


def visitor_type(visitors: DataFrame, residents: DataFrame, cdr: DataFrame,
                 default_type: str = DEFAULT_TYPE) -> DataFrame:
    """The kind of each visitor; who is neither bird nor business gets ``default_type``."""
    return fill_spine(visitors, visitor_kinds(visitors, residents, cdr), visitor_type=default_type)


@on_spine(duty_free="0")
def duty_free_visit(visitors: DataFrame, stops: DataFrame, spots: DataFrame, month: str,
                    spot: int = DUTY_FREE_SPOT) -> DataFrame:
    """"1" if any stop was at a cell of the duty-free spot, else "0"."""
    cells = spots.filter(F.col("scenic_id") == spot).select("cell_id")
    seen = month_stops(stops, month).join(cells, "cell_id", "left_semi").select("user_id").distinct()
    return seen.withColumn("duty_free", F.lit("1"))


@on_spine()
def top3_locations(visitors: DataFrame, stops: DataFrame, month: str) -> DataFrame:
    """The three positions with most stops; NULL where there are fewer."""
    counts = month_stops(stops, month).groupBy("user_id", "lng", "lat").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("user_id").orderBy(F.desc("n"), "lng", "lat")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    columns = [
        F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("lng", "lat")
    ]
    return ranked.groupBy("user_id").agg(*columns)


@on_spine(spots=0, hours=0.0)
def spot_visit_count(visitors: DataFrame, stops: DataFrame, spots: DataFrame, month: str) -> DataFrame:
    """Distinct spots and total hours at spots, at any time of day."""
    per_spot = (
        month_stops(stops, month).join(spots.select("cell_id", "scenic_id"), "cell_id")
        .groupBy("user_id", "scenic_id").agg((F.sum(micro_hours(F.col("dur_h"))) / MICRO).alias("h"))
    )
    return per_spot.groupBy("user_id").agg(F.count(F.lit(1)).alias("spots"), F.sum("h").alias("hours"))


@on_spine(max_km=-1.0)
def max_dist_from_home(visitors: DataFrame, stops: DataFrame, homes: DataFrame, month: str) -> DataFrame:
    """Largest distance of a stop from the lodging, -1 if unknown."""
    places = month_stops(stops, month).select("user_id", "lng", "lat").distinct()
    lodging = homes.select("user_id", F.col("lng").alias("home_lng"), F.col("lat").alias("home_lat"))
    away = distance_km(F.col("lng"), F.col("lat"), F.col("home_lng"), F.col("home_lat"))
    return places.join(lodging, "user_id").groupBy("user_id").agg(F.max(away).alias("max_km"))


PROFILE_DEFAULTS = {
    **transport_out.defaults, **duty_free_visit.defaults, **call_strength.defaults,
    **spot_visit_count.defaults, **max_dist_from_home.defaults,
    "visitor_type": DEFAULT_TYPE, "hotel_type": UNMATCHED,
}


def _cells(stations: DataFrame, spots: DataFrame) -> DataFrame:
    """What is known of a cell: the station's position and the spots that it belongs to."""
    at = stations.groupBy("cell_id").agg(F.min(F.struct("lng", "lat")).alias("station"))
    of = spots.groupBy("cell_id").agg(F.collect_list("scenic_id").alias("spots"))
    return at.join(of, "cell_id", "full")


def stop_state(stops: DataFrame, month: str) -> DataFrame:
    """One row per (user, day, cell, position) from which all features of the stops are read.

    ``n`` stops of an hour or more in the month and their ``micro`` hours, those at night apart, and the
    last moment of all. Rows of one state add up, so stops are combined before anything is shuffled.
    """
    counted = ts_in_month(F.col("ts"), month) & (F.col("dur_h") >= 1)
    micro = micro_hours(F.col("dur_h"))
    night = counted & (F.hour("ts") <= 6)
    return stops.groupBy("user_id", F.to_date("ts").alias("day"), "cell_id", "lng", "lat").agg(
        F.max(epoch_millis(F.col("ts"))).alias("last"), F.count_if(counted).alias("n"),
        F.sum(F.when(counted, micro).otherwise(0)).alias("micro"),
        F.sum(F.when(night, micro)).alias("night"))


def _stop_features(state: DataFrame, users: DataFrame, cells: DataFrame, max_km: float) -> DataFrame:
    """Departure, lodging, top places, spots, duty-free visit and farthest place of each user in one pass.

    After the join on the user all windows and the aggregate keep that partitioning. Their groups are
    rows of the state: days, cells and positions of one user.
    """
    near = state.join(cells, "cell_id", "left").join(users.select("user_id", "last_dates"), "user_id")
    by_cell, by_place = W.partitionBy("user_id", "cell_id"), W.partitionBy("user_id", "lng", "lat")
    summed = near.withColumn("cell_night", F.sum("night").over(by_cell)).withColumn("place_n", F.sum("n").over(by_place))
    leaving = F.array_contains("last_dates", F.col("day")) & F.col("station").isNotNull()
    counted = F.col("n") > 0
    home = F.when(F.col("cell_night").isNotNull(), F.struct((-F.col("cell_night")).alias("order"), "cell_id", "station"))
    place = F.when(counted, F.struct((-F.col("place_n")).alias("order"), "lng", "lat"))
    # The spots of a cell are a few; a user's set of them is bounded by the table of spots.
    per_user = summed.groupBy("user_id").agg(
        F.min_by("station", F.when(leaving, F.struct((-F.col("last")).alias("order"), "cell_id"))).alias("left_from"),
        F.min(home).alias("home"), F.collect_set(place).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(F.when(counted, F.col("spots"))))).alias("spot_ids"),
        F.sum(F.when(counted & F.col("spots").isNotNull(), F.col("micro") * F.size("spots"))).alias("micro"),
    )
    at_home = F.col("home.station").isNotNull()
    named = per_user.withColumn("top", F.sort_array("places")).withColumns({
        "home_cell": F.when(at_home, F.col("home.cell_id")), "home_lng": F.col("home.station.lng"), "home_lat": F.col("home.station.lat")})
    away = F.transform("places", lambda p: distance_km(p["lng"], p["lat"], F.col("home_lng"), F.col("home_lat")))
    top = {f"{c}{i}": F.get("top", F.lit(i - 1))[c] for i in (1, 2, 3) for c in ("lng", "lat")}
    return named.select(
        "user_id",
        F.when(F.col("left_from").isNotNull(), transport_mode(F.col("left_from.lng"), F.col("left_from.lat"), max_km)).alias("transport"),
        F.when(F.array_contains("spot_ids", DUTY_FREE_SPOT), "1").alias("duty_free"),
        F.size("spot_ids").cast("bigint").alias("spots"), (F.col("micro") / MICRO).alias("hours"),
        F.array_max(away).alias("max_km"), *[c.alias(n) for n, c in top.items()], "home_cell", "home_lng", "home_lat")


def _call_features(cdr: DataFrame, users: DataFrame, residents: DataFrame) -> DataFrame:
    """Kind and call level of each visiting user. The calls are read once: pairs and days are two groupings of them."""
    ends = cdr.select(F.to_date("call_ts").alias("day"), F.inline(F.array(
        F.struct(F.col("caller").alias("user_id"), F.col("callee").alias("other")),
        F.struct(F.col("callee").alias("user_id"), F.col("caller").alias("other"))))).filter("user_id is not null")
    state = ends.groupingSets([["user_id", "other"], ["user_id", "day"]], "user_id", "other", "day").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("day").alias("pair"))
    # Rows without a contact, the days among them, are spread by their user instead of meeting in one task.
    salted = state.withColumn("salt", F.when(F.col("other").isNull(), F.xxhash64("user_id")).otherwise(F.lit(0)))
    weights = users.select(F.col("user_id").alias("other"), F.lit(0).cast("bigint").alias("salt"), "stays")
    known = F.col("pair") == 1
    per_user = salted.join(weights, ["other", "salt"], "left").groupBy("user_id").agg(
        F.count_if(known & F.col("other").isNotNull()).alias("contacts"),
        F.coalesce(F.sum(F.when(known, F.size("stays"))), F.lit(0)).alias("visitor_contacts"),
        F.avg(F.when(~known, F.col("n"))).alias("mean_calls"))
    local = residents.select("user_id").distinct().withColumn("local", F.lit(True))
    seen = users.join(per_user, "user_id", "left").join(local, "user_id", "left")
    social = (F.col("contacts") > 0) & (
        F.when(F.col("local"), F.col("visitor_contacts")).otherwise(0) >= F.col("contacts") / 2)
    stays = F.col("stays")
    bird = F.coalesce(social, F.lit(False)) | (F.array_max(stays) >= 25)
    busy = (F.col("n_short") > 0) & (F.col("mean_calls") * F.col("n_short") >= 3)
    mean = F.col("mean_calls") * F.col("n_rows")
    return seen.select(
        "user_id", F.when(bird, "bird").when(busy, "business").alias("visitor_type"),
        F.when(mean.isNotNull(), F.when(mean < 3, 1).when(mean <= 6, 2).otherwise(3)).alias("call_level"))


def visitor_profile(visitors: DataFrame, stops: DataFrame, residents: DataFrame, cdr: DataFrame, spots: DataFrame,
                    poi: DataFrame, stations: DataFrame, month: str, max_km: float = HUB_KM) -> DataFrame:
    """All features of each visitor row side by side.

    Stops, calls and resident records are read once each: the features come from one state of the
    stops and one of the calls, one row per user, and meet the visitors once. A user with two
    provinces has two rows that differ in the province.
    """
    users = visitors.groupBy("user_id").agg(
        F.collect_set("last_date").alias("last_dates"), F.collect_set("stay_days").alias("stays"),
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("stay_days") <= 7).alias("n_short"))
    features = [
        _stop_features(stop_state(stops, month), users, _cells(stations, spots), max_km),
        _call_features(cdr, users, residents),
    ]
    profile = visitors.select("user_id", "prov")
    for feature in features:
        profile = profile.join(feature, "user_id", "left")
    hotels = cell_hotel_labels(poi, stations).withColumnRenamed("cell_id", "home_cell")
    return profile.join(hotels, "home_cell", "left").fillna(PROFILE_DEFAULTS).select(
        "user_id", "prov", "transport", "visitor_type", "duty_free", "call_level", "spots", "hours", "max_km",
        *[f"{c}{i}" for i in (1, 2, 3) for c in ("lng", "lat")], "home_cell", "home_lng", "home_lat", "hotel_type")
