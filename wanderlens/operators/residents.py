"""Residents: daily rhythm, radius, trips, spots, commute, work hours and the wide profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from wanderlens.functions.geo import distance_km
from wanderlens.functions.times import LAST_SECOND, MICRO, is_weekday, micro_hours, second_of_day
from wanderlens.operators.social import circle_members
from wanderlens.operators.spine import on_spine

EARLIEST_LEAVE = 4 * 3600
TRIP_HOURS, TRIP_KM = 6, 10


def resident_users(records: DataFrame) -> DataFrame:
    return records.select("user_id").distinct()


def _known(places: DataFrame) -> DataFrame:
    return places.filter("lng is not null and lat is not null")


def _cell_of(places: DataFrame, name: str, known_only: bool) -> DataFrame:
    """Each (user, place) once. Days are looked at for each place by itself: a user may have several."""
    kept = _known(places) if known_only else places
    return kept.select("user_id", F.col("cell_id").alias(name)).distinct()


# --- calls -------------------------------------------------------------------------------------


@on_spine(n=0)
def call_records_per_user(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Call records at either end; the other end may be unknown."""
    ends = cdr.select(F.explode(F.array("caller", "callee")).alias("user_id")).filter("user_id is not null")
    return ends.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _distinct_partners(cdr: DataFrame, user: str, partner: str) -> DataFrame:
    pairs = cdr.filter("caller is not null and callee is not null").select(
        F.col(user).alias("user_id"), F.col(partner).alias("partner")
    ).distinct()
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@on_spine(n=0)
def callin_contacts(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Distinct callers of each resident."""
    return _distinct_partners(cdr, "callee", "caller")


@on_spine(n=0)
def callout_contacts(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Distinct callees of each resident."""
    return _distinct_partners(cdr, "caller", "callee")


# --- daily rhythm ------------------------------------------------------------------------------
# Stops of a user at one cell in one second are one moment. Making them distinct first bounds a
# user's day by its seconds, so the windows below never meet an unbounded group. The join on the
# user then also serves the window over (user, day, place). Midpoints are kept as whole half seconds: means
# over whole numbers do not depend on the order in which tasks finish.


def _moments(stops: DataFrame, weekdays: bool = True) -> DataFrame:
    kept = stops.filter(is_weekday(F.col("day"))) if weekdays else stops
    return kept.select("user_id", "day", second_of_day(F.col("ts")).alias("sec"), "cell_id").distinct()


def _by_time(place: str) -> WindowSpec:
    return W.partitionBy("user_id", "day", place).orderBy("sec", "cell_id")


def _mean(per_day: DataFrame, name: str, units_per_hour: int) -> DataFrame:
    return per_day.groupBy("user_id").agg((F.avg("units") / units_per_hour).alias(name))


def home_left_time(stops: DataFrame, homes: DataFrame, known_only: bool = True) -> DataFrame:
    """Mean weekday hours after midnight of the first move away from home at 4:00 or later."""
    moments = _moments(stops).join(_cell_of(homes, "home", known_only), "user_id")
    pairs = moments.select(
        "user_id", "day", "home", "cell_id", "sec",
        F.lag("cell_id").over(_by_time("home")).alias("before_cell"),
        F.lag("sec").over(_by_time("home")).alias("before_sec"),
    )
    left_at = F.col("sec") + F.col("before_sec")
    per_day = (
        pairs.filter("before_cell = home and cell_id <> home").filter(left_at >= 2 * EARLIEST_LEAVE)
        .groupBy("user_id", "day", "home").agg(F.min(left_at).alias("units"))
    )
    return _mean(per_day, "home_left", 7200)


def work_left_time(stops: DataFrame, works: DataFrame, known_only: bool = True) -> DataFrame:
    """Mean weekday hours before 23:59:59 of leaving work: halfway to the stop after the last one there."""
    moments = _moments(stops).join(_cell_of(works, "work", known_only), "user_id")
    left_at = F.col("sec") + F.coalesce(F.lead("sec").over(_by_time("work")), F.col("sec"))
    # Of a user's moments at work on a day the last one also has the largest midpoint.
    per_day = (
        moments.withColumn("left_at", left_at).filter("cell_id = work")
        .groupBy("user_id", "day", "work").agg((2 * LAST_SECOND - F.max("left_at")).alias("units"))
        .filter("units <> 0")
    )
    return _mean(per_day, "work_left", 7200)


def work_arrival_time(stops: DataFrame, works: DataFrame, known_only: bool = False) -> DataFrame:
    """Mean weekday hours after midnight of reaching work: halfway from the stop before the first one there."""
    moments = _moments(stops).join(_cell_of(works, "work", known_only), "user_id")
    reached_at = F.col("sec") + F.coalesce(F.lag("sec").over(_by_time("work")), F.col("sec"))
    per_day = (
        moments.withColumn("reached_at", reached_at).filter("cell_id = work")
        .groupBy("user_id", "day", "work").agg(F.min("reached_at").alias("units"))
        .filter("units <> 0")
    )
    return _mean(per_day, "work_arrival", 7200)


def home_arrival_time(stops: DataFrame, homes: DataFrame, work_left: DataFrame, known_only: bool = False) -> DataFrame:
    """Mean weekday hours before 23:59:59 of the first stop at home after the user's mean time of
    leaving work; a day without one counts 0."""
    home = _cell_of(homes, "home", known_only).join(work_left, "user_id")
    to_midnight = LAST_SECOND - F.col("sec")
    after_work = F.round(to_midnight / 3600, 9) < F.round("work_left", 9)
    at_home = (F.col("cell_id") == F.col("home")) & after_work
    per_day = (
        _moments(stops).join(home, "user_id")
        .groupBy("user_id", "day", "home")
        .agg(F.coalesce(F.max(F.when(at_home, to_midnight)), F.lit(0)).alias("units"))
    )
    return _mean(per_day, "home_arrival", 3600)


# --- places ------------------------------------------------------------------------------------


def _from_home(homes: DataFrame, works: DataFrame) -> DataFrame:
    home = _known(homes).select("user_id", F.col("lng").alias("home_lng"), F.col("lat").alias("home_lat"))
    return home.join(_cell_of(works, "work", True), "user_id")


def _km_from_home() -> Column:
    return distance_km(F.col("lng"), F.col("lat"), F.col("home_lng"), F.col("home_lat"))


def life_radius(stops: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Mean over weekdays of the largest distance from home, over stops of an hour away from work."""
    places = stops.filter(is_weekday(F.col("day")) & (F.col("dur_h") >= 1)).select(
        "user_id", "day", "cell_id", "lng", "lat"
    ).distinct()
    per_day = (
        places.join(_from_home(homes, works), "user_id").filter("cell_id <> work")
        .withColumn("km", _km_from_home()).filter("km is not null")
        .groupBy("user_id", "day").agg(F.max("km").alias("km"))
    )
    return per_day.groupBy("user_id").agg(F.avg("km").alias("radius_km"))


@on_spine(trips=0, trip_hours=0.0)
def weekend_trips(users: DataFrame, stops: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Weekend stops of 6 hours, away from work and 10 km from home: number and total hours."""
    places = (
        stops.filter(~is_weekday(F.col("day")) & (F.col("dur_h") >= TRIP_HOURS))
        .groupBy("user_id", "cell_id", "lng", "lat")
        .agg(F.count(F.lit(1)).alias("n"), (F.sum(micro_hours(F.col("dur_h"))) / MICRO).alias("h"))
    )
    return (
        places.join(_from_home(homes, works), "user_id").filter("cell_id <> work")
        .filter(_km_from_home() >= TRIP_KM)
        .groupBy("user_id").agg(F.sum("n").alias("trips"), F.sum("h").alias("trip_hours"))
    )


@on_spine(spots=0, spot_hours=0.0)
def resident_spot_visits(users: DataFrame, stops: DataFrame, spots: DataFrame) -> DataFrame:
    """Distinct scenic spots of a resident and hours there."""
    per_spot = (
        stops.join(spots.select("cell_id", "scenic_id"), "cell_id")
        .groupBy("user_id", "scenic_id").agg((F.sum(micro_hours(F.col("dur_h"))) / MICRO).alias("h"))
    )
    return per_spot.groupBy("user_id").agg(F.count(F.lit(1)).alias("spots"), F.sum("h").alias("spot_hours"))


@on_spine(commute_km=0.0)
def commute_dist(users: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Distance from home to work, 0 if unknown."""
    home = _known(homes).select("user_id", F.col("lng").alias("home_lng"), F.col("lat").alias("home_lat"))
    return _known(works).join(home, "user_id").select("user_id", _km_from_home().alias("commute_km"))


def commute_time(stops: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Mean weekday hours of the ways between a home and a work place of a user, each way by itself.

    The way to work leads to the day's first moment at work that has an earlier one at home, from the
    last of these; the way home starts from the last moment at work that has a later one at home, and
    ends at the first of these. Moments in the same second are neither earlier nor later. A user with several
    homes or work places has a row for each pair; a place that is both is no commute. A way
    that was never seen is NULL, and a pair without any has no row.
    """
    pairs = _cell_of(homes, "home", False).join(_cell_of(works, "work", False), "user_id").filter("home <> work")
    day = ["user_id", "home", "work", "day"]
    at_ends = _moments(stops).join(pairs, "user_id").filter("cell_id = home or cell_id = work")
    # An as-of pairing either way: seconds at home up to the one before, and from the one after on.
    strictly = lambda *order: W.partitionBy(*day).orderBy(*order).rangeBetween(W.unboundedPreceding, -1)
    at_home = F.when(F.col("cell_id") == F.col("home"), F.col("sec"))
    paired = at_ends.withColumn("left", F.max(at_home).over(strictly("sec"))).withColumn(
        "back", F.min(at_home).over(strictly(F.desc("sec"))))
    ways = paired.filter("cell_id = work").groupBy(*day).agg(
        F.min_by(F.col("sec") - F.col("left"), F.when(F.col("left").isNotNull(), F.col("sec"))).alias("to_work"),
        F.max_by(F.col("back") - F.col("sec"), F.when(F.col("back").isNotNull(), F.col("sec"))).alias("to_home"),
    )
    return ways.filter("to_work is not null or to_home is not null").groupBy("user_id", "home", "work").agg(
        F.count("to_work").alias("days_to_work"), (F.avg("to_work") / 3600).alias("to_work_h"),
        F.count("to_home").alias("days_to_home"), (F.avg("to_home") / 3600).alias("to_home_h"),
    )


# --- work hours and the work circle ------------------------------------------------------------


def work_hours(stops: DataFrame, works: DataFrame, weekend: bool = False) -> DataFrame:
    """Mean hours per day at the work cell, over the days with a stop there."""
    wanted = ~is_weekday(F.col("day")) if weekend else is_weekday(F.col("day"))
    micro = F.sum(micro_hours(F.col("dur_h"))).alias("micro")
    per_cell = stops.filter(wanted).groupBy("user_id", "cell_id", "day").agg(micro)
    at_work = per_cell.join(works.select("user_id", "cell_id"), ["user_id", "cell_id"])
    return at_work.groupBy("user_id").agg((F.avg("micro") / MICRO).alias("work_hours"))


def circle_rank(circles: DataFrame, metric: DataFrame, value: str, more: bool) -> DataFrame:
    """Share of a user's colleagues with a larger (``more``) or smaller value than the user's own."""
    own = metric.select("user_id", F.round(value, 6).alias("own"))
    theirs = metric.select(F.col("user_id").alias("contact"), F.round(value, 6).alias("theirs"))
    pairs = circle_members(circles, "colleague").join(own, "user_id").join(theirs, "contact")
    ahead = F.col("theirs") > F.col("own") if more else F.col("theirs") < F.col("own")
    return pairs.groupBy("user_id").agg(F.avg(F.when(ahead, 1.0).otherwise(0.0)).alias("ratio"))


# --- profile -----------------------------------------------------------------------------------


def _known_places(places: DataFrame, name: str) -> DataFrame:
    """The known places of each user as an array; a user has a few."""
    rows = _known(places).select("user_id", F.struct("cell_id", "lng", "lat").alias("place"))
    return rows.groupBy("user_id").agg(F.sort_array(F.collect_list("place")).alias(name))


def stop_state(stops: DataFrame) -> DataFrame:
    """One row per (user, day, second, cell, position) from which all resident features of the stops are read:
    whether a stop lasted an hour, stops and ``micro`` hours of six hours or more, and all ``micro`` hours."""
    micro, trip = micro_hours(F.col("dur_h")), F.col("dur_h") >= TRIP_HOURS
    return stops.groupBy("user_id", "day", second_of_day(F.col("ts")).alias("sec"), "cell_id", "lng", "lat").agg(
        F.max(F.col("dur_h") >= 1).alias("long"), F.count_if(trip).alias("trips"),
        F.sum(F.when(trip, micro).otherwise(0)).alias("trip_micro"), F.sum(micro).alias("micro"))


def _stop_features(state: DataFrame, places: DataFrame, spots: DataFrame) -> DataFrame:
    """Rhythm, radius, trips and spots of each user with known ``homes`` and ``works``, in one pass.

    After the join on the user, the window and the three aggregates keep its partitioning. What comes
    before and after a moment does not depend on the place looked at, so the rows meet the user's
    places after the window.
    """
    of_cell = spots.groupBy("cell_id").agg(F.collect_list("scenic_id").alias("spot_ids"))
    near = state.join(of_cell, "cell_id", "left").join(places, "user_id")
    by_time = W.partitionBy("user_id", "day").orderBy("sec", "cell_id")
    moments = near.select(
        "*", F.lag("cell_id").over(by_time).alias("before_cell"), F.lag("sec").over(by_time).alias("before_sec"),
        F.lead("sec").over(by_time).alias("next_sec"))
    # Each home row counts for trips; each home and work cell once for the rhythm.
    cells = F.transform("homes", lambda p: p["cell_id"])
    home_cells = F.transform("homes", lambda p, i: F.struct(p.alias("at"), (F.array_position(cells, p["cell_id"]) == i + 1).alias("first")))
    work_cells = F.array_distinct(F.transform("works", lambda p: p["cell_id"]))
    pairs = moments.select("*", F.posexplode(home_cells).alias("h", "home")).drop("homes").select(
        "*", F.posexplode(work_cells).alias("w", "work")).drop("works")
    weekday, cell = is_weekday(F.col("day")), F.col("cell_id")
    at_home = F.col("home.at.cell_id")
    away = cell != F.col("work")
    km = distance_km(F.col("lng"), F.col("lat"), F.col("home.at.lng"), F.col("home.at.lat"))
    left_home = F.col("sec") + F.col("before_sec")
    left_work = F.col("sec") + F.coalesce("next_sec", "sec")
    trip = ~weekday & away & (km >= TRIP_KM)
    once = (F.col("h") == 0) & (F.col("w") == 0)
    per_place = pairs.groupBy("user_id", "day", "h", "w").agg(
        F.min(F.when(weekday & F.col("home.first") & (F.col("w") == 0) & (F.col("before_cell") == at_home) & (cell != at_home)
                     & (left_home >= 2 * EARLIEST_LEAVE), left_home)).alias("home_units"),
        (2 * LAST_SECOND - F.max(F.when(weekday & (F.col("h") == 0) & (cell == F.col("work")), left_work))).alias("work_units"),
        F.max(F.when(weekday & away & F.col("long"), km)).alias("km"),
        F.sum(F.when(trip, F.col("trips"))).alias("trips"), F.sum(F.when(trip, F.col("trip_micro"))).alias("trip_micro"),
        F.array_distinct(F.flatten(F.collect_set(F.when(once, F.col("spot_ids"))))).alias("spot_ids"),
        F.sum(F.when(once & F.col("spot_ids").isNotNull(), F.col("micro") * F.size("spot_ids"))).alias("spot_micro"))
    work_units = F.when(F.col("work_units") != 0, F.col("work_units"))
    per_day = per_place.groupBy("user_id", "day").agg(
        F.sum("home_units").alias("home_sum"), F.count("home_units").alias("home_n"),
        F.sum(work_units).alias("work_sum"), F.count(work_units).alias("work_n"), F.max("km").alias("km"),
        F.sum("trips").alias("trips"), F.sum("trip_micro").alias("trip_micro"), F.sum("spot_micro").alias("spot_micro"),
        F.array_distinct(F.flatten(F.collect_set("spot_ids"))).alias("spot_ids"))
    mean = lambda name: F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")) / 7200
    return per_day.groupBy("user_id").agg(
        mean("home").alias("home_left"), mean("work").alias("work_left"), F.avg("km").alias("radius_km"),
        F.sum("trips").alias("trips"), (F.sum("trip_micro") / MICRO).alias("trip_hours"),
        F.size(F.array_distinct(F.flatten(F.collect_set("spot_ids")))).cast("bigint").alias("spots"),
        (F.sum("spot_micro") / MICRO).alias("spot_hours"))


def _call_features(cdr: DataFrame) -> DataFrame:
    """Call records and distinct callers and callees of each user, from one state per (user, contact)."""
    ends = cdr.select(F.inline(F.array(
        F.struct(F.col("caller").alias("user_id"), F.col("callee").alias("other"), F.lit(False).alias("received")),
        F.struct(F.col("callee").alias("user_id"), F.col("caller").alias("other"), F.lit(True).alias("received"))
    ))).filter("user_id is not null")
    state = ends.groupBy("user_id", "other").agg(
        F.count(F.lit(1)).alias("n"), F.max("received").alias("called"), F.max(~F.col("received")).alias("calls"))
    known = F.col("other").isNotNull()
    return state.groupBy("user_id").agg(
        F.sum("n").alias("call_records"), F.count_if(known & F.col("called")).alias("callin_contacts"),
        F.count_if(known & F.col("calls")).alias("callout_contacts"))


def resident_profile(cdr: DataFrame, spots: DataFrame, records: DataFrame, stops: DataFrame,
                     homes: DataFrame, works: DataFrame) -> DataFrame:
    """All resident features side by side; users without one of the rhythm features drop out.

    Stops, calls and records are read once each. A user with several known homes or work places has a
    row for each pair of them.
    """
    places = _known_places(homes, "homes").join(_known_places(works, "works"), "user_id")
    features = _stop_features(stop_state(stops), places, spots).filter(
        "home_left is not null and work_left is not null and radius_km is not null")
    rows = places.join(resident_users(records), "user_id", "left_semi").join(features, "user_id")
    rows = rows.join(_call_features(cdr), "user_id", "left")
    named = rows.withColumn("home", F.explode("homes")).withColumn("work", F.explode("works"))
    at = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("home", "work") for c in ("lng", "lat")]
    commute = distance_km(F.col("home.lng"), F.col("home.lat"), F.col("work.lng"), F.col("work.lat"))
    return named.select(
        "user_id", *at, "home_left", "work_left", "radius_km", "call_records", "callin_contacts", "callout_contacts",
        "trips", "trip_hours", "spots", "spot_hours", commute.alias("commute_km")).fillna(0)
