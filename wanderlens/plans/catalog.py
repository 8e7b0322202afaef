"""Every query by name, as a function of the ten input tables.

A query takes the inputs of one month and returns its result. ``whole`` inputs are not limited to
the month: the migration counts and the calls have no month filter.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wanderlens.constants import ROUTE_BANDS
from wanderlens.functions import times
from wanderlens.functions.geo import distance_km, speed_kmh, transport_mode
from wanderlens.operators import community, lodging, movement, residents, routes, social, spots, visitors
from wanderlens.sources.stored import stored


class Catalog:
    """Shared intermediate tables and the queries over them.

    Tables are lazy, but a query that uses one several times writes it when the query is asked for.
    """

    def __init__(self, inputs, month: str, whole=None):
        self.inputs, self.month, self.whole = inputs, month, whole or inputs
        self._fixed: set[str] = set()

    def fix(self, table: str) -> DataFrame:
        """Compute a shared table once; the queries asked for from now on read it from files."""
        if table not in self._fixed:
            self._fixed.add(table)
            self.__dict__[table] = stored(getattr(self, table), table)
        return self.__dict__[table]

    # --- shared tables ---

    @cached_property
    def stops(self) -> DataFrame:
        return self.inputs.visitor_stop

    @cached_property
    def local_stops(self) -> DataFrame:
        return self.whole.local_stop

    @cached_property
    def calls(self) -> DataFrame:
        return self.whole.cdr

    @cached_property
    def visitor(self) -> DataFrame:
        return visitors.detect_visitors(self.inputs.visitor_record, self.month)

    @cached_property
    def transport(self) -> DataFrame:
        return visitors.transport_out(self.visitor, self.stops, self.inputs.base_station)

    @cached_property
    def home(self) -> DataFrame:
        return visitors.visitor_home(self.visitor, self.stops, self.inputs.base_station, self.month)

    @cached_property
    def visits(self) -> DataFrame:
        return spots.spot_stops(self.stops, self.inputs.scenic_spot, self.month)

    @cached_property
    def users(self) -> DataFrame:
        return residents.resident_users(self.whole.local_record)

    @cached_property
    def circles(self) -> DataFrame:
        return social.circle_pairs(self.calls, self.inputs.user_home, self.inputs.user_work)

    @cached_property
    def migration(self) -> DataFrame:
        stops = spots.spot_stops(self.whole.visitor_stop, self.inputs.scenic_spot)
        return movement.migration_day(stops, self.visitor)

    @cached_property
    def work_arrival(self) -> DataFrame:
        return residents.work_arrival_time(self.local_stops, self.inputs.user_work)

    # --- visitors ---

    def visitor_detect(self):
        return self.visitor

    # The queries below that use the visitors more than once fix them first, so that the records
    # are scanned once.

    def transport_mode(self):
        mode = transport_mode(F.col("lng"), F.col("lat"))
        return self.whole.visitor_stop.select("user_id", "ts", "cell_id", mode.alias("mode"))

    def transport_in(self):
        self.fix("visitor")
        return visitors.transport_in(self.visitor, self.stops, self.inputs.base_station)

    def transport_out(self):
        self.fix("visitor")
        return self.transport

    def visitor_home(self):
        return self.home

    def visitor_type(self):
        self.fix("visitor")
        return visitors.visitor_type(self.visitor, self.whole.local_record, self.calls)

    def duty_free_visit(self):
        i = self.inputs
        return visitors.duty_free_visit(self.visitor, i.visitor_stop, i.scenic_spot, self.month)

    def call_strength(self):
        self.fix("visitor")
        return visitors.call_strength(self.visitor, self.calls)

    def top3_locations(self):
        return visitors.top3_locations(self.visitor, self.stops, self.month)

    def spot_visit_count(self):
        i = self.inputs
        return visitors.spot_visit_count(self.visitor, i.visitor_stop, i.scenic_spot, self.month)

    def max_dist_from_home(self):
        self.fix("visitor")
        return visitors.max_dist_from_home(self.visitor, self.stops, self.home, self.month)

    def hotel_classify(self):
        return lodging.hotel_classify(self.inputs.poi, self.inputs.base_station, self.home)

    def visitor_profile(self):
        self.fix("visitor")
        i, w = self.inputs, self.whole
        return visitors.visitor_profile(
            self.visitor, self.stops, w.local_record, self.calls, i.scenic_spot, i.poi, i.base_station, self.month
        )

    def home_place_count(self):
        return lodging.home_place_count(self.home)

    # --- spots and flows ---

    def visitor_flow_by_prov(self):
        return spots.visitor_flow_by_prov(self.inputs.visitor_record, self.visitor, self.month)

    def spot_flow_prov_month(self):
        return spots.spot_flow_prov_month(self.visits, self.visitor)

    def spot_flow_prov_day(self):
        return spots.spot_flow_prov_day(self.visits, self.visitor)

    def spot_flow_month(self):
        return spots.spot_flow_month(self.visits, self.visitor)

    def spot_flow_day_hour(self):
        return spots.spot_flow_day_hour(self.visits, self.visitor)

    def transport_by_prov(self):
        self.fix("visitor")
        return spots.transport_by_prov(self.transport, self.visitor)

    def prov_by_transport(self):
        self.fix("visitor")
        return spots.prov_by_transport(self.transport, self.visitor)

    def spot_avg_stay(self):
        return spots.spot_avg_stay(self.visits, self.visitor)

    def spot_stay_hist(self):
        return spots.spot_stay_hist(self.visits, self.visitor)

    def stay_days_hist(self):
        return spots.stay_days_hist(self.visitor)

    def daily_in_out(self):
        return spots.daily_in_out(self.visitor, self.month)

    def spot_rank(self):
        self.fix("visitor")
        self.fix("visits")
        return spots.spot_rank(self.inputs.scenic_spot, self.spot_flow_month(), self.spot_avg_stay())

    def spot_concentration(self):
        return spots.spot_concentration(self.visits, self.visitor)

    def nearest_poi_dist(self):
        return spots.nearest_poi_dist(self.inputs.scenic_spot, self.inputs.base_station, self.inputs.poi)

    # --- movement ---

    @cached_property
    def routes_of_bands(self) -> DataFrame:
        """The three bands of stay days share one mining."""
        sequences = movement.spot_sequences(self.visits, self.visitor, list(ROUTE_BANDS.values()))
        return movement.best_routes(movement.frequent_routes(sequences, len(ROUTE_BANDS)))

    def _hot_routes(self, band: str):
        return self.routes_of_bands.filter(F.col("band") == list(ROUTE_BANDS).index(band)).select("route", "freq")

    def hot_routes_short(self):
        return self._hot_routes("short")

    def hot_routes_long(self):
        return self._hot_routes("long")

    def hot_routes_deep(self):
        return self._hot_routes("deep")

    def migration_day(self):
        return self.migration

    def migration_month(self):
        return movement.migration_month(self.migration)

    # --- residents ---

    def call_records_per_user(self):
        return residents.call_records_per_user(self.users, self.calls)

    def callin_contacts(self):
        return residents.callin_contacts(self.users, self.calls)

    def callout_contacts(self):
        return residents.callout_contacts(self.users, self.calls)

    def home_left_time(self):
        return residents.home_left_time(self.local_stops, self.inputs.user_home)

    def work_left_time(self):
        return residents.work_left_time(self.local_stops, self.inputs.user_work)

    def home_left_time_all(self):
        return residents.home_left_time(self.local_stops, self.inputs.user_home, known_only=False)

    def work_left_time_all(self):
        return residents.work_left_time(self.local_stops, self.inputs.user_work, known_only=False)

    def work_arrival_time(self):
        return self.work_arrival

    def home_arrival_time(self):
        return residents.home_arrival_time(
            self.local_stops, self.inputs.user_home, self.work_left_time_all()
        )

    def life_radius(self):
        return residents.life_radius(self.local_stops, self.inputs.user_home, self.inputs.user_work)

    def _weekend_trips(self):
        i = self.inputs
        return residents.weekend_trips(self.users, self.local_stops, i.user_home, i.user_work)

    def trip_count(self):
        return self._weekend_trips().select("user_id", "trips")

    def trip_hours(self):
        return self._weekend_trips().select("user_id", "trip_hours")

    def _resident_spot_visits(self):
        return residents.resident_spot_visits(self.users, self.local_stops, self.inputs.scenic_spot)

    def resident_spots(self):
        return self._resident_spot_visits().select("user_id", "spots")

    def resident_spot_hours(self):
        return self._resident_spot_visits().select("user_id", "spot_hours")

    def commute_dist(self):
        return residents.commute_dist(self.users, self.inputs.user_home, self.inputs.user_work)

    def commute_time(self):
        return residents.commute_time(self.local_stops, self.inputs.user_home, self.inputs.user_work)

    def resident_profile(self):
        i, w = self.inputs, self.whole
        return residents.resident_profile(
            self.calls, i.scenic_spot, w.local_record, self.local_stops, i.user_home, i.user_work
        )

    def work_hours_weekday(self):
        return residents.work_hours(self.local_stops, self.inputs.user_work)

    def work_hours_weekend(self):
        return residents.work_hours(self.local_stops, self.inputs.user_work, weekend=True)

    def rank_arrival(self):
        return residents.circle_rank(self.circles, self.work_arrival, "work_arrival", more=False)

    def rank_weekday_hours(self):
        return residents.circle_rank(self.circles, self.work_hours_weekday(), "work_hours", more=True)

    def rank_weekend_hours(self):
        return residents.circle_rank(self.circles, self.work_hours_weekend(), "work_hours", more=True)

    # --- call graph ---

    def social_circle_calls(self):
        return social.social_circle_calls(self.circles)

    def call_features(self):
        return social.call_features(self.users, self.calls)

    def all_contacts(self):
        return social.all_call_features(self.users, self.calls).select("user_id", "all_contacts")

    def all_call_stats(self):
        return social.all_call_features(self.users, self.calls).select("user_id", "all_calls", "all_ms")

    def callin_stats(self):
        features = social.callin_features(self.users, self.calls)
        return features.select("user_id", "callin_calls", "callin_hours")

    def callout_stats(self):
        features = social.callout_features(self.users, self.calls)
        return features.select("user_id", "callout_calls", "callout_hours")

    def circle_features(self):
        return social.circle_features(self.users, self.circles)

    def _pairs(self, circle: str):
        return social.circle_members(self.circles, circle)

    def _count(self, circle: str):
        return self.circle_features().select("user_id", f"{circle}_count")

    def _stats(self, circle: str):
        return self.circle_features().select("user_id", f"{circle}_calls", f"{circle}_ms")

    def colleague_pairs(self):
        return self._pairs("colleague")

    def colleague_count(self):
        return self._count("colleague")

    def colleague_stats(self):
        return self._stats("colleague")

    def family_pairs(self):
        return self._pairs("family")

    def family_count(self):
        return self._count("family")

    def family_stats(self):
        return self._stats("family")

    def friend_pairs(self):
        return self._pairs("friend")

    def friend_count(self):
        return self._count("friend")

    def friend_stats(self):
        return self._stats("friend")

    def triangle_count(self):
        self.fix("users")
        return social.triangle_count(self.users, self.calls)

    def social_features(self):
        self.fix("users")
        return social.social_features(self.users, self.calls, self.inputs.user_home, self.inputs.user_work)

    def community_detection(self):
        return community.communities(social.undirected_pairs(self.calls))

    # --- routes ---

    def daily_trajectory(self):
        return routes.daily_trajectory(self.local_stops, self.inputs.user_home, self.inputs.user_work)

    def transition_weights(self):
        return routes.transition_weights(self.local_stops, self.inputs.user_home, self.inputs.user_work)

    def _best_route(self):
        return routes.best_route(self.transition_weights())

    def best_route(self):
        path = F.array_join(F.transform("path", lambda c: c.cast("string")), "#")
        return self._best_route().select("user_id", "home", "work", "weight", path.alias("path"))

    def representative_route(self):
        return routes.representative_route(self._best_route(), self.inputs.base_station)

    # --- scalar functions over whole tables ---

    def stop_speed(self):
        """Speed from the stop before, on the same day, for each moment of a visitor at a cell."""
        order = W.partitionBy("user_id", "day").orderBy("ts", "cell_id")
        moments = self.whole.visitor_stop.select("user_id", "day", "ts", "cell_id", "lng", "lat").distinct()
        legs = moments.select(
            "user_id", "ts", "cell_id", "lng", "lat",
            *[F.lag(c).over(order).alias(f"from_{c}") for c in ("ts", "lng", "lat")],
        ).filter("from_ts is not null")
        km = distance_km(F.col("from_lng"), F.col("from_lat"), F.col("lng"), F.col("lat"))
        seconds = times.seconds_apart(F.col("ts"), F.col("from_ts"))
        return legs.select("user_id", "ts", "cell_id", km.alias("km"), speed_kmh(km, seconds).alias("kmh"))

    def record_stamps(self):
        """Text, epoch and weekday forms of each record's time."""
        text = F.date_format("ts", "yyyyMMddHHmmss")
        parsed = times.parse_stamp(F.col("text"))
        return self.whole.local_record.select("user_id", text.alias("text")).select(
            "user_id", "text",
            times.epoch_millis(parsed).alias("millis"),
            times.millis_to_text(times.epoch_millis(parsed)).alias("round_trip"),
            times.is_weekday(F.to_date(parsed)).alias("weekday"),
        )

    def stay_dates(self):
        """The days of every visitor's stay."""
        days = times.days_between(F.col("first_date"), F.col("last_date"))
        return self.visitor.select("user_id", "prov", F.explode(days).alias("day"))

    def poi_tfidf(self):
        """Number of POIs and weight of each POI class at every stay point of the visitors."""
        cells = self.stops.select("cell_id").distinct()
        stay_points = lodging.station_radius(self.inputs.base_station).join(cells, "cell_id", "left_semi")
        return lodging.poi_scores(stay_points, self.inputs.poi)


QUERIES = [
    name for name, member in vars(Catalog).items()
    if callable(member) and not name.startswith("_") and name != "fix"
]
