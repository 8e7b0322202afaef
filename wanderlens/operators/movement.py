"""Movement between scenic spots: frequent routes and migration counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wanderlens.constants import ROUTE_SUPPORT
from wanderlens.operators.spots import visitor_rows
from wanderlens.sources.stored import stored

ROUTE_LENGTHS = (2, 4)
ROUTES_PER_LENGTH = 3


def spot_sequences(visits: DataFrame, visitors: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """``user_id, bands, sequence``: distinct spots of each visitor in order of first visit.

    ``bands`` has a bit for each band of stay days that the visitor has a stay in; others are left out.
    """
    bits = [F.when(F.col("stay_days").between(*band), 1 << i).otherwise(0) for i, band in enumerate(bands)]
    member = visitors.groupBy("user_id").agg(F.bit_or(sum(bits[1:], bits[0])).alias("bands")).filter("bands <> 0")
    first = visits.groupBy("user_id", "spot").agg(F.min("ts").alias("ts"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "spot")))
    return first.join(member, "user_id").groupBy("user_id", "bands").agg(
        F.transform(ordered, lambda x: x["spot"].cast("string")).alias("sequence"))


def frequent_routes(sequences: DataFrame, n_bands: int, min_support: float = ROUTE_SUPPORT) -> DataFrame:
    """``band, length, route, freq``: ordered routes that ``min_support`` of the sequences of a band hold.

    Prefixes grow by one spot a round and carry the rest of their sequence. A round counts them for
    all bands at once, and only prefixes that are frequent in some band grow on. The
    sequences and each round's frequent prefixes are stored; the projections are not.
    """
    sequences = stored(sequences, "sequences")
    in_band = [F.col("bands").bitwiseAND(1 << i) != 0 for i in range(n_bands)]
    sizes = sequences.agg(*[F.count_if(c) for c in in_band]).first()
    least = [max(1, math.ceil(min_support * n)) for n in sizes]
    enough = " or ".join(f"n{i} >= {n}" for i, n in enumerate(least))
    counts = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(in_band)]
    grown = sequences.select("bands", F.array().cast("array<string>").alias("route"), F.col("sequence").alias("rest"))
    found = []
    for length in range(1, ROUTE_LENGTHS[1] + 1):
        grown = grown.select("bands", "route", "rest", F.posexplode("rest").alias("at", "spot")).select(
            "bands", F.array_append("route", F.col("spot")).alias("route"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
        frequent = stored(grown.groupBy("route").agg(*counts).filter(enough), "routes")
        found.append(frequent.withColumn("length", F.lit(length)))
        grown = grown.join(frequent.select("route"), "route", "left_semi")
    routes = found[1]
    for longer in found[2:]:
        routes = routes.unionByName(longer)
    per_band = F.array(*[
        F.when(F.col(f"n{i}") >= n, F.struct(F.lit(i).alias("band"), F.col(f"n{i}").alias("freq"))) for i, n in enumerate(least)])
    return routes.select(F.inline(F.array_compact(per_band)), "length", F.array_join("route", "#").alias("route"))


def best_routes(frequent: DataFrame) -> DataFrame:
    """``band, route, freq`` of the three most frequent routes of each band and length from 2 to 4."""
    best = W.partitionBy("band", "length").orderBy(F.desc("freq"), "route")
    return frequent.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= ROUTES_PER_LENGTH
    ).select("band", "route", "freq")


def hot_routes(visits: DataFrame, visitors: DataFrame, min_days: int, max_days: int,
               min_support: float = ROUTE_SUPPORT) -> DataFrame:
    """The most frequent routes of one band of stay days: ``route, freq``."""
    sequences = spot_sequences(visits, visitors, [(min_days, max_days)])
    return best_routes(frequent_routes(sequences, 1, min_support)).select("route", "freq")


def migration_day(spot_stops: DataFrame, visitors: DataFrame, include_self: bool = True) -> DataFrame:
    """Users moving from one spot stop to the next on a day, per day and spot pair.

    Stops of one second at one spot are counted into one row before the join and the window; that
    bounds a user's day by its seconds. A second that counts more than one stop is a pair of the
    spot with itself.
    """
    moments = spot_stops.groupBy("day", "user_id", "ts", "spot").agg(F.count(F.lit(1)).alias("n"))
    joined = moments.join(visitor_rows(visitors), "user_id")
    order = W.partitionBy("user_id", "day").orderBy("ts", "spot")
    next_spot = F.lead("spot").over(order)
    repeated = F.col("n") * F.col("n_rows") > 1
    targets = F.array_compact(F.array(next_spot, F.when(repeated, F.col("spot"))))
    moves = joined.select("user_id", "day", F.col("spot").alias("s1"), targets.alias("targets")).select(
        "user_id", "day", "s1", F.explode("targets").alias("s2")
    )
    if not include_self:
        moves = moves.filter("s1 <> s2")
    return moves.distinct().groupBy("day", "s1", "s2").agg(F.count(F.lit(1)).alias("n"))


def migration_month(daily: DataFrame) -> DataFrame:
    """Sum of the daily moves per spot pair."""
    return daily.groupBy("s1", "s2").agg(F.sum("n").alias("n"))
