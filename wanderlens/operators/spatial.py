"""Radius and nearest-point joins as equi-joins on grid cubes.

Positions become points on the sphere in 3-D, cut into cubes. A chord is never longer than the
arc, so the cubes that a ball touches hold every point within its radius, at any latitude and
across the date line. Each centre looks at the level whose cubes are at least as wide as its ball,
which touches at most two cubes per axis; the exact distance test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderlens.constants import EARTH_RADIUS_KM
from wanderlens.functions.geo import distance_km

STEP = 4.0  # each level's cubes are this much wider than those of the level below
FINEST_KM = 0.25
LEVELS = list(range(10))  # 0.25 km to 65536 km, which covers the earth
CUBE = ["level", "ix", "iy", "iz"]
CROWD = 10_000


def _axes(lng: Column, lat: Column) -> dict[str, Column]:
    level_ring = F.cos(F.radians(lat)) * EARTH_RADIUS_KM
    return {
        "ix": level_ring * F.cos(F.radians(lng)),
        "iy": level_ring * F.sin(F.radians(lng)),
        "iz": F.sin(F.radians(lat)) * EARTH_RADIUS_KM,
    }


def _width(level: Column) -> Column:
    return F.lit(FINEST_KM) * F.pow(F.lit(STEP), level)


def _point_cubes(points: DataFrame) -> DataFrame:
    """Each point once per level, with the cube it lies in."""
    width = _width(F.col("level"))
    leveled = points.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    axes = _axes(F.col("lng"), F.col("lat"))
    return leveled.select("*", *[F.floor(v / width).alias(k) for k, v in axes.items()])


def _ball_cubes(centres: DataFrame, reach: Column) -> DataFrame:
    """Each centre with the cubes of its ``level`` that a ball of radius ``reach`` touches."""
    width = _width(F.col("level"))
    cubes = centres
    for axis, value in _axes(F.col("lng"), F.col("lat")).items():
        span = F.sequence(F.floor((value - reach) / width), F.floor((value + reach) / width))
        cubes = cubes.withColumn(axis, F.explode(span))
    return cubes


def _level_for(radius: Column) -> Column:
    level = F.ceil(F.log(F.greatest(radius * 2, F.lit(FINEST_KM)) / FINEST_KM) / F.log(F.lit(STEP)))
    return F.least(F.greatest(level, F.lit(0)), F.lit(LEVELS[-1])).cast("int")


def _slack(radius: Column) -> Column:
    """A radius a little larger, against rounding at the edge of a cube."""
    return radius * (1 + 1e-9) + 1e-6


def _dealt(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with a ``part`` of their cube, and the cubes of more than ``CROWD`` points with their number of parts.

    Points are counted per cube on the map side first, so the list of crowded cubes is short: at most one for
    each ``CROWD`` points and level.
    """
    crowded = located.groupBy(*CUBE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select(
        *CUBE, F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    columns = [c for c in located.columns if c not in CUBE]
    part = F.pmod(F.xxhash64(*columns), F.coalesce("parts", F.lit(1))).cast("int")
    return located.join(crowded, CUBE, "left").withColumn("part", part).drop("parts"), crowded


def within_radius(centres: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of a centre (``lng``, ``lat``, ``radius_km``) and a point within its radius.

    Both sides keep their columns, apart from the points' position; ``km`` is the distance.
    """
    reach = _slack(F.col("radius_km"))
    balls = _ball_cubes(
        centres.filter("lng is not null and lat is not null").withColumn("level", _level_for(reach)), reach
    )
    # Points are shuffled only at the levels that some centre looks at, at most ten.
    levels = F.broadcast(balls.select("level").distinct())
    located = _point_cubes(points.filter("lng is not null and lat is not null")).join(levels, "level", "left_semi")
    # A cube that holds many points is dealt in parts of bounded size, each of which meets the balls that touch it.
    located, crowded = _dealt(located)
    balls = balls.join(crowded, CUBE, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    located = located.withColumnsRenamed({"lng": "point_lng", "lat": "point_lat"})
    km = distance_km(F.col("lng"), F.col("lat"), F.col("point_lng"), F.col("point_lat"))
    return (
        balls.join(located, [*CUBE, "part"]).withColumn("km", km).filter(F.col("km") <= F.col("radius_km"))
        .drop(*CUBE, "part", "point_lng", "point_lat")
    )


def nearest_distance(centres: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Distance from each centre to the nearest point: ``key``, ``km``.

    One point per cube and level gives an upper bound that lies near the answer; a radius join with
    that bound as radius then finds the nearest point itself.
    """
    places = points.filter("lng is not null and lat is not null").select("lng", "lat").distinct()
    sample = _point_cubes(places).groupBy(*CUBE).agg(F.min(F.struct("lng", "lat")).alias("sample"))
    leveled = centres.select(key, "lng", "lat").distinct().withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    around = _ball_cubes(leveled, _width(F.col("level")) / 2)
    bound = distance_km(F.col("lng"), F.col("lat"), F.col("sample.lng"), F.col("sample.lat"))
    bounded = (
        around.join(sample, CUBE).groupBy(key, "lng", "lat").agg(F.min(bound).alias("bound"))
        .withColumn("radius_km", _slack(F.col("bound")))
    )
    return within_radius(bounded, places).groupBy(key).agg(F.min("km").alias("km"))
