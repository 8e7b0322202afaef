"""Hotels round the lodging, visitors per lodging position, and POI scores of stay points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.constants import HOTEL_TAG, NO_LABEL, POI_CLASSES
from wanderlens.functions.scores import first_tag, hotel_label, poi_class, poi_total, tf_idf
from wanderlens.operators.spatial import within_radius

UNMATCHED = "None"


def labelled_hotels(poi: DataFrame) -> DataFrame:
    """Hotels with their label."""
    return poi.filter(first_tag(F.col("tags")) == HOTEL_TAG).select(
        "poi_id", "lng", "lat", hotel_label(F.col("name"), F.col("tags")).alias("label")
    )


def station_radius(stations: DataFrame) -> DataFrame:
    """Stations with their radius in km, 1 km if it is not known."""
    return stations.select("cell_id", "lng", "lat", F.coalesce(F.col("radius_m") / 1000, F.lit(1.0)).alias("radius_km"))


def cell_hotel_labels(poi: DataFrame, stations: DataFrame) -> DataFrame:
    """Per cell with a hotel in its radius: the labels of these hotels, sorted and pipe-joined.

    Hotels at one position with one label are counted before the spatial join, and labels per cell
    before they are written out, so no task holds the single hotels of a crowded place.
    """
    hotels = labelled_hotels(poi).groupBy("lng", "lat", "label").agg(F.countDistinct("poi_id").alias("n"))
    counts = (
        within_radius(station_radius(stations).distinct(), hotels)
        .groupBy("cell_id", "label").agg(F.sum("n").alias("n"))
    )
    written = F.when(F.col("label") != NO_LABEL, F.struct("label", F.col("n").cast("int").alias("n")))
    ordered = F.array_sort(F.collect_list(written))
    runs = F.transform("labels", lambda x: F.array_join(F.array_repeat(x["label"], x["n"]), "|"))
    return counts.groupBy("cell_id").agg(ordered.alias("labels")).select(
        "cell_id", F.array_join(runs, "|").alias("hotel_type")
    )


def hotel_classify(poi: DataFrame, stations: DataFrame, homes: DataFrame) -> DataFrame:
    """Hotel labels round each visitor's lodging cell."""
    per_cell = cell_hotel_labels(poi, stations).withColumnRenamed("cell_id", "home_cell")
    return homes.select("user_id", "home_cell").join(per_cell, "home_cell", "left").select(
        "user_id", F.coalesce("hotel_type", F.lit(UNMATCHED)).alias("hotel_type")
    )


def home_place_count(homes: DataFrame) -> DataFrame:
    """Visitors per lodging position; those without one share the NULL position."""
    return homes.select("lng", "lat", "user_id").distinct().groupBy("lng", "lat").agg(
        F.count(F.lit(1)).alias("visitors")
    )


def poi_vectors(stay_points: DataFrame, poi: DataFrame) -> DataFrame:
    """Per stay point (``cell_id, lng, lat, radius_km``) the number of POIs within its radius, a column per class.

    Equal POIs at one position are counted before the radius join, and classes per stay point before
    they are spread over the columns. A stay point without POIs has zeros.
    """
    places = poi.groupBy("lng", "lat", poi_class(F.col("tags")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    found = within_radius(stay_points, places).groupBy("cell_id", "class").agg(F.sum("n").alias("n"))
    names = [f"n_{c}" for c in POI_CLASSES]
    # One row per (cell, class): the spread copies counts and adds nothing up.
    counts = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(n) for c, n in zip(POI_CLASSES, names)]
    wide = found.groupBy("cell_id").agg(*counts)
    return stay_points.select("cell_id").distinct().join(wide, "cell_id", "left").fillna(0, names)


def poi_scores(stay_points: DataFrame, poi: DataFrame) -> DataFrame:
    """The vectors of ``poi_vectors`` with their sum and a TF-IDF score for each class; 1.0 where there is no POI."""
    vectors = poi_vectors(stay_points, poi)
    spread = vectors.agg(F.struct(
        F.count(F.lit(1)).alias("points"), *[F.count_if(F.col(f"n_{c}") > 0).alias(f"with_{c}") for c in POI_CLASSES]
    ).alias("spread")).scalar()
    total = poi_total(*[F.col(f"n_{c}") for c in POI_CLASSES])
    named = vectors.withColumn("poi_sum", total).withColumn("spread", spread)
    return named.select("cell_id", "poi_sum", *[f"n_{c}" for c in POI_CLASSES], *[
        tf_idf(F.col("poi_sum"), F.col(f"n_{c}"), F.col("spread.points"), F.col(f"spread.with_{c}")).alias(f"score_{c}")
        for c in POI_CLASSES])
