"""POI scores and hotel labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wanderlens import constants as C


def poi_total(*counts: Column) -> Column:
    """Sum of the POI counts of all categories."""
    return reduce(lambda a, b: a + b, counts)


def tf_idf(total: Column, count: Column, stays: Column, stays_with: Column) -> Column:
    """Weight of one POI category at a stay point; 1.0 where there is no POI at all."""
    share = count.cast("double") / total
    rarity = F.when(stays_with == 0, F.log(stays)).otherwise(F.log(stays.cast("double") / stays_with))
    return F.when(total == 0, 1.0).otherwise(share * rarity)


def hotel_label(name: Column, tags: Column) -> Column:
    """Labels of one hotel, ``#``-joined: by its second tag if it says something, else by its name."""
    kind = F.get(F.split(tags, ";"), F.lit(1))
    by_name = F.array_compact(
        F.array(*[
            F.when(reduce(lambda a, b: a | b, [name.contains(w) for w in words]), label)
            for label, words in C.HOTEL_NAME_LABELS
        ])
    )
    by_kind = (
        F.when(kind == C.STAR_HOTEL, "0")
        .when(kind == C.BUDGET_HOTEL, "1")
        .when((kind == C.APARTMENT_HOTEL) & name.contains(C.FAMILY_INN), "3")
        .otherwise(C.NO_LABEL)
    )
    return (
        F.when(kind.isNotNull() & (kind != C.OTHER_TAG), by_kind)
        .when(F.size(by_name) == 0, C.NO_LABEL)
        .otherwise(F.array_join(by_name, "#"))
    )


def first_tag(tags: Column) -> Column:
    return F.get(F.split(tags, ";"), F.lit(0))


def poi_class(tags: Column) -> Column:
    """One of the eight POI classes, by the first tag and, for hotels, the second."""
    first, kind = first_tag(tags), F.get(F.split(tags, ";"), F.lit(1))
    star, budget, apartment, hotel, shopping, restaurant, sight, other = C.POI_CLASSES
    hotels = (
        F.when(kind == C.STAR_HOTEL, star).when(kind == C.BUDGET_HOTEL, budget)
        .when(kind == C.APARTMENT_HOTEL, apartment).otherwise(hotel)
    )
    return (
        F.when(first == C.HOTEL_TAG, hotels).when(first == C.SHOPPING_TAG, shopping)
        .when(first == C.RESTAURANT_TAG, restaurant).when(first == C.SIGHT_TAG, sight).otherwise(other)
    )
