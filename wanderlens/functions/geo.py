"""Distance, transport mode and speed as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wanderlens.constants import AIRPORT, EARTH_RADIUS_KM, HUB_KM, HUBS, PORT, RAILWAY, UNKNOWN_MODE


def distance_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance; NULL when a coordinate is NULL."""
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lng = (F.radians(lng2) - F.radians(lng1)) / 2
    across = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.pow(F.sin(half_lat), 2) + across))


def transport_mode(lng: Column, lat: Column, max_km: float = HUB_KM) -> Column:
    """Mode of the nearest hub within ``max_km``; on equal distance the lower code wins."""
    port, air, rail = (
        F.least(*[distance_km(lng, lat, F.lit(x), F.lit(y)) for x, y in HUBS[kind]])
        for kind in (PORT, AIRPORT, RAILWAY)
    )
    return (
        F.when((port <= air) & (port <= rail) & (port <= max_km), PORT)
        .when((air <= rail) & (air <= max_km), AIRPORT)
        .when(rail <= max_km, RAILWAY)
        .otherwise(UNKNOWN_MODE)
    )


def speed_kmh(km: Column, seconds: Column) -> Column:
    """Speed over a distance; 0 when the distance is unknown or no time passed."""
    elapsed = F.abs(seconds)
    return F.when(km.isNull() | (elapsed == 0), 0.0).otherwise(km * 3600.0 / elapsed)
