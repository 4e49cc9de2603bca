"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..defaults import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    return arc_km(a, F.cos(a), F.radians(lon1), b, F.cos(b), F.radians(lon2))


def arc_km(lat1: Column, cos1: Column, lon1: Column, lat2: Column, cos2: Column, lon2: Column) -> Column:
    """Kilometres between two points in radians, with the cosines of their latitudes."""
    lat, lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(lat * lat + cos1 * cos2 * (lon * lon), F.lit(1.0))))
