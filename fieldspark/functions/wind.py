"""Winds and positions, as column expressions.  Missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eastward(speed: Column, direction: Column) -> Column:
    """Of a wind that blows from direction (degrees)."""
    return -speed * F.sin(F.radians(direction))


def northward(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def km_per_degree(lat: Column) -> tuple[Column, Column]:
    """Kilometres in a degree of latitude and of longitude, by the usual series (fixed values)."""
    r = F.radians(lat)
    north = 111.13209 - 0.56605 * F.cos(2 * r) + 0.00012 * F.cos(4 * r) - 0.000002 * F.cos(6 * r)
    east = 111.41513 * F.cos(r) - 0.09455 * F.cos(3 * r) + 0.00012 * F.cos(5 * r)
    return north, east


def offset_km(lat: Column, lon: Column, center_lat: Column, center_lon: Column) -> tuple[Column, Column]:
    """East and north distance from a center."""
    north, east = km_per_degree(center_lat)
    return (lon - center_lon) * east, (lat - center_lat) * north


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Radius, and azimuth in degrees from east, 0 to 360."""
    angle = F.degrees(F.atan2(y, x))
    return F.hypot(x, y), F.when(angle < 0, angle + 360).otherwise(angle)


def around(u: Column, v: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Radial and tangential wind at x, y from the center; NULL at the center."""
    r = F.hypot(x, y)
    return F.try_divide(u * x + v * y, r), F.try_divide(v * x - u * y, r)
