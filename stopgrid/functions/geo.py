"""Distances and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopgrid import params as P


def local_x(lon: Column) -> Column:
    return lon * (P.DEGREE_M * math.cos(math.radians(P.LATITUDE)))


def local_y(lat: Column) -> Column:
    return lat * P.DEGREE_M


def local_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the local plane."""
    dx, dy = local_x(lon1) - local_x(lon2), local_y(lat1) - local_y(lat2)
    return F.sqrt(dx * dx + dy * dy)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * P.EARTH_M * F.asin(F.sqrt(a))


def walk_minutes(metres: Column) -> Column:
    return metres * P.WALK_DETOUR / (P.WALK_KMH * 1000 / 60)


def grid_x(lon: Column) -> Column:
    return F.floor((lon - P.GRID_LON) / P.GRID_DEGREES)


def grid_y(lat: Column) -> Column:
    return F.floor((lat - P.GRID_LAT) / P.GRID_DEGREES)


def mercator_x(lon: Column) -> Column:
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    r = F.radians(lat)
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2


def in_bbox(lon: Column, lat: Column) -> Column:
    a, b, c, d = P.BBOX
    return lon.between(a, b) & lat.between(c, d)
