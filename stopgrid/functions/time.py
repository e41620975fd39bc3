"""Timetable values; times are seconds of a service day and may exceed 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopgrid import params as P


def gtfs_seconds(c: Column) -> Column:
    """``H:M:S`` as seconds; null if it is none."""
    p = F.split(F.trim(c), ":")
    v = lambda i: F.get(p, i).try_cast("double")
    return F.when(F.size(p) == 3, v(0) * 3600 + v(1) * 60 + v(2))


def stop_seconds(departure: Column, arrival: Column) -> Column:
    return F.coalesce(gtfs_seconds(departure), gtfs_seconds(arrival))


def route_type_to_mode(route_type: Column, national: bool = False) -> Column:
    """The mode of a route type: by the standard map, or as it is for the national scheme."""
    if national:
        return F.when(route_type.between(0, 7), route_type).otherwise(0)
    table = F.create_map(*[F.lit(x) for kv in P.ROUTE_TYPE_MODE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, route_type.cast("int")), F.lit(0))


def trip_weight(days: Column) -> Column:
    """The share of days a service runs; one without calendar runs daily."""
    return F.coalesce(days, F.lit(7)) / 7.0


def headway(trips: Column) -> Column:
    return P.SERVICE_MIN / F.greatest(trips, F.lit(0.25))


def headway_wait(trips: Column) -> Column:
    return F.least(F.lit(P.WAIT_CAP), headway(trips) / 2)
