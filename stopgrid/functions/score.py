"""Scores, grades, costs and roundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopgrid import params as P


def weighted_score(parts: list[Column], weights: tuple[float, ...]) -> Column:
    """0 to 100."""
    total = parts[0] * weights[0]
    for p, w in zip(parts[1:], weights[1:], strict=True):
        total = total + p * w
    return 100 * total / sum(weights)


def line_nature(disconnected: Column, no_alternative: Column, time_increase: Column) -> Column:
    return F.when((disconnected >= 0.3) | (no_alternative >= 0.3), "isolate").when(time_increase >= 0.2, "delay").otherwise("spread")


def journey_grade(worst: Column) -> Column:
    """0 to 3 by the worst relative increase; none at all is 3."""
    return F.when(worst.isNull() | (worst > 0.7), 3).when(worst > 0.3, 2).when(worst > 0.1, 1).otherwise(0)


def half_up(x: Column, digits: int = 0) -> Column:
    s = 10.0**digits
    return F.floor(x * s + 0.5) / s


def quantize(x: Column, scale: float, top: int) -> Column:
    """A value as a whole number from 0 to ``top``, halves to even."""
    return F.least(F.greatest(F.rint(x * scale), F.lit(0.0)), F.lit(float(top))).cast("bigint")


def grade(x: Column, thresholds: list[Column]) -> Column:
    """The number of thresholds at or below x."""
    return sum((t <= x).cast("int") for t in thresholds)


def benefit(stranded_change: Column, time_change: Column, affected: Column, feasible: Column) -> Column:
    return F.when(feasible, F.greatest(F.lit(0.0), stranded_change + P.BENEFIT_TIME_WEIGHT * time_change * affected)).otherwise(0.0)


def vehicles_needed(trips: Column, duration: Column) -> Column:
    return trips * duration / P.SERVICE_MIN


def drt_vehicles(trips: Column, link_km: Column, link_max_min: Column, wait_min: Column, links: Column) -> Column:
    """Vehicle years of demand-responsive service: the links' tour and the way back from the farthest."""
    back = F.greatest(F.lit(0.0), link_max_min - wait_min) / 60 * 25 / 1.3
    return F.when(links > 0, trips * ((link_km + back) * 1.3 / 25 * 60) / P.SERVICE_MIN).otherwise(0.0)


def extension_vehicles(ext_trips: Column, link_km: Column, links: Column, n_ext: Column) -> Column:
    tour = (link_km + link_km / F.greatest(links, F.lit(1))) / F.greatest(n_ext, F.lit(1))
    return ext_trips * (tour * 1.3 / 20 * 60) / P.SERVICE_MIN


def cost_eok(bus_years: Column, drt_years: Column, feasible: Column) -> Column:
    """Cost in units of 10^8; at least 0.01 if feasible."""
    c = (bus_years * P.BUS_YEAR + drt_years * P.DRT_YEAR) / 1e8
    return F.when(feasible, F.greatest(c, F.lit(0.01))).otherwise(0.0)


def carbon(affected: Column, isolated: Column, time_increase: Column, trip_km: Column, transit: Column, cars: Column, kg: float, kg_all: float, days: int = 365) -> tuple[Column, Column, Column]:
    """Tonnes a year: isolated trips only; with delayed ones; with all models' emissions."""
    base = affected * transit * cars * F.greatest(F.lit(0.5), trip_km) * days / 1000
    iso = base * isolated
    delayed = base * (1 - isolated) * F.least(F.lit(1.0), time_increase)
    return iso * kg, (iso + delayed) * kg, (iso + delayed) * kg_all


def senior_share(low: Column, high: Column, people: Column, age: int = 65) -> Column:
    """People of an age bin who are ``age`` or older, the bin taken as even."""
    return F.when(low >= age, people).when(high >= age, people * (high + 1 - age) / (high + 1 - low)).otherwise(0.0)
