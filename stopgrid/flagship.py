"""The flagship query: from stop times to graded patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopgrid import views as V
from stopgrid.functions.time import headway_wait
from stopgrid.operators.ranks import graded
from stopgrid.operators.sequences import patterns


def pattern_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route, stops, trips, wait, grade) for each pattern of each route."""
    p = patterns(V.st(spark, sf_dir))
    p = p.select("route", F.array_join(F.transform("stops", lambda x: x.cast("string")), ",").alias("stops"), "trips")
    p = p.withColumn("wait", F.round(headway_wait(F.col("trips").cast("double")), 5)).withColumn("l", F.round(F.log1p("trips"), 9))
    return graded(p, "l").select("route", "stops", "trips", "wait", F.col("grade").cast("int").alias("grade"))


PATTERN_GRADES_SQL = V.with_views(
    """select route, stops, trips, round(least(30.0::double, 1020.0::double / greatest(trips::double, 0.25::double) / 2), 5) wait, cast((l >= a)::int + (l >= b)::int + (l >= c)::int as int) grade
from (select *, round(ln(1 + trips), 9) l from p), (select quantile_cont(round(ln(1 + trips), 9), 0.5) a, quantile_cont(round(ln(1 + trips), 9), 0.8) b, quantile_cont(round(ln(1 + trips), 9), 0.95) c from p)""",
    "st",
).replace(") select route", "), seq as (select trip, route, string_agg(g::varchar, ',' order by pos) stops from st group by 1, 2), p as (select route, stops, count(*) trips from seq group by 1, 2) select route", 1)
