"""Timetable feeds: a folder of CSV members, or a zip of them unpacked to the shared folder."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopgrid.functions import time
from stopgrid.plans.storage import scratch

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def unzip(path: str, root: str, piece: int = 8 << 20) -> None:
    """The text members of a zip as files of a folder, copied in pieces: no member is held whole."""
    import pyarrow.fs as pafs

    source, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    fs, to = pafs.FileSystem.from_uri(root)
    fs.create_dir(to, recursive=True)
    with source.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        for n in z.namelist():
            if n.endswith(".txt"):
                with z.open(n) as member, fs.open_output_stream(f"{to}/{n.rsplit('/', 1)[-1]}") as out:
                    while part := member.read(piece):
                        out.write(part)


def open_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All members of a feed by name, every column a string; a byte order mark is cut off."""
    if path.endswith(".zip"):
        root = scratch(spark, "feed")
        unzip(path, root)
        path = root
    found = {}
    for name in ("agency", "stops", "routes", "trips", "stop_times", "calendar"):
        try:
            df = spark.read.csv(f"{path}/{name}.txt", header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found[name] = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return found


def is_national(feed: dict[str, DataFrame]) -> bool:
    """Whether route types are already modes, told by the agency's name."""
    a = feed.get("agency")
    return a is not None and "agency_name" in a.columns and not a.where(F.contains("agency_name", F.lit("KTDB"))).isEmpty()


def service_days(feed: dict[str, DataFrame]) -> DataFrame | None:
    c = feed.get("calendar")
    return None if c is None else c.select("service_id", sum(F.coalesce(F.col(d).try_cast("int"), F.lit(0)) for d in DAYS).alias("days"))


def stops(feed: dict[str, DataFrame]) -> DataFrame:
    return feed["stops"].select("stop_id", F.coalesce("stop_name", F.lit("")).alias("name"), F.round(F.col("stop_lon").try_cast("double"), 6).alias("lon"), F.round(F.col("stop_lat").try_cast("double"), 6).alias("lat"))


def split_trips(feed: dict[str, DataFrame]) -> DataFrame:
    """One row (trips, split): trips of the stop times, and those whose rows stand in more than one run of the file.

    Readers that group neighbouring rows would take those apart; here they are
    grouped by id, so the number is only a remark on the file.
    """
    st = feed["stop_times"].select("trip_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i"))
    # Rows of one trip that lie as many places apart as they are rows stand together.
    own = st.groupBy("trip_id").agg(F.count("*").alias("n"), (F.max("i") - F.min("i") + 1).alias("span"))
    return own.agg(F.count("*").alias("trips"), F.count_if(F.col("span") > F.col("n")).alias("split"))


def import_network(feed: dict[str, DataFrame], national: bool | None = None) -> dict[str, DataFrame]:
    """stops, and patterns (pattern_id, route_id, name, mode, trips, stops, minutes).

    Trips of one route with one ordered list of known stops are one pattern;
    trips count by the share of days they run; minutes are means of the time
    since the first stop, null if none is given. Unsorted files group right.
    """
    national = is_national(feed) if national is None else national
    trips = feed["trips"].select("trip_id", "route_id", "service_id")
    days = service_days(feed)
    trips = trips.withColumn("days", F.lit(None).cast("int")) if days is None else trips.join(F.broadcast(days), "service_id", "left")
    known = stops(feed)
    st = feed["stop_times"].select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), time.stop_seconds(F.col("departure_time"), F.col("arrival_time")).alias("sec"))
    st = st.join(known.select("stop_id"), "stop_id", "left_semi").join(trips, "trip_id")
    one = st.groupBy("trip_id", "route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "sec"))).alias("x"), F.first(time.trip_weight(F.col("days"))).alias("w")).where(F.size("x") >= 2)
    one = one.withColumn("stops", F.transform("x", lambda s: s["stop_id"])).withColumn("mins", F.transform("x", lambda s: F.coalesce((s["sec"] - F.get("x", F.lit(0))["sec"]) / 60, F.lit(0.0))))
    by = one.groupBy("route_id", "stops").agg(F.round(F.sum("w"), 2).alias("trips"), F.min("trip_id").alias("first"))
    mean = one.select("route_id", "stops", F.posexplode("mins").alias("i", "m")).groupBy("route_id", "stops", "i").agg(F.round(F.avg("m"), 2).alias("m"))
    mins = mean.groupBy("route_id", "stops").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("minutes"))
    routes = feed["routes"]
    name = F.coalesce(*[F.col(c) for c in ("route_short_name", "route_long_name") if c in routes.columns], F.lit(""))
    r = routes.select("route_id", name.alias("name"), time.route_type_to_mode(F.col("route_type").try_cast("int"), national).alias("mode"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("route_id").orderBy("first"))
    out = by.join(mins, ["route_id", "stops"]).join(r, "route_id", "left").fillna({"name": "", "mode": 0})
    out = out.withColumn("pattern_id", F.concat_ws("#", "route_id", (n - 1).cast("string"))).withColumn("minutes", F.when(F.element_at("minutes", -1) > 0, F.col("minutes")))
    return {"stops": known, "patterns": out.select("pattern_id", "route_id", "name", F.col("mode").cast("string").alias("mode"), "trips", "stops", "minutes")}
