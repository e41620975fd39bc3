"""Readers over files that are written from the tables first, so that what they read can be told by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.catalog.building import feed
from stopgrid.plans.storage import scratch
from stopgrid.sources import gtfs, sinks, tables


@V.once
def _feed(spark, d):
    """The star schema's timetable as a folder of CSV files."""
    root = scratch(spark, "feed")
    for name, df in feed(spark, d).items():
        df.write.csv(f"{root}/{name}.txt", header=True)
    spark.createDataFrame([("A", "Testing")], "agency_id string, agency_name string").write.csv(f"{root}/agency.txt", header=True)
    return gtfs.open_feed(spark, root)


@query("select distinct 'S' || (s_suppkey % 8)::varchar stop_id, 'stop ' || (s_suppkey % 8)::varchar as name, round(127 + (s_suppkey % 8) * 0.01::double, 6) lon, 36.0::double lat from supplier where s_suppkey % 8 < 7")
def scan_stops(spark, d):
    return gtfs.stops(_feed(spark, d))


@query("select distinct 'R' || (o_custkey % 40)::varchar route_id, 'name ' || (o_custkey % 40)::varchar as route_short_name, ((o_custkey % 40) % 8)::varchar route_type from orders where o_custkey % 40 <> 5")
def scan_routes(spark, d):
    return _feed(spark, d)["routes"]


@query("select o_orderkey::varchar trip_id, 'R' || (o_custkey % 40)::varchar route_id, 'W' || (o_orderkey % 3)::varchar service_id from orders")
def scan_trips(spark, d):
    return _feed(spark, d)["trips"]


@query("select 'Testing' agency_name, false as national")
def scan_agency(spark, d):
    f = _feed(spark, d)
    return f["agency"].select("agency_name", F.lit(gtfs.is_national(f)).alias("national"))


@query("select * from (values ('W0', 7), ('W1', 5)) t(service_id, days)")
def scan_calendar(spark, d):
    return gtfs.service_days(_feed(spark, d))


@query("select 'S' || (l_suppkey % 8)::varchar stop_id, count(*) n, count(distinct l_orderkey) trips, sum((l_linenumber * 7 + l_orderkey % 50) * 60 + 21600)::double secs from lineitem group by 1")
def scan_stop_times(spark, d):
    from stopgrid.functions.time import stop_seconds

    st = _feed(spark, d)["stop_times"]
    sec = stop_seconds(F.col("departure_time"), F.col("arrival_time"))
    return st.groupBy("stop_id").agg(F.count("*").alias("n"), F.count_distinct("trip_id").alias("trips"), F.sum(sec).alias("secs"))


@query("select count(distinct l_orderkey) trips from lineitem")
def scan_split_trips(spark, d):
    return gtfs.split_trips(_feed(spark, d)).select("trips")


@query(f"""with x as (select l_orderkey trip, l_linenumber * 1000 + l_partkey % 1000 seq, l_suppkey % 8 k, (l_linenumber * 7 + l_orderkey % 50) * 60 sec from lineitem where l_suppkey % 8 < 7),
t as (select trip, o_custkey % 40 route, list(k order by seq, k, sec) ks, case when trip % 3 = 1 then 5 / 7.0::double else 1 end w from x join orders on o_orderkey = trip group by 1, 2, 4 having count(*) >= 2)
select 'R' || route::varchar route_id, count(*) patterns, round(sum(w), 2) trips from (select route, ks, round(sum(w), 2) w from t group by 1, 2) group by 1""")
def scan_gtfs_container(spark, d):
    """A feed from its files to patterns, summed by route."""
    p = gtfs.import_network(_feed(spark, d))["patterns"]
    # Each pattern's trips are rounded to two digits.
    return p.groupBy("route_id").agg(F.count("*").alias("patterns"), F.round(F.sum("trips"), 2).alias("trips"))


def _csv(spark, df, name, encoding="UTF-8"):
    at = scratch(spark, name)
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.coalesce(1).write.csv(at, header=True, encoding=encoding)
    return tables.read_csv(spark, at)


@query("select c_custkey::varchar id, '고객 ' || c_name as name from customer")
def scan_csv_any_encoding(spark, d):
    """A file in the older Korean encoding."""
    c = V.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("고객 "), "c_name").alias("name"))
    return _csv(spark, c, "encoded", "x-windows-949")


@query("select n_nationkey id, n_name as name from nation")
def scan_json(spark, d):
    at = scratch(spark, "json")
    sinks.write_json(V.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), at)
    return spark.read.json(at).select(F.col("id").cast("long").alias("id"), "name")


_TEN = "lpad((c_custkey % 17)::varchar, 2, '0') || lpad((c_custkey % 3)::varchar, 3, '0') || lpad((c_custkey % 1000)::varchar, 3, '0') || '00'"


def _ten():
    k = F.col("c_custkey")
    p = lambda m, n: F.lpad((k % m).cast("string"), n, "0")
    return F.concat(p(17, 2), p(3, 3), p(1000, 3), F.lit("00"))


@query(f"select code, any_value(level) as level, max(total) total, max(senior) senior from (select {_TEN} code, case when c_custkey % 1000 <> 0 then 'dong' when c_custkey % 3 <> 0 then 'sigungu' else 'sido' end as level, ((c_custkey % 1000) * 40)::double total, (c_custkey % 1000) * 10 * 0.5::double + (c_custkey % 1000) * 10 senior from customer) group by 1")
def scan_population_narrow(spark, d):
    """Bins of ten years from 50; half of the one from 60 to 69 counts."""
    k = F.col("c_custkey") % 1000
    n = lambda m: F.format_number(k * m, 0)
    c = V.read(spark, d, "customer").select(F.concat(F.lit("도 시 동 ("), _ten(), F.lit(")")).alias("행정구역"), n(40).alias("2025년06월_계_총인구수"), *[n(10).alias(f"2025년06월_계_{a}~{a + 9}세") for a in (50, 60)], n(10).alias("2025년06월_계_70세 이상"), n(99).alias("2025년06월_남_총인구수"))
    return tables.population_narrow(_csv(spark, c, "narrow")).select("code", "level", "total", "senior")


@query(f"select code, max(total) total, max(senior) senior from (select {_TEN} code, ((c_custkey % 1000) * 202)::double total, ((c_custkey % 1000) * 72)::double senior from customer) group by 1")
def scan_population_wide(spark, d):
    k = (F.col("c_custkey") % 1000).cast("string")
    c = V.read(spark, d, "customer").select(F.lit("도").alias("시도명"), F.lit("시").alias("시군구명"), F.lit("동").alias("읍면동명"), _ten().alias("행정기관코드"), *[k.alias(f"{a}세{s}") for a in range(101) for s in ("남자", "여자")])
    return tables.population_wide(_csv(spark, c, "wide")).select("code", "total", "senior")


@query("select c_custkey id, round(124.5::double + (c_custkey % 90) * 0.1::double, 6) lon, '병원' as kind from customer where c_custkey % 3 > 0 and 124.5 + (c_custkey % 90) * 0.1 <= 132.5")
def scan_facilities(spark, d):
    k = F.col("c_custkey")
    c = V.read(spark, d, "customer").select(k.cast("string").alias("요양기관명"), F.when(k % 3 > 0, "병원").otherwise("치과의원").alias("종별코드명"), F.round(124.5 + (k % 90) * 0.1, 6).cast("string").alias("좌표(X)"), F.lit("36.5").alias("좌표(Y)"))
    return tables.facilities(_csv(spark, c, "facilities")).select(F.col("name").cast("long").alias("id"), F.round("lon", 6).alias("lon"), "kind")


@query("select round(127.0::double + (c_custkey % 50) * 0.01::double, 6) lon, c_custkey::double as value from customer where c_custkey % 5 > 0")
def scan_points_optional(spark, d):
    k = F.col("c_custkey")
    c = V.read(spark, d, "customer").select(F.when(k % 5 > 0, F.round(127 + (k % 50) * 0.01, 6).cast("string")).otherwise("?").alias("lon"), F.lit("36").alias("lat"), k.cast("string").alias("value"))
    return tables.points(_csv(spark, c, "points")).select(F.round("lon", 6).alias("lon"), "value")


@query("select n_nationkey region, case when n_nationkey % 3 = 0 then n_nationkey + 0.5::double when n_nationkey % 3 = 1 then n_nationkey + 0.25::double else -1 end senior from nation")
def scan_senior_optional(spark, d):
    """A third of the regions by code, a third by names, a third not at all."""
    k = F.col("n_nationkey")
    n = V.read(spark, d, "nation")
    by = n.where("n_nationkey % 3 < 2").select(F.when(k % 3 == 0, F.lpad(k.cast("string"), 5, "1")).otherwise("").alias("sigungu_code"), F.when(k % 3 == 1, "서울특별시").otherwise("").alias("sido"), F.when(k % 3 == 1, F.concat(F.lit("구 "), "n_name")).otherwise("").alias("sigungu"), (k + F.when(k % 3 == 0, 0.5).otherwise(0.25)).cast("string").alias("senior_pct"))
    regions = n.select(k.cast("long").alias("region"), F.lpad(k.cast("string"), 5, "1").alias("code"), F.lit("서울").alias("sido"), F.concat(F.lit("구"), "n_name").alias("name"))
    codes = regions.withColumn("code", F.when(F.col("region") % 3 == 0, F.col("code")).otherwise("x"))
    return tables.senior_optional(_csv(spark, by, "senior"), codes)


@query("select 'S' || (user_id % 50)::varchar stop, cast(sum(event_id % 7 + event_id % 3) as double) n from events group by 1")
def scan_boardings(spark, d):
    e = V.read(spark, d, "events")
    c = e.select(F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string"), F.lit("("), F.col("event_id").cast("string"), F.lit(")")).alias("역명"), (F.col("event_id") % 7).cast("string").alias("00시승차총승객수"), (F.col("event_id") % 3).cast("string").alias("1시승차총승객수"), F.lit("9").alias("00시하차총승객수"))
    return tables.boardings(_csv(spark, c, "boardings", "x-windows-949"), "역명")


@query("select r_regionkey area, r_name as name, 5::bigint corners from region")
def scan_geojson(spark, d):
    k = F.col("r_regionkey").cast("double")
    ring = F.array(*[F.array(k + x, F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("r_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    all_ = V.read(spark, d, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", f.alias("f")))), lambda x: x["f"]).alias("features"))  # five regions
    at = scratch(spark, "geo")
    all_.select(F.lit("FeatureCollection").alias("type"), "features").coalesce(1).write.json(at)
    return tables.geojson(spark, at).select(F.col("area").cast("long").alias("area"), "name", F.size("ring").cast("long").alias("corners"))


@query("select c_custkey id, round_even(greatest(c_acctbal, 0) * 10, 0) / 10 as balance, [c_custkey % 5, c_custkey % 7]::varchar as pair from customer")
def scan_packed(spark, d):
    """Columns packed into numbers, gzipped, and read back."""
    k = F.col("c_custkey")
    c = V.read(spark, d, "customer").select(k.alias("id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"), F.array(k % 5, k % 7).alias("pair"))
    at = scratch(spark, "packed")
    sinks.pack(c, at, {"balance": (10.0, 1 << 31)}, "id")
    back = sinks.unpack(spark, at, "id bigint, balance double, pair array<bigint>")
    return back.select("id", "balance", F.concat(F.lit("["), F.array_join(F.transform("pair", lambda x: x.cast("string")), ", "), F.lit("]")).alias("pair"))


@query("select s_suppkey link, 2 * s_suppkey a, 2 * s_suppkey + 1 b, 5.0::double + s_suppkey m from supplier")
def scan_shapefile(spark, d):
    """Road links converted to lines of JSON."""
    k = F.col("s_suppkey").cast("double")
    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("link"), (F.col("s_suppkey") * 2).alias("f"), (F.col("s_suppkey") * 2 + 1).alias("t"), F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), 4.0 + k)).alias("xy"))
    at = scratch(spark, "shapes")
    s.write.json(at)
    return tables.converted_shapes(spark, at).select("link", "a", "b", F.round("m", 6).alias("m"))


@query("select n_regionkey k, count(*) n, sum(n_nationkey) s from nation group by 1")
def sink_chunks_merge(spark, d):
    """Work done in chunks, broken off after two of five, taken up again."""
    n = V.read(spark, d, "nation")
    at = f"{scratch(spark, 'chunks')}-{sinks.fingerprint(n, 5)}"
    make = lambda df: df.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("v"))
    for k in range(2):
        make(n.where(F.pmod(F.xxhash64("n_nationkey"), F.lit(5)) == k)).write.parquet(f"{at}/chunk={k}")
    return sinks.in_chunks(n, make, at, "n_nationkey", 5).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
