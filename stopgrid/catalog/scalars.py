"""Projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.functions import geo, score, text, time
from stopgrid.operators import sequences as S


@query("""select event_id, case when event_id % 11 = 0 then null else (cast(hour(ts) + 24 * (event_id % 2) as double)) * 3600 + minute(ts) * 60.0 + second(ts) end secs from events""")
def gtfs_seconds(spark, d):
    e = V.read(spark, d, "events")
    hms = F.concat_ws(":", (F.hour("ts") + 24 * (F.col("event_id") % 2)).cast("string"), F.minute("ts").cast("string"), F.second("ts").cast("string"))
    bad = F.when(F.col("event_id") % 11 == 0, "x:1").otherwise(hms)
    return e.select("event_id", time.gtfs_seconds(bad).alias("secs"))


_MAP = " ".join(f"when {k} then {v}" for k, v in P.ROUTE_TYPE_MODE.items())


@query(f"""select o_orderkey, cast(case cast(o_orderkey % 1300 as int) {_MAP} else 0 end as int) as mode, cast(case when o_orderkey % 10 <= 7 then o_orderkey % 10 else 0 end as int) as national from orders""")
def route_type_to_mode(spark, d):
    o = V.read(spark, d, "orders")
    return o.select("o_orderkey", time.route_type_to_mode(F.col("o_orderkey") % 1300).cast("int").alias("mode"), time.route_type_to_mode(F.col("o_orderkey") % 10, True).cast("int").alias("national"))


@query("""select o_orderkey, round(coalesce(case when o_custkey % 5 = 0 then null else o_custkey % 8 end, 7) / 7.0::double, 6) weight from orders""")
def trip_weight(spark, d):
    days = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 8)
    return V.read(spark, d, "orders").select("o_orderkey", F.round(time.trip_weight(days), 6).alias("weight"))


@query("""select p_partkey, lower(regexp_replace(p_name || ' (' || p_brand || ') [A·b]_c/d,e.f-g', '[\\s()\\[\\]·.\\-_,/]', '', 'g')) as name from part""")
def normalize_name(spark, d):
    return V.read(spark, d, "part").select("p_partkey", text.normalize_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") [A·b]_c/d,e.f-g"))).alias("name"))


_PAIR = "case when a.n_nationkey % 5 = 0 then 'NaN' when a.n_nationkey % 5 = 1 then a.n_name else a.n_name || case a.n_nationkey % 3 when 0 then ' ↔ ' when 1 then '->' else ' ~ ' end || b.n_name end"


@query(f"""with t as (select a.n_nationkey ka, b.n_nationkey kb, lower(regexp_replace({_PAIR}, '\\s+', '', 'g')) t from nation a, nation b), p as (select *, list_filter(string_split_regex(t, '↔|<->|->|→|~|-|－|>|<'), lambda x: x <> '') l from t)
select ka, kb, case when t in ('', 'nan', 'none') then '' when len(l) > 1 then array_to_string(list_sort(l), '|') else t end as key from p""")
def direction_free_key(spark, d):
    n = V.read(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("na")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("nb"))
    arrow = F.when(F.col("ka") % 3 == 0, " ↔ ").when(F.col("ka") % 3 == 1, "->").otherwise(" ~ ")
    name = F.when(F.col("ka") % 5 == 0, "NaN").when(F.col("ka") % 5 == 1, F.col("na")).otherwise(F.concat("na", arrow, "nb"))
    return a.crossJoin(F.broadcast(b)).select("ka", "kb", text.direction_free_key(name).alias("key"))  # 25 rows each


@query(V.with_views("""select g, round(lon * 111320.0 * cos(radians(36.2)), 3) x, round(lat * 111320.0, 3) y from f2_stop""", "f2_stop"))
def local_xy(spark, d):
    return V.f2_stop(spark, d).select("g", F.round(geo.local_x(F.col("lon")), 3).alias("x"), F.round(geo.local_y(F.col("lat")), 3).alias("y"))


_HOP = """select line, pat, pos, p.g, lead(p.g) over (partition by pat order by pos) nxt from f2_ps p"""
_HAV = "2 * 6371000.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"


def _hops(spark, d):
    ps = V.f2_ps(spark, d).withColumn("nxt", F.lead("g").over(Window.partitionBy("pat").orderBy("pos", "g")))
    s = V.f2_stop(spark, d)
    a, b = s.select("g", "lon", "lat"), s.select(F.col("g").alias("nxt"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return ps.join(a, "g").join(b, "nxt", "left").withColumn("m", geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))


@query(V.with_views(f"select pat, pos, round({_HAV}, 3) m, round({_HAV} * 1.25 / 75.0, 5) as walk from ({_HOP}) h join f2_stop a on a.g = h.g join f2_stop b on b.g = h.nxt", "f2_stop", "f2_ps"))
def haversine_m(spark, d):
    h = _hops(spark, d).where("m is not null")
    return h.select("pat", "pos", F.round("m", 3).alias("m"), F.round(geo.walk_minutes(F.col("m")), 5).alias("walk"))


@query(V.with_views("select a, b, round(minutes, 5) as minutes from f2_walk", "f2_walk"))
def walk_minutes(spark, d):
    return V.f2_walk(spark, d).select("a", "b", F.round("minutes", 5).alias("minutes"))


@query(V.with_views(f"""select h.pat, h.pos, round(coalesce(sum({_HAV} / 1000 * 1.30 / 20 * 60 + 0.4) over (partition by h.pat order by h.pos rows between unbounded preceding and 1 preceding), 0), 4) as minutes from ({_HOP}) h join f2_stop a on a.g = h.g left join f2_stop b on b.g = h.nxt""", "f2_stop", "f2_ps"))
def estimate_minutes(spark, d):
    leg = F.col("m") / 1000 * P.DETOUR[0] / P.SPEED_KMH[0] * 60 + P.DWELL_MIN[0]
    w = Window.partitionBy("pat").orderBy("pos", "g").rowsBetween(Window.unboundedPreceding, -1)
    # Thousands of doubles added one by one are off in the fourth place; decimals are not.
    total = F.sum(leg.cast("decimal(38,18)")).over(w).cast("double")
    return _hops(spark, d).select("pat", "pos", F.round(F.coalesce(total, F.lit(0.0)), 4).alias("minutes"))


@query(V.with_views("select trip, pos, g from st", "st"))
def collapse_sequence(spark, d):
    return V.st(spark, d).select("trip", "pos", "g")


@query(V.with_views("select distinct route, least(g, nxt) a, greatest(g, nxt) b from (select route, g, lead(g) over (partition by trip order by pos) nxt from st) where nxt is not null and g <> nxt", "st"))
def undirected_edges(spark, d):
    return S.undirected(S.edges(V.st(spark, d), "trip"), ["route"])


@query("""select o_custkey, round(1020.0::double / greatest(count(*)::double, 0.25::double), 5) headway, round(least(30.0::double, 1020.0::double / greatest(count(*)::double, 0.25::double) / 2), 5) wait from orders group by 1""")
def headway_wait(spark, d):
    t = V.read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"))
    return t.select("o_custkey", F.round(time.headway(F.col("n")), 5).alias("headway"), F.round(time.headway_wait(F.col("n")), 5).alias("wait"))


@query(V.with_views("select g, bit_or(cast(1 << mode as bigint)) mask, cast(bit_count(bit_or(cast(1 << mode as bigint))) as int) n_modes, case when bit_or(cast(1 << mode as bigint)) & 254 <> 0 then 1 else 0 end as station from f2_ps group by g", "f2_ps"))
def mode_bitmask(spark, d):
    m = V.f2_ps(spark, d).groupBy("g").agg(F.bit_or(F.expr("shiftleft(1L, cast(mode as int))")).alias("mask"))
    return m.select("g", "mask", F.bit_count("mask").alias("n_modes"), (F.col("mask").bitwiseAND(F.lit(254)) != 0).cast("int").alias("station"))


@query(V.with_views("select g from f2_ps group by g having bit_or(cast(1 << mode as bigint)) & 254 <> 0", "f2_ps"))
def is_station(spark, d):
    return mode_bitmask(spark, d).where("station = 1").select("g")


@query("""select p_partkey, round(coalesce(try_cast(replace(case when p_partkey % 9 = 0 then 'none' else cast(cast(p_retailprice as bigint) // 1000 as varchar) || ',' || lpad(cast(cast(p_retailprice as bigint) % 1000 as varchar), 3, '0') end, ',', '') as double), 0), 2) num from part""")
def num_clean(spark, d):
    k = F.rint("p_retailprice").cast("bigint")
    s = F.when(F.col("p_partkey") % 9 == 0, "none").otherwise(F.concat_ws(",", F.expr("cast(cast(rint(p_retailprice) as bigint) div 1000 as string)"), F.lpad((k % 1000).cast("string"), 3, "0")))
    return V.read(spark, d, "part").select("p_partkey", F.round(text.num_clean(s), 2).alias("num"))


_CODE = "lpad(cast(c_custkey % 17 as varchar), 2, '0') || lpad(cast(c_custkey % 3 as varchar), 3, '0') || lpad(cast(c_custkey % 4 as varchar), 3, '0') || '00'"


@query(f"select c_custkey, {_CODE} as code, case when substr({_CODE}, 6, 3) <> '000' then 'dong' when substr({_CODE}, 3, 3) <> '000' then 'sigungu' else 'sido' end as level from customer")
def admin_level(spark, d):
    p = lambda m, n: F.lpad((F.col("c_custkey") % m).cast("string"), n, "0")
    c = V.read(spark, d, "customer").select("c_custkey", F.concat(p(17, 2), p(3, 3), p(4, 3), F.lit("00")).alias("code"))
    return c.withColumn("level", text.admin_level(F.col("code")))


@query("""with b as (select p_size lo, p_size + (case when p_partkey % 2 = 0 then 4 else 9 end) hi, p_partkey, cast(p_partkey % 100 as double) n from part), c as (select lo + 30 lo, hi + 30 hi, p_partkey, n from b)
select p_partkey, round(case when lo >= 65 then n when hi >= 65 then n * (hi + 1 - 65) / (hi + 1 - lo) else 0 end, 5) senior from c""")
def senior_prorate(spark, d):
    lo = F.col("p_size") + 30
    hi = lo + F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(9)
    return V.read(spark, d, "part").select("p_partkey", F.round(score.senior_share(lo, hi, (F.col("p_partkey") % 100).cast("double")), 5).alias("senior"))


_FULL = "case when c_custkey % 2 = 0 then '서울특별시' else '경기도' end || ' 중구  ' || '운서' || cast(c_custkey % 5 as varchar) || '.동'"


@query(f"""select c_custkey, array_to_string(list_slice(string_split_regex({_FULL}, '\\s+'), 2, 99), '') as key, regexp_replace('운서' || cast(c_custkey % 5 as varchar) || '.동', '[\\d.·]|동$', '', 'g') as base, case when c_custkey % 2 = 0 then '서울' else '경기' end as sido from customer""")
def dong_key(spark, d):
    c = V.read(spark, d, "customer")
    dong = F.concat(F.lit("운서"), (F.col("c_custkey") % 5).cast("string"), F.lit(".동"))
    sido = F.when(F.col("c_custkey") % 2 == 0, "서울특별시").otherwise("경기도")
    return c.select("c_custkey", text.dong_key(F.concat(sido, F.lit(" 중구  "), dong)).alias("key"), text.split_base(dong).alias("base"), text.sido_short(sido).alias("sido"))


@query("select c_custkey, case c_custkey % 4 when 0 then '서울' when 1 then '충북' when 2 then '제주' else 'Pa' end as short from customer")
def sido_short(spark, d):
    k = F.col("c_custkey") % 4
    return V.read(spark, d, "customer").select("c_custkey", text.sido_short(F.when(k == 0, "서울특별시").when(k == 1, "충청북도").when(k == 2, "제주특별자치도").otherwise("Paris")).alias("short"))


@query(V.with_views("select g, cast(floor((lon - 124.0::double) / 0.05::double) as bigint) cx, cast(floor((lat - 33.0::double) / 0.05::double) as bigint) cy from f2_stop", "f2_stop"))
def grid_cell(spark, d):
    return V.f2_stop(spark, d).select("g", geo.grid_x(F.col("lon")).alias("cx"), geo.grid_y(F.col("lat")).alias("cy"))


@query(V.with_views("select g, round((lon + 180) / 360, 9) x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2, 9) y from f2_stop", "f2_stop"))
def mercator(spark, d):
    return V.f2_stop(spark, d).select("g", F.round(geo.mercator_x(F.col("lon")), 9).alias("x"), F.round(geo.mercator_y(F.col("lat")), 9).alias("y"))


#: Five components between 0 and 1 for each order, from its keys.
_COMP = "(o_orderkey % 101) / 100.0::double a, (o_custkey % 97) / 96.0::double b, (o_orderkey % 31) / 30.0::double c, (o_custkey % 13) / 12.0::double d, (o_orderkey % 7) / 6.0::double e"


def components(spark, d):
    o = V.read(spark, d, "orders")
    k = lambda c, m: (F.col(c) % m) / float(m - 1)
    return o.select("o_orderkey", "o_custkey", "o_totalprice", k("o_orderkey", 101).alias("a"), k("o_custkey", 97).alias("b"), k("o_orderkey", 31).alias("c"), k("o_custkey", 13).alias("d"), k("o_orderkey", 7).alias("e"))


@query(f"with t as (select o_orderkey, {_COMP} from orders) select o_orderkey, round(100 * (a * 0.30::double + b * 0.20::double + c * 0.20::double + d * 0.15::double + e * 0.15::double), 6) score from t")
def weighted_score(spark, d):
    return components(spark, d).select("o_orderkey", F.round(score.weighted_score([F.col(x) for x in "abcde"], P.LINE_WEIGHTS), 6).alias("score"))


@query(f"with t as (select o_orderkey, {_COMP} from orders) select o_orderkey, case when a >= 0.3 or b >= 0.3 then 'isolate' when c >= 0.2 then 'delay' else 'spread' end nature from t")
def line_nature(spark, d):
    return components(spark, d).select("o_orderkey", score.line_nature(F.col("a"), F.col("b"), F.col("c")).alias("nature"))


@query(f"with t as (select o_orderkey, {_COMP} from orders), w as (select o_orderkey, case when o_orderkey % 9 = 0 then null else a end a from t) select o_orderkey, cast(case when a is null or a > 0.7 then 3 when a > 0.3 then 2 when a > 0.1 then 1 else 0 end as int) grade from w")
def journey_grade(spark, d):
    return components(spark, d).select("o_orderkey", score.journey_grade(F.when(F.col("o_orderkey") % 9 != 0, F.col("a"))).alias("grade"))


@query(f"with t as (select o_orderkey, {_COMP} from orders) select o_orderkey, cast(least(greatest(round_even(100 * a * 100, 0), 0), 65535) as bigint) score100, cast(least(greatest(round_even(b * 250, 0), 0), 255) as bigint) comp250 from t")
def quantize(spark, d):
    return components(spark, d).select("o_orderkey", score.quantize(100 * F.col("a"), 100, 65535).alias("score100"), score.quantize(F.col("b"), 250, 255).alias("comp250"))


@query("select o_orderkey, case when r <= 0.01 then 'top 1%' else 'top ' || cast(cast(ceil(r * 100) as bigint) as varchar) || '%' end as label from (select o_orderkey, (o_orderkey % 1000 + 1) / 1000.0::double r from orders)")
def top_percent(spark, d):
    r = (F.col("o_orderkey") % 1000 + 1) / 1000.0
    return V.read(spark, d, "orders").select("o_orderkey", F.when(r <= 0.01, "top 1%").otherwise(F.concat(F.lit("top "), F.ceil(r * 100).cast("string"), F.lit("%"))).alias("label"))


@query("select o_orderkey, case when m < 60 then cast(m as varchar) || ' min' else cast(m // 60 as varchar) || ' h ' || cast(m % 60 as varchar) || ' min' end as label from (select o_orderkey, o_orderkey % 500 m from orders)")
def minutes_fmt(spark, d):
    o = V.read(spark, d, "orders").withColumn("m", F.col("o_orderkey") % 500)
    h = F.expr("cast(m div 60 as string)")
    return o.select("o_orderkey", F.when(F.col("m") < 60, F.concat(F.col("m").cast("string"), F.lit(" min"))).otherwise(F.concat(h, F.lit(" h "), (F.col("m") % 60).cast("string"), F.lit(" min"))).alias("label"))


#: Candidate policies: 2 frequencies and none, by 9 demand-responsive services, 2 extensions and none, without doing nothing.
_COMBOS = """f as (select * from (values (0.0), (1.5), (2.0)) t(freq)), s as (select 0 as kind, 0.0 km, 0.0 wait union all select 1, k, w from (values (3.0), (5.0), (8.0)) a(k), (values (10.0), (15.0), (20.0)) b(w) union all select 2, k, 0.0 from (values (2.0), (4.0)) a(k)),
combo as (select cast(freq as double) freq, cast(kind as int) as kind, cast(km as double) km, cast(wait as double) wait from f, s where freq > 0 or kind > 0)"""


def combos(spark):
    from stopgrid.plans.policies import CANDIDATE
    from stopgrid.plans.policies import combos as every

    return spark.createDataFrame(every(), CANDIDATE)


@query(f"with {_COMBOS} select freq, kind, km, wait, (case kind when 1 then 'DRT ' || cast(cast(km as int) as varchar) || ' km ' || cast(cast(wait as int) as varchar) || ' min' when 2 then 'extension ' || cast(cast(km as int) as varchar) || ' km' else '' end) || (case when kind > 0 and freq > 0 then ' + ' else '' end) || (case when freq > 0 then 'frequency x' || cast(cast(freq * 10 as int) as varchar) else '' end) as label from combo")
def policy_label(spark, d):
    i = lambda c: F.col(c).cast("int").cast("string")
    place = F.when(F.col("kind") == 1, F.concat(F.lit("DRT "), i("km"), F.lit(" km "), i("wait"), F.lit(" min"))).when(F.col("kind") == 2, F.concat(F.lit("extension "), i("km"), F.lit(" km"))).otherwise("")
    freq = F.when(F.col("freq") > 0, F.concat(F.lit("frequency x"), (F.col("freq") * 10).cast("int").cast("string"))).otherwise("")
    return combos(spark).withColumn("label", F.concat(place, F.when((F.col("kind") > 0) & (F.col("freq") > 0), " + ").otherwise(""), freq))


@query(f"with t as (select o_orderkey, o_totalprice, {_COMP} from orders) select o_orderkey, floor(100 * case when o_orderkey % 5 > 0 then greatest(0, o_totalprice * (a - b) + 0.5::double * (c - d) * o_totalprice) else 0 end + 0.25) / 100 benefit from t")
def benefit(spark, d):
    c = components(spark, d)
    return c.select("o_orderkey", (F.floor(100 * score.benefit(F.col("o_totalprice") * (F.col("a") - F.col("b")), F.col("c") - F.col("d"), F.col("o_totalprice"), F.col("o_orderkey") % 5 > 0) + 0.25) / 100).alias("benefit"))


@query(f"""with t as (select o_orderkey, {_COMP} from orders), v as (select *, 50 * a trips, 20 * b km, 10 + 60 * c mx, cast(o_orderkey % 4 as bigint) links from t),
w as (select *, case when links > 0 then trips * ((km + greatest(0.0::double, mx - 15) / 60 * 25 / 1.3) * 1.3 / 25 * 60) / 1020 else 0 end drt, (1 + d) * trips * ((km + km / greatest(links, 1)) / greatest(links, 1) * 1.3 / 20 * 60) / 1020 ext from v)
select o_orderkey, round(case when o_orderkey % 6 > 0 then greatest((ext * 287796660.0::double + drt * 203808700.0::double) / 1e8, 0.01::double) else 0 end, 6) as cost from w""")
def cost(spark, d):
    c = components(spark, d).withColumn("links", F.col("o_orderkey") % 4)
    trips, km = 50 * F.col("a"), 20 * F.col("b")
    drt = score.drt_vehicles(trips, km, 10 + 60 * F.col("c"), F.lit(15.0), F.col("links"))
    ext = score.extension_vehicles((1 + F.col("d")) * trips, km, F.col("links"), F.col("links"))
    return c.select("o_orderkey", F.round(score.cost_eok(ext, drt, F.col("o_orderkey") % 6 > 0), 6).alias("cost"))


@query(V.with_views("select line, round(max(trips) * max(cum) / 1020, 6) vehicles from f2_ps group by line", "f2_ps"))
def vehicles_needed(spark, d):
    return V.f2_ps(spark, d).groupBy("line").agg(F.round(score.vehicles_needed(F.max("trips"), F.max("cum")), 6).alias("vehicles"))


@query(f"""with t as (select o_orderkey, o_totalprice, {_COMP} from orders), b as (select *, o_totalprice * (0.788::double * 0.414::double) * (0.4::double + d / 10) * greatest(0.5::double, 8 * c) * 365 / 1000 base from t)
select o_orderkey, round(base * a * 0.17::double, 4) low, round((base * a + base * (1 - a) * least(1.0::double, 2 * b)) * 0.17::double, 4) mid, round((base * a + base * (1 - a) * least(1.0::double, 2 * b)) * 0.19::double, 4) high from b""")
def carbon_low_mid_high(spark, d):
    c = components(spark, d)
    low, mid, high = score.carbon(F.col("o_totalprice"), F.col("a"), 2 * F.col("b"), 8 * F.col("c"), F.lit(0.788 * 0.414), 0.4 + F.col("d") / 10, 0.17, 0.19)
    return c.select("o_orderkey", F.round(low, 4).alias("low"), F.round(mid, 4).alias("mid"), F.round(high, 4).alias("high"))


@query(V.with_views("select g from f2_stop where lon between 124.0 and 127.02 and lat between 32.5 and 39.5", "f2_stop"))
def filter_bbox(spark, d):
    return V.f2_stop(spark, d).where(geo.in_bbox(F.col("lon"), F.col("lat")) & (F.col("lon") <= 127.02)).select("g")


@query("select p_partkey from part where not regexp_matches(p_type, 'BRASS|TIN|(?i)promo')")
def filter_kinds(spark, d):
    return V.read(spark, d, "part").where(~F.col("p_type").rlike("BRASS|TIN|(?i)promo")).select("p_partkey")


@query(V.with_views("select trip, count(*) n from st group by trip having count(*) >= 4", "st"))
def filter_min_stops(spark, d):
    return V.st(spark, d).groupBy("trip").agg(F.count("*").alias("n")).where("n >= 4")


@query("with q as (select quantile_cont(o_totalprice, 0.5) a, quantile_cont(o_totalprice, 0.8) b, quantile_cont(o_totalprice, 0.95) c from orders) select o_orderkey from orders, q where (o_totalprice >= a)::int + (o_totalprice >= b)::int + (o_totalprice >= c)::int >= 2")
def filter_vulnerable(spark, d):
    from stopgrid.operators.ranks import graded

    return graded(V.read(spark, d, "orders"), "o_totalprice").where("grade >= 2").select("o_orderkey")


@query(V.with_views("""select s.g from f2_stop s join (select g, bit_or(cast(1 << mode as bigint)) mask from f2_ps group by g) m on m.g = s.g where m.mask & 5 <> 0 and s.g % 4 >= 1 and s.lon between 127.0 and 127.03 and s.lat between 36.0 and 36.02""", "f2_stop", "f2_ps"))
def filter_layer_view(spark, d):
    s = V.f2_stop(spark, d).join(mode_bitmask(spark, d), "g")
    return s.where((F.col("mask").bitwiseAND(F.lit(5)) != 0) & (F.col("g") % 4 >= 1) & F.col("lon").between(127.0, 127.03) & F.col("lat").between(36.0, 36.02)).select("g")


@query("select n_nationkey, senior from (select n_nationkey, round(100.0 * avg(case when c_custkey % 5 < 2 + n_nationkey % 2 then 1.0::double else 0 end), 6) senior from nation join customer on c_nationkey = n_nationkey group by 1) where senior >= 40")
def filter_senior_region(spark, d):
    c = V.read(spark, d, "customer")
    share = F.round(100.0 * F.avg(F.when(F.col("c_custkey") % 5 < 2 + F.col("c_nationkey") % 2, 1.0).otherwise(0.0)), 6)
    return c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(share.alias("senior")).where("senior >= 40")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'FURNITURE'))")
def filter_portfolio_rural(spark, d):
    c = V.read(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"))
    return V.read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
