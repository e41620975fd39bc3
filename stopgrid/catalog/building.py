"""Steps that build a network: groups, patterns, lines, people, regions; roads; queries about places."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.catalog.graph import _hops, _plane
from stopgrid.catalog.relational import _D, _PTS, _areas, _pts
from stopgrid.catalog.removals import GRADE, PARTS, STOPS, closure_sql, line_scores, lines, recursive, removal_sql, stop_scores  # noqa: F401
from stopgrid.functions import geo
from stopgrid.operators import matching as M
from stopgrid.operators import ranks as R
from stopgrid.operators import sequences as S
from stopgrid.operators import spatial as X
from stopgrid.plans import carbon as C
from stopgrid.plans import network as N
from stopgrid.plans import scores as K
from stopgrid.plans import simulation as Z
from stopgrid.plans.storage import written

#: Components by the least label, over nodes (id) and edges (a, b).
CC = """lab(id, c) using key (id) as (select id::bigint, id::bigint from nodes union
select n.id, n.c from (select e.b id, min(lab.c) c from lab join e on e.a = lab.id group by 1) n join recurring.lab q on q.id = n.id where n.c < q.c)"""


def _cc(nodes: str, edges: str, body: str = "select id, c component from lab", *more: str, views: tuple = ()) -> str:
    parts = [*more, f"nodes as ({nodes})", f"e as ({edges})", CC]
    return recursive(body, *parts, views=views) if views else f"with recursive {', '.join(parts)} {body}"


_SAME = f"select a.id a, b.id b from pts a join pts b on a.id <> b.id and a.name = b.name and {_D.format('a', 'b')} <= 100"


def _stops(spark, d):
    return _pts(spark, d).withColumnRenamed("id", "ix")


@query(_cc("select id from pts", _SAME, "select id, c component from lab", _PTS))
def cc_stop_groups(spark, d):
    return N.stop_groups(_stops(spark, d))[0].select(F.col("ix").alias("id"), F.col("g").alias("component"))


@query(_cc("select id from pts", _SAME, "select c g, round(avg(lon), 6) lon, round(avg(lat), 6) lat, count(*) stops_in_group, min(name) as name from lab join pts using (id) group by 1", _PTS))
def agg_stop_groups(spark, d):
    g = N.stop_groups(_stops(spark, d))[1]
    return g.select("g", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "stops_in_group", "name")


# ---------------------------------------------------------------- patterns and lines


def _patterns(spark, d):
    """Patterns of the grid; lines seven apart have one name, and every third pair of patterns one route."""
    ps = V.f2_ps(spark, d)
    name = F.concat(F.lit("n"), (F.col("line") % 7).cast("string"))
    return ps.select("pat", name.alias("name"), F.col("mode").cast("int").alias("mode"), "trips", F.floor(F.col("pat") / 6).cast("string").alias("route_id")).distinct()


_PE = """pe as (select distinct pat, least(g, nxt) a, greatest(g, nxt) b from (select pat, g, lead(g) over (partition by pat order by pos) nxt from f2_ps) where nxt is not null),
pn as (select *, count(*) over (partition by pat) n from pe), pt as (select distinct pat, 'n' || (line % 7)::varchar as name, mode, pat // 6 route_id from f2_ps),
en as (select pat, least(arg_min(g, pos), arg_max(g, pos)) x, greatest(arg_min(g, pos), arg_max(g, pos)) y from f2_ps group by 1),
ov as (select x.pat t1, y.pat t2, count(*) common, max(x.n) n1, max(y.n) n2 from pn x join pn y on x.a = y.a and x.b = y.b and x.pat < y.pat group by 1, 2),
lk as (select t1, t2, common, common / least(n1, n2)::double overlap, common / (n1 + n2 - common)::double jaccard, p.name = q.name and p.mode = q.mode same, p.mode = q.mode and e1.x = e2.x and e1.y = e2.y ends from ov join pt p on p.pat = t1 join pt q on q.pat = t2 join en e1 on e1.pat = t1 join en e2 on e2.pat = t2)"""


def _blocks(spark, d):
    p = _patterns(spark, d).select("pat", F.concat_ws("/", "mode", "name").alias("block"))
    return M.overlaps(S.undirected(S.edges(V.f2_ps(spark, d).select("pat", "pos", "g"), "pat").join(p, "pat"), ["pat", "block"]), "pat", "block", P.SAME_NAME_OVERLAP)


@query(recursive("select t1, t2, common, round(overlap, 6) overlap, round(jaccard, 6) jaccard from lk where same and overlap >= 0.5", _PE, views=("f2_ps",)))
def join_same_key_overlap(spark, d):
    return _blocks(spark, d).select("t1", "t2", "common", F.round("overlap", 6).alias("overlap"), F.round("jaccard", 6).alias("jaccard"))


@query(recursive("select t1, t2, round(jaccard, 6) jaccard from lk where ends and jaccard >= 0.95", _PE, views=("f2_ps",)))
def edge_set_overlap(spark, d):
    ps = V.f2_ps(spark, d)
    ends = S.ends(ps, "pat", F.first("mode").alias("m")).select("pat", F.concat_ws("/", "m", F.least("x", "y"), F.greatest("x", "y")).alias("block"))
    e = S.undirected(S.edges(ps.select("pat", "pos", "g"), "pat").join(ends, "pat"), ["pat", "block"])
    return M.overlaps(e, "pat", "block", 0.0).where(F.col("jaccard") >= P.ANY_NAME_JACCARD).select("t1", "t2", F.round("jaccard", 6).alias("jaccard"))


@query(_cc("select pat id from pt", "select t1 a, t2 b from ln union all select t2, t1 from ln", "select id pat, c line from lab", _PE, "ln as (select t1, t2 from lk where (same and overlap >= 0.5) or (ends and jaccard >= 0.95) union select p.pat, q.pat from pt p join pt q on p.route_id = q.route_id and p.pat < q.pat)", views=("f2_ps",)))
def cc_lines(spark, d):
    return N.line_of_patterns(_patterns(spark, d), V.f2_ps(spark, d).select("pat", "pos", "g"))


@query(V.with_views("select line, g a, nxt b, sum(trips) freq from (select line, trips, g, lead(g) over (partition by pat order by pos) nxt from f2_ps) where nxt is not null group by 1, 2, 3", "f2_ps"))
def agg_edge_frequency(spark, d):
    return N.edge_frequency(V.f2_ps(spark, d))


#: The F1 view's lines: a route's trips as patterns of the groups, with trips of one each.
_ROUTE = "e as (select route, trip, g a, nxt b from (select route, trip, g, lead(g) over (partition by trip order by pos) nxt from st) where nxt is not null), fr as (select route, a, b, count(*) freq from e group by 1, 2, 3)"


@query(V.with_views("select trip pat, greatest(median(freq), 1) eff_trips, round(least(30.0::double, 1020.0::double / greatest(greatest(median(freq), 1), 0.25::double) / 2), 2) wait from (select distinct route, trip, a, b from e) join fr using (route, a, b) group by 1", "st").replace(") select trip pat", f"), {_ROUTE} select trip pat", 1))
def pattern_waits(spark, d):
    """How often the line rides a trip's edges, and the wait."""
    return N.waits(V.st(spark, d).select(F.col("route").alias("line"), F.col("trip").alias("pat"), "pos", "g", F.lit(1.0).alias("trips")))


def feed(spark, d):
    """A timetable made of the star schema: orders run over the suppliers' classes, on routes of customers."""
    l, o, s = V.read(spark, d, "lineitem"), V.read(spark, d, "orders"), V.read(spark, d, "supplier")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minute = F.col("l_linenumber") * 7 + F.col("l_orderkey") % 50
    at = F.concat_ws(":", two(F.floor(minute / 60) + 6), two(minute % 60), F.lit("00"))
    return {
        "stops": s.select((F.col("s_suppkey") % 8).alias("k")).distinct().where("k < 7").select(F.concat(F.lit("S"), "k").alias("stop_id"), F.concat(F.lit("stop "), "k").alias("stop_name"), (127 + F.col("k") * 0.01).cast("string").alias("stop_lon"), F.lit("36.0").alias("stop_lat")),
        "routes": o.select((F.col("o_custkey") % 40).alias("k")).distinct().where("k <> 5").select(F.concat(F.lit("R"), "k").alias("route_id"), F.concat(F.lit("name "), "k").alias("route_short_name"), (F.col("k") % 8).cast("string").alias("route_type")),
        "trips": o.select(F.col("o_orderkey").cast("string").alias("trip_id"), F.concat(F.lit("R"), F.col("o_custkey") % 40).alias("route_id"), F.concat(F.lit("W"), F.col("o_orderkey") % 3).alias("service_id")),
        "calendar": spark.createDataFrame([("W0", *"1111111"), ("W1", *"1111100")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string"),
        "stop_times": l.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.concat(F.lit("S"), F.col("l_suppkey") % 8).alias("stop_id"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).cast("string").alias("stop_sequence"), at.alias("departure_time"), at.alias("arrival_time")),
    }


_FEED = """x as (select l_orderkey trip, l_linenumber * 1000 + l_partkey % 1000 seq, l_suppkey % 8 k, (l_linenumber * 7 + l_orderkey % 50) * 60 + 21600 sec from lineitem where l_suppkey % 8 < 7),
t as (select trip, o_custkey % 40 route, list(k order by seq, k, sec) ks, list(sec order by seq, k, sec) secs, case when trip % 3 = 1 then 5 / 7.0::double else 1 end w from x join orders on o_orderkey = trip group by 1, 2, 5 having count(*) >= 2),
p as (select route, ks, round(sum(w), 2) trips, min(trip::varchar) first from t group by 1, 2),
m as (select route, ks, i, round(avg((secs[i] - secs[1]) / 60.0::double), 2) m from t, range(1, 20) r(i) where i <= len(ks) group by 1, 2, 3)"""


@query(f"with {_FEED} select 'R' || route::varchar route_id, array_to_string(list_transform(ks, lambda k: 'S' || k::varchar), ',') stops, trips, case when route = 5 then '' else 'name ' || route::varchar end as name, (case when route = 5 then 0 else [1, 1, 4, 0, 2, 1, 1, 1][route % 8 + 1] end)::varchar as mode, (select round(sum(m), 2) from m where m.route = p.route and m.ks = p.ks) as minutes from p")
def agg_patterns(spark, d):
    """Patterns of a timetable with their trips and mean minutes, here summed."""
    from stopgrid.sources.gtfs import import_network

    p = import_network(feed(spark, d))["patterns"]
    total = F.round(F.aggregate(F.coalesce("minutes", F.array(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x), 2)
    return p.select("route_id", F.array_join("stops", ",").alias("stops"), "trips", "name", "mode", total.alias("minutes"))


@query(V.with_views("select g, count(distinct line) n_lines, cast(bit_or(cast(1 << mode as bigint)) as bigint) modes from f2_ps group by g", "f2_ps"))
def agg_group_service(spark, d):
    return N.group_service(V.f2_ps(spark, d))


@query(recursive("select g, trips from ts", {"lg": PARTS["lg"], "ts": STOPS["ts"]}))
def agg_stop_trips_by_line(spark, d):
    return K.stop_trips(V.f2_net(spark, d), lines(spark, d))


@query(recursive("select p.line, case when count(distinct n.n_regionkey) > 3 then array_to_string(list_slice(list(r_name order by f, n.n_regionkey), 1, 3), '·') || ' +' else array_to_string(list(r_name order by f, n.n_regionkey), '·') end as label from (select line, n_regionkey, min(pos) f from (select * from f2_ps join nn using (line, pat) where r = 1) join f2_stop using (g) join nation on n_nationkey = region group by 1, 2) p join region on r_regionkey = n_regionkey join (select distinct n_regionkey from nation) n on n.n_regionkey = p.n_regionkey group by 1", {"nn": PARTS["nn"]}))
def line_area_label(spark, d):
    """The areas along a line's main pattern, each where it first comes; of more than three the first three."""
    n = V.read(spark, d, "nation").join(V.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("region"), "n_regionkey", "r_name")
    ps = V.f2_ps(spark, d)
    main = R.top_per(ps.groupBy("line", "pat").agg(F.max("pos").alias("n")), ["line"], [F.desc("n"), "pat"], 1).select("pat")
    at = ps.join(main, "pat", "left_semi").join(V.f2_stop(spark, d).select("g", "region"), "g").join(F.broadcast(n), "region")  # 25 nations
    first = at.groupBy("line", "n_regionkey", "r_name").agg(F.min("pos").alias("f"))
    l = first.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "n_regionkey", "r_name"))), lambda x: x["r_name"]).alias("l"))
    return l.select("line", F.when(F.size("l") > 3, F.concat(F.array_join(F.slice("l", 1, 3), "·"), F.lit(" +"))).otherwise(F.array_join("l", "·")).alias("label"))


# ---------------------------------------------------------------- people and places


@query(recursive(f"select f2.g, case when st then 1.0::double else 0 end + coalesce(n, 0) dest, coalesce(n, 0) hosp_near from (select g, bool_or(mode >= 1) st from f2_ps group by 1) f2 left join (select g, count(*) n from (select g, row_number() over (partition by id order by m, g) r from (select p.id, s.g, {_D.format('p', 's')} m from pts p join f2_stop s on {_D.format('p', 's')} <= 500)) where r = 1 group by g) z using (g)", _PTS))
def join_facility_nearest_500m(spark, d):
    net = V.f2_net(spark, d)
    service = N.group_service(net.stops)
    return N.destinations(service, net.groups.join(service, "g", "left_semi"), _pts(spark, d).select("lon", "lat")).select("g", "dest", "hosp_near")


_SERVED = f"srv as (select id, g from (select p.id, s.g, row_number() over (partition by p.id order by {_D.format('p', 's')}, s.g) r from pts p join f2_stop s on {_D.format('p', 's')} <= 800) where r = 1)"


@query(recursive("select g, cast(coalesce(sum(id % 10), 0) as double) pop from f2_stop left join srv using (g) group by 1", _PTS, _SERVED))
def join_popgrid_nearest_800m(spark, d):
    p = _pts(spark, d).select("lon", "lat", (F.col("id") % 10).cast("double").alias("value"))
    return N.population_by_grid(V.f2_stop(spark, d).select("g", "lon", "lat"), p)[0]


@query(recursive("select round(lon, 5) lon, round(lat, 5) lat, count(*) n, sum(id % 10)::double people from pts where id not in (select id from srv) and id % 10 > 0 group by 1, 2", _PTS, _SERVED))
def unserved_people(spark, d):
    p = _pts(spark, d).select("lon", "lat", (F.col("id") % 10).cast("double").alias("value"))
    lost = N.population_by_grid(V.f2_stop(spark, d).select("g", "lon", "lat"), p)[1]
    return lost.groupBy("lon", "lat").agg(F.count("*").alias("n"), F.sum("people").alias("people"))


_RECT = "areas as (select r_regionkey area, 127.0::double + r_regionkey * 0.008 x0, 127.008::double + r_regionkey * 0.008 x1 from region)"
_OUT = "power(greatest(x0 - (s.lon + 0.001), 0, s.lon + 0.001 - x1), 2) + power(greatest(35.99 - (s.lat + 0.0003), 0, s.lat + 0.0003 - 36.03), 2)"


@query(recursive(f"select g, area from (select s.g, a.area, row_number() over (partition by s.g order by round(sqrt({_OUT}), 9), a.area) k from f2_stop s, areas a) where k = 1", _RECT, views=("f2_stop",)))
def join_point_in_polygon(spark, d):
    """Groups in rectangles, those outside of all in the nearest."""
    s = V.f2_stop(spark, d).select("g", (F.col("lon") + 0.001).alias("lon"), (F.col("lat") + 0.0003).alias("lat"))
    return X.locate(s, _areas(spark, d), 0.01, nearest=True).select("g", "area")


_NAME = "case {0} % 3 when 0 then '서울특별시' when 1 then '경기도' else '강원특별자치도' end || ' 구' || ({0} % {1})::varchar || ' '"
_DONG = f"""b as (select c_custkey ix, c_custkey code, {_NAME.format('c_custkey', 17)} || '동네' || (c_custkey % 901)::varchar || case when c_custkey % 4 = 0 then '동' else '리' end as name from customer),
p as (select s_suppkey pid, case when s_suppkey % 5 = 0 then s_suppkey * 3 else 1000000 + s_suppkey end code, case when s_suppkey % 5 = 4 then {_NAME.format('(s_suppkey * 7)', 17)} || '동네' || (s_suppkey * 7 % 901)::varchar || '-' || s_suppkey::varchar else {_NAME.format('(s_suppkey * 7)', '(17 - s_suppkey % 2)')} || '동네' || (s_suppkey * 7 % 901)::varchar || case when (s_suppkey * 7) % 4 = 0 then '동' else '리' end end as name, (s_suppkey % 90 + 10)::double total, (s_suppkey % 10)::double senior from supplier),
a as (select ix, code, replace(name[strpos(name, ' ') + 1:], ' ', '') k2, name[1:2] || '|' || string_split(name, ' ')[3] k3, name[1:2] sido, regexp_replace(regexp_replace(string_split(name, ' ')[3], '[\\d.·]+|동$', '', 'g'), '동+$', '') base from b),
q as (select pid, code, total, senior, replace(name[strpos(name, ' ') + 1:], ' ', '') k2, name[1:2] || '|' || string_split(name, ' ')[3] k3, name[1:2] sido, string_split(name, ' ')[3] last from p),
t1 as (select ix, pid from a join q using (code)), a2 as (select * from a where ix not in (select ix from t1)), q2 as (select *, count(*) over (partition by k2) n from q where pid not in (select pid from t1)),
t2 as (select ix, pid from a2 join q2 using (k2) where n = 1),
q3 as (select *, count(*) over (partition by k3) n3 from q2 where k2 not in (select k2 from a where ix in (select ix from t1 union select ix from t2))),
a3 as (select * from (select *, count(*) over (partition by k3) n from a) where n = 1 and ix not in (select ix from t1 union select ix from t2)),
t3 as (select a3.ix, q3.pid from a3 join q3 using (k3) where n3 = 1),
d3 as (select ix, pid from t1 union all select ix, pid from t2 union all select ix, pid from t3),
t4 as (select min(a.ix) ix, q.pid from a join q on q.sido = a.sido and starts_with(q.last, a.base) where length(a.base) >= 2 and a.ix not in (select ix from d3) and q.pid not in (select pid from d3) group by 2),
every as (select *, 'code' as tier from t1 union all select *, 'name' from t2 union all select *, 'sido' from t3 union all select *, 'split' from t4)"""


def _regions(spark, d):
    name = lambda k, m: F.concat(F.when(k % 3 == 0, "서울특별시").when(k % 3 == 1, "경기도").otherwise("강원특별자치도"), F.lit(" 구"), (k % m).cast("string"), F.lit(" "))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    end = lambda k: F.when(k % 4 == 0, "동").otherwise("리")
    dong = lambda k: F.concat(F.lit("동네"), (k % 901).cast("string"))
    areas = V.read(spark, d, "customer").select(c.alias("ix"), c.cast("string").alias("code"), F.concat(name(c, 17), dong(c), end(c)).alias("name"))
    k = s * 7
    divided = F.concat(name(k, 17), dong(k), F.lit("-"), s.cast("string"))
    whole = F.concat(name(k, 17 - s % 2), dong(k), end(k))
    people = V.read(spark, d, "supplier").select(F.when(s % 5 == 0, s * 3).otherwise(1000000 + s).cast("string").alias("code"), F.when(s % 5 == 4, divided).otherwise(whole).alias("name"), (s % 90 + 10).cast("double").alias("total"), (s % 10).cast("double").alias("senior"))
    return areas, people


@query(f"with {_DONG} select ix, tier, sum(total) people, sum(senior) senior, count(*) as rows from every join p using (pid) group by 1, 2 union all select ix, 'none', null, null, 0 from b where ix not in (select ix from every)")
def join_dong_cascade(spark, d):
    return M.match_regions(*_regions(spark, d))


@query(f"with {_DONG} select code from p where code not in (select code from b)")
def except_used_rows(spark, d):
    """Rows of people that no area's code uses up."""
    areas, people = _regions(spark, d)
    return people.select("code").join(areas.select("code"), "code", "left_anti").select(F.col("code").cast("long").alias("code"))


@query(recursive(f"select g, round(coalesce(total / n, 0), 4) pop from (select g, area, count(*) over (partition by area) n from (select s.g, a.area, row_number() over (partition by s.g order by round(sqrt({_OUT}), 9), a.area) k from f2_stop s, areas a) where k = 1) left join (select n_regionkey area, sum(greatest(0, c_acctbal)) total from customer join nation on n_nationkey = c_nationkey group by 1) using (area)", _RECT, views=("f2_stop",)))
def agg_population_share(spark, d):
    """An area's people shared by the groups in it."""
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    people = V.read(spark, d, "customer").join(n, "c_nationkey").groupBy(F.col("n_regionkey").cast("string").alias("code")).agg(F.sum(F.greatest(F.lit(0.0), "c_acctbal")).alias("total")).select("code", F.concat(F.lit("x y"), "code").alias("name"), "total", F.lit(0.0).alias("senior"))
    areas = _areas(spark, d).withColumn("code", F.col("area").cast("string")).withColumn("name", F.concat(F.lit("x y"), "code"))
    s = V.f2_stop(spark, d).select("g", (F.col("lon") + 0.001).alias("lon"), (F.col("lat") + 0.0003).alias("lat"))
    return N.population_by_area(s, areas, people)[0].select("g", F.round("pop", 4).alias("pop"))


@query("with r as (select n_nationkey, n_regionkey from nation), a as (select c_nationkey k, count(*) n, sum(case when c_custkey % 5 = 0 then 1 else 0 end) s from customer where c_nationkey % 3 > 0 group by 1), b as (select n_regionkey q, sum(a.n) n, sum(a.s) s from a join r on r.n_nationkey = a.k group by 1) select n_nationkey, round(coalesce(100.0::double * a.s / a.n, 100.0::double * b.s / b.n, -1), 6) senior, case when a.k is not null then 'fine' when b.q is not null then 'coarse' else 'none' end as source from r left join a on a.k = n_nationkey left join b on b.q = n_regionkey")
def agg_coarse_senior(spark, d):
    from stopgrid.sources.tables import coarse_senior

    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").alias("parent"))
    c = V.read(spark, d, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("region")).agg(F.count("*").cast("double").alias("total"), F.sum((F.col("c_custkey") % 5 == 0).cast("double")).alias("senior"))
    coarse = c.join(n, "region").groupBy("parent").agg(F.sum("total").alias("total"), F.sum("senior").alias("senior"))
    return coarse_senior(n, c, coarse).select(F.col("region").alias("n_nationkey"), F.round("senior", 6).alias("senior"), "source")


@query("select count(*) count, count(*) filter (where p_type not like '%TIN%') hospitals, count(*) filter (where p_type like '%TIN%') pharmacies from part where not regexp_matches(p_type, 'BRASS')")
def agg_facility_stats(spark, d):
    from stopgrid.sources.tables import facility_stats, without_kinds

    f = V.read(spark, d, "part").select(F.col("p_type").alias("kind"))
    return facility_stats(without_kinds(f, "BRASS"), "TIN")


@query("with c as (select n_regionkey r, sum(c_acctbal) cars, count(*)::double people from customer join nation on n_nationkey = c_nationkey group by 1), k as (select ['서울특별시', '부산광역시', '경기도', '충청북도', '전남광주통합특별시'][r + 1] as name, * from c), s as (select ['서울', '부산', '경기', '충북'][r + 1] sido, cars / people cars from k where r < 4) select sido, round(cars, 6) cars from s union all select '전남광주', round((select sum(cars) - sum(cars) filter (where r < 4) from k) / (select sum(people) - sum(people) filter (where r < 4) from k), 6) union all select '', round(sum(cars) / sum(people), 6) from k")
def agg_carbon_inputs(spark, d):
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = V.read(spark, d, "customer").join(n, "c_nationkey").groupBy("n_regionkey").agg(F.sum("c_acctbal").alias("cars"), F.count("*").cast("double").alias("people"))
    names = F.array(*[F.lit(x) for x in ("서울특별시", "부산광역시", "경기도", "충청북도", "전남광주통합특별시")])
    own = c.select(names[F.col("n_regionkey").cast("int")].alias("name"), F.when(F.col("n_regionkey") < 4, F.col("cars")).alias("cars"), "people")
    whole = c.agg(F.lit(P.COUNTRY).alias("name"), F.sum("cars").alias("cars"), F.sum("people").alias("people"))
    return C.cars_per_person(own.unionByName(whole)).select("sido", F.round("cars", 6).alias("cars"))


@query("select round(avg(p_retailprice) filter (where p_brand in ('Brand#11', 'Brand#12')) / 1000, 6) kg, round(avg(p_retailprice) / 1000, 6) kg_all, count(*) filter (where p_brand in ('Brand#11', 'Brand#12')) n, count(*) n_all from part")
def carbon_emissions(spark, d):
    p = V.read(spark, d, "part").select(F.col("p_brand").alias("maker"), F.col("p_retailprice").alias("co2"))
    return C.emissions(p, ("Brand#11", "Brand#12")).select(F.round("kg", 6).alias("kg"), F.round("kg_all", 6).alias("kg_all"), "n", "n_all")


_MIDS = "4.5 * count(*) filter (where c_custkey % 5 = 0) + 8.0 * count(*) filter (where c_custkey % 5 = 1) + 13.0 * count(*) filter (where c_custkey % 5 = 2) + 18.0 * count(*) filter (where c_custkey % 5 = 3) + 23.0 * count(*) filter (where c_custkey % 5 = 4)"


@query(f"select c_mktsegment as name, round((({_MIDS}) / count(*))::double / (select (({_MIDS}) / count(*))::double from customer), 6) relative from customer group by 1")
def agg_weighted_usage(spark, d):
    c = V.read(spark, d, "customer")
    shares = [F.count_if(F.col("c_custkey") % 5 == k).cast("double").alias(f"s{k}") for k in range(5)]
    x = c.groupBy(F.col("c_mktsegment").alias("name")).agg(*shares).unionByName(c.agg(F.lit("전체").alias("name"), *shares))
    return C.relative_usage(x, [f"s{k}" for k in range(5)]).select("name", F.round("relative", 6).alias("relative"))


@query("with t as (select c_custkey, c_nationkey code5, case when c_custkey % 7 < 5 then c_custkey % 7 end as dst from customer), m as (select code5, dst, row_number() over (partition by code5 order by count(*) desc, dst) r from t where dst is not null group by 1, 2) select c_custkey, coalesce(t.dst, m.dst) as dst from t left join m on m.code5 = t.code5 and m.r = 1")
def region_reassign_majority(spark, d):
    k = F.col("c_custkey")
    c = V.read(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("old"), F.when(k % 7 < 5, k % 7).alias("new"))
    return M.reassigned(c).select(F.col("id").alias("c_custkey"), F.col("new").alias("dst"))


@query("select n_regionkey parent, count(*) parts, string_agg(n_nationkey::varchar, ',' order by n_nationkey) members, count(*) * 4 corners from nation group by 1")
def dissolve_polygons(spark, d):
    n, k = V.read(spark, d, "nation"), F.col("n_nationkey")
    corner = lambda x, y: F.struct((k + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    areas = n.select(k.alias("area"), F.col("n_regionkey").alias("parent"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    out = X.dissolve(areas)
    corners = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r)).cast("long")
    return out.select("parent", "parts", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), corners.alias("corners"))


# ---------------------------------------------------------------- hubs and ends


@query(closure_sql("select g, round(tb, 6) broken from (select x.g, avg(case when exists (select 1 from mt where l1 = x.line and l2 = y.line and h <> x.g and w <> x.g) then 0.0::double else 1 end) tb from h x join h y on x.g = y.g and x.line < y.line group by 1)"))
def pair_meet_elsewhere(spark, d):
    b = Z.broken_transfers(V.f2_net(spark, d))
    return b.select("g", F.round(F.col("broken") / F.col("pairs"), 6).alias("broken"))


@query(closure_sql("select g, alt, round(way, 6) as minutes from be"))
def join_alternative_stop(spark, d):
    best = Z.alternatives(V.f2_net(spark, d)).groupBy("g").agg(F.min(F.struct(F.round("minutes", 9).alias("m"), "alt")).alias("x"))
    return best.select("g", "x.alt", F.round("x.m", 6).alias("minutes"))


@query(recursive("select p.f a, p.t b, x.line from f2_trip p join lg x on x.g = p.f join lg y on y.g = p.t and y.line = x.line", {"lg": PARTS["lg"]}, views=("f2_ps", "f2_trip")))
def lines_at_both_ends(spark, d):
    lg = V.f2_net(spark, d).served()
    t = V.f2_trip(spark, d).select(F.col("f").alias("a"), F.col("t").alias("b"))
    return t.join(lg.withColumnRenamed("g", "a"), "a").join(lg.withColumnRenamed("g", "b"), ["b", "line"]).select("a", "b", "line")


_MERC = "(({0}.lon + 180) / 360)", "((1 - ln(tan(radians({0}.lat)) + 1 / cos(radians({0}.lat))) / pi()) / 2)"


@query(recursive(f"select id, g from (select p.id, s.g, row_number() over (partition by p.id order by round(sqrt(power({_MERC[0].format('p')} - {_MERC[0].format('s')}, 2) + power({_MERC[1].format('p')} - {_MERC[1].format('s')}, 2)) / 1e-5, 9), s.g) r from pts p, f2_stop s) where r = 1", _PTS, views=("f2_stop",)))
def nearest_group_brute(spark, d):
    """The group nearest to each point on the map."""
    at = lambda df, key: df.select(F.col(key).alias("id"), geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    return X.nearest_any(at(_pts(spark, d), "id"), at(V.f2_stop(spark, d), "g"), 1e-5, 1.0).select("id", F.col("to").alias("g"))


@query("select c.c_custkey, round(avg(o.o_totalprice), 4) score from customer c left join (select split_part(o_custkey::varchar || '#' || o_orderkey::varchar, '#', 1) k, o_totalprice from orders) o on o.k = c.c_custkey::varchar group by 1")
def join_legacy_scores(spark, d):
    """The mean of the old scores of a line's sources, whose ids end in a pattern's number."""
    o = V.read(spark, d, "orders").select(F.split_part(F.concat_ws("#", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), F.lit("#"), F.lit(1)).alias("k"), "o_totalprice")
    per = o.groupBy("k").agg(F.round(F.avg("o_totalprice"), 4).alias("score"))
    return V.read(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k")).join(per, "k", "left").select("c_custkey", "score")


# ---------------------------------------------------------------- quantiles and tops


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) r, count(*) over () n from orders) where r <= greatest(1, floor(n * 0.05::double))")
def topk_top5pct(spark, d):
    return R.top_share(V.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 0.05, ["o_totalprice"], ["o_orderkey"], 1).select("o_orderkey")


@query("with a as (select c_custkey k, row_number() over (order by c_acctbal desc, c_custkey) r, count(*) over () n from customer), b as (select o_custkey k, row_number() over (order by round(sum(o_totalprice), 2) desc, o_custkey) r from orders group by 1) select round(count(*) / max(floor(n * 0.05::double))::double, 6) share from a join b using (k) where a.r <= floor(n * 0.05::double) and b.r <= floor(n * 0.05::double)")
def intersect_top_sets(spark, d):
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    n = max(1, int(c.count() * 0.05))
    o = V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    a = R.numbered_all(c, ["c_acctbal"], ["k"]).where(F.col("place") < n).select("k")
    b = R.numbered_all(o, ["s"], ["k"]).where(F.col("place") < n).select("k")
    return a.intersect(b).agg(F.round(F.count("*") / n, 6).alias("share"))


@query("select cast(i as int) i, round(q[i + 1], 6) q from (select quantile_cont(ln(1 + o_totalprice), [x / 100.0::double for x in range(0, 101)]) q from orders), range(0, 101) t(i)")
def agg_quantile_table_101(spark, d):
    q = R.quantiles(V.read(spark, d, "orders").select(F.log1p("o_totalprice").alias("l")), "l", [i / 100 for i in range(101)])
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(q)], "i int, q double")


@query("select round(median(l_quantity), 6) quantity, round(median(l_extendedprice), 6) price, round(median(l_discount), 6) discount from lineitem")
def agg_feature_medians(spark, d):
    l = V.read(spark, d, "lineitem")
    of = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    return spark.createDataFrame([tuple(round(R.quantiles(l, c, [0.5])[0], 6) for c in of.values())], ", ".join(f"{k} double" for k in of))


# ---------------------------------------------------------------- roads

_XY = "(select g, lon * 111320.0 * cos(radians(36.2)) x, lat * 111320.0 y from f2_stop)"
_HOPS = f"hp as (select distinct least(g, nxt) a, greatest(g, nxt) b from (select g, lead(g) over (partition by pat order by pos) nxt from f2_ps) where nxt is not null), sg as (select a, b, u.x x1, u.y y1, v.x x2, v.y y2 from hp join {_XY} u on u.g = a join {_XY} v on v.g = b)"


def _links(spark, d):
    return _hops(spark, d).select("a", "b", F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)).alias("m"))


@query(recursive("""select id, dist from (select id, min(round(sqrt(power(px - x1 - t * (x2 - x1), 2) + power(py - y1 - t * (y2 - y1), 2)), 3)) dist from (select id, px, py, x1, y1, x2, y2, least(1, greatest(0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) t from (select id, lon * 111320.0 * cos(radians(36.2)) px, lat * 111320.0 py from pts), sg) group by 1) where dist <= 300""", _PTS, _HOPS, views=("f2_stop", "f2_ps")))
def join_snap_road(spark, d):
    from stopgrid.operators.roads import snap

    p = _pts(spark, d).select("id", geo.local_x(F.col("lon")).alias("x"), geo.local_y(F.col("lat")).alias("y"))
    return snap(p, _hops(spark, d).withColumn("link", F.col("a") * 100_000 + F.col("b"))).select("id", "dist")


_ROADS = """e as (select a f, b t, sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)) m from sg union all select b, a, sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)) from sg),
j(o, g, m) using key (o, g) as (select distinct f::bigint, f::bigint, 0::double from f2_trip union
select n.o, n.g, n.m from (select j.o, e.t g, min(j.m + e.m) m from j join e on e.f = j.g where j.m + e.m <= 25000 group by 1, 2) n left join recurring.j q on q.o = n.o and q.g = n.g where q.m is null or n.m < q.m - 1e-6)"""
_WAYS = f"wy as (select p.f, p.t, round(j.m, 3) m, sqrt(power(u.x - v.x, 2) + power(u.y - v.y, 2)) straight, case when j.m is null then 2 when j.m > greatest(3 * sqrt(power(u.x - v.x, 2) + power(u.y - v.y, 2)), sqrt(power(u.x - v.x, 2) + power(u.y - v.y, 2)) + 2000) then 3 else 1 end status from f2_trip p left join j on j.o = p.f and j.g = p.t join {_XY} u on u.g = p.f join {_XY} v on v.g = p.t)"
_ROAD_VIEWS = ("f2_stop", "f2_ps", "f2_trip")


@V.once
def _ways(spark, d):
    from stopgrid.operators.roads import road_paths

    p = _plane(spark, d)
    a, b = p.select(F.col("g").alias("f"), F.col("x").alias("x1"), F.col("y").alias("y1")), p.select(F.col("g").alias("t"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    t = V.f2_trip(spark, d).join(a, "f").join(b, "t").select("f", "t", F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)).alias("straight"))
    return written(road_paths(_links(spark, d), t, p.select(F.col("g").alias("node"), "x", "y")), "ways")


@query(recursive("select f, t, m, status, case when status = 1 then m else round(straight, 3) end drawn from wy", _HOPS, _ROADS, _WAYS, views=_ROAD_VIEWS))
def road_sssp_geometry(spark, d):
    """Ways along roads; the length of what is drawn tells that the shape is the way's."""
    n = F.size("xs") - 1
    drawn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.sqrt(F.pow(F.get("xs", i) - F.get("xs", i + 1), 2) + F.pow(F.get("ys", i) - F.get("ys", i + 1), 2)))
    return _ways(spark, d).select("f", "t", F.round("m", 3).alias("m"), "status", F.round(drawn, 3).alias("drawn"))


@query(recursive("select status, count(*) n from wy group by 1", _HOPS, _ROADS, _WAYS, views=_ROAD_VIEWS))
def road_status_summary(spark, d):
    from stopgrid.operators.roads import status_summary

    return status_summary(_ways(spark, d))


# ---------------------------------------------------------------- places asked for


@query(recursive("select distinct a || '-' || b id from sg where greatest(x1, x2) >= 11407000 and least(x1, x2) <= 11409000 and greatest(y1, y2) >= 4007600 and least(y1, y2) <= 4009000", _HOPS, views=("f2_stop", "f2_ps")))
def cell_index_range_query(spark, d):
    from stopgrid.query import cell_index, in_box

    s = _hops(spark, d).select(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("id"), "x1", "y1", "x2", "y2")
    index = written(cell_index(s, 300.0, 3), "index")
    return in_box(index, 300.0, 11407000, 4007600, 11409000, 4009000)


_PX, _PY = "127.0131 * 111320.0 * cos(radians(36.2))", "36.0107 * 111320.0"
_NEAR = f"""hl as (select distinct line, g a, nxt b from (select line, g, lead(g) over (partition by pat order by pos) nxt from f2_ps) where nxt is not null),
hx as (select line, a, b, u.x x1, u.y y1, v.x x2, v.y y2, least(1, greatest(0, (({_PX} - u.x) * (v.x - u.x) + ({_PY} - u.y) * (v.y - u.y)) / (power(v.x - u.x, 2) + power(v.y - u.y, 2)))) t from hl join {_XY} u on u.g = a join {_XY} v on v.g = b),
hd as (select *, round(sqrt(power({_PX} - x1 - t * (x2 - x1), 2) + power({_PY} - y1 - t * (y2 - y1), 2)), 3) dist from hx),
al as (select 'stop' as kind, g::varchar id, round(sqrt(power(x - {_PX}, 2) + power(y - {_PY}, 2)), 3) dist, 0.0::double score from {_XY} union all select 'line', line::varchar, min(dist), 0.0 from hd group by line union all select 'segment', least(a, b) || '-' || greatest(a, b), min(dist), 0.0 from hd group by 2)"""


@query(recursive("select kind, id, dist, r as rank from (select *, row_number() over (partition by kind order by dist, id) r from al where dist <= 600) where r <= 12", _NEAR, views=("f2_stop", "f2_ps")))
def features_near_point(spark, d):
    from stopgrid.query import near_point

    net = V.f2_net(spark, d)
    flat = net.stops.select("line", F.lit(0.0).alias("score")).distinct()
    return near_point(net, flat, 127.0131, 36.0107, 600.0).select("kind", "id", "dist", "rank")


@V.once
def built(spark, d):
    """The grid built from raw stops and patterns."""
    s = V.f2_stop(spark, d).select(F.format_string("%06d", "g").alias("stop_id"), "name", "lon", "lat")
    ps = V.f2_ps(spark, d).withColumn("stop_id", F.format_string("%06d", "g"))
    p = ps.groupBy("pat", "line", "mode", "trips").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))), lambda x: x["stop_id"]).alias("stops"))
    p = p.select(F.format_string("%06d", "pat").alias("pattern_id"), F.col("line").cast("string").alias("route_id"), F.concat(F.lit("L"), "line").alias("name"), F.col("mode").cast("string").alias("mode"), "trips", "stops", F.lit(None).cast("array<double>").alias("minutes"))
    return N.build(s, p, grid=_pts(spark, d).select("lon", "lat", F.lit(1.0).alias("value")))


@query(V.with_views("select (select count(*) from f2_stop) groups, (select count(*) from f2_stop) stops, (select count(distinct line) from f2_ps) as lines, (select count(distinct pat) from f2_ps) patterns, 'grid' as population, 'none' as senior, 'stations' as destinations, 'estimated' as time", "f2_stop", "f2_ps"))
def data_status(spark, d):
    return N.data_status(built(spark, d))


@query(V.with_views("select line, trips, n_groups, rank() over (order by line) - 1 nth from (select line, sum(t) trips, any_value(n) n_groups from (select distinct line, pat, trips t from f2_ps) join (select line, count(distinct g) n from f2_ps group by 1) using (line) group by 1)", "f2_ps"))
def built_lines(spark, d):
    """The lines of the network as built from raw stops and patterns."""
    b = built(spark, d).lines
    n = R.numbered_all(b.select(F.substring("name", 2, 9).cast("long").alias("line"), "trips", F.col("n_groups").cast("long").alias("n_groups")), [], ["line"], "nth")
    return n.select("line", "trips", "n_groups", "nth")
