"""Components, shortest paths, removals, policies and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.catalog.relational import _LG, _PTS, _D, _pts, _sql
from stopgrid.operators import ranks as R
from stopgrid.operators import sequences as S
from stopgrid.operators import spatial as X
from stopgrid.operators.components import connected_components
from stopgrid.plans import routing as T


# ---------------------------------------------------------------- shortest paths

RIDE = "select {scn} scn, a.g f, b.g t, min(b.cum - a.cum + {wait}) m from {src} f2_ps a join f2_ps b on a.pat = b.pat and a.pos < b.pos {where} group by 1, 2, 3"
WALK = "select {scn} scn, a f, b t, minutes m from {src} f2_walk {where}"


def _sp(edges, origins, lim, tail="select scn, origin, g, round(m, 4) t from r", *, more="", keep="true"):
    """SQL for shortest times over edges (scn, f, t, m) from origins (scn, origin, g, t0)."""
    head = V.with_views("", "f2_ps", "f2_walk").replace("with ", "with recursive ", 1).rstrip()
    return f"""{head}, {more + ', ' if more else ''}x as materialized ({edges}), o as ({origins}),
r(scn, origin, g, m) using key (scn, origin, g) as (select scn::bigint, origin::bigint, g::bigint, t0::double from o union
select n.scn, n.origin, n.g, n.m from (select r.scn, r.origin, x.t g, min(r.m + x.m) m from r join x on x.scn = r.scn and x.f = r.g where r.m + x.m <= {lim} and {keep} group by 1, 2, 3) n left join recurring.r q on q.scn = n.scn and q.origin = n.origin and q.g = n.g where q.m is null or n.m < q.m - 1e-9) {tail}"""


_O2 = "select 0 scn, 0 origin, 0 g, 0 t0 union all select 0, 55, 55, 0"
_PLAIN = RIDE.format(scn="0", wait="5.0", src="", where="")
_FOOT = WALK.format(scn="0", src="", where="")


def net(spark, d):
    return V.f2_ps(spark, d).withColumn("wait", F.lit(V.WAIT))


def origins(spark, rows, lim=60.0):
    return spark.createDataFrame([(*map(int, r[:3]), float(r[3]) if len(r) > 3 else 0.0, float(lim)) for r in rows], "scn bigint, origin bigint, g bigint, t0 double, lim double")


def _out(df):
    return df.select("scn", "origin", "g", F.round("t", 4).alias("t"))


def _run(spark, d, rows=((0, 0, 0), (0, 55, 55)), lim=60.0, walk=True, **more):
    return _out(T.shortest_times(net(spark, d), V.f2_walk(spark, d) if walk else None, T.Scenarios(origins(spark, rows, lim), **more)))


@query(_sp(f"{_PLAIN} union all {_FOOT}", _O2, 60))
def sssp_transit(spark, d):
    return _run(spark, d)


@query(_sp(f"{_PLAIN} union all {_FOOT}", _O2, 15))
def sssp_limit(spark, d):
    return _run(spark, d, lim=15.0)


@query(_sp(_PLAIN, _O2, 60))
def sssp_no_walk(spark, d):
    return _run(spark, d, walk=False)


_LINES = "(select distinct line scn from f2_ps) l,"


@query(_sp(RIDE.format(scn="l.scn", wait="5.0", src=_LINES, where="and a.line <> l.scn").replace("from (select distinct line scn from f2_ps) l, f2_ps a join", "from f2_ps a join").replace("where", "where").replace("and a.pos < b.pos and a.line <> l.scn", "and a.pos < b.pos join (select distinct line scn from f2_ps) l on a.line <> l.scn"), "select distinct line scn, 0 origin, 0 g, 0 t0 from f2_ps", 60))
def sssp_disabled(spark, d):
    ps = net(spark, d)
    lines = ps.select("line").distinct()
    o = lines.select(F.col("line").alias("scn"), F.lit(0).cast("long").alias("origin"), F.lit(0).cast("long").alias("g"), F.lit(0.0).alias("t0"), F.lit(60.0).alias("lim"))
    return _out(T.shortest_times(ps, None, T.Scenarios(o, disabled=lines.select(F.col("line").alias("scn"), "line"))))


@query(_sp(f"{RIDE.format(scn='0', wait='5.0', src='', where='and a.g not in (5, 12) and b.g not in (5, 12)')} union all {WALK.format(scn='0', src='', where='where a not in (5, 12) and b not in (5, 12)')}", _O2, 60))
def sssp_closed(spark, d):
    return _run(spark, d, closed=spark.createDataFrame([(0, 5), (0, 12)], "scn bigint, g bigint"))


@query(_sp(f"{RIDE.format(scn='0', wait='5.0', src='', where='and not exists (select 1 from f2_ps u join f2_ps v on u.pat = v.pat and v.pos = u.pos + 1 where u.pat = a.pat and u.pos >= a.pos and v.pos <= b.pos and least(u.g, v.g) = 4 and greatest(u.g, v.g) = 5)')}", _O2, 60))
def sssp_blocked(spark, d):
    return _run(spark, d, walk=False, blocked=spark.createDataFrame([(0, 5, 4)], "scn bigint, a bigint, b bigint"))


@query(_sp(f"{RIDE.format(scn='0', wait='5.0', src='', where='and a.g % 3 <> 1 and b.g % 3 <> 1')} union all {WALK.format(scn='0', src='', where='where a % 3 <> 1 and b % 3 <> 1')}", "select 0 scn, 0 origin, 0 g, 0 t0", 60))
def sssp_allowed(spark, d):
    ok = V.f2_stop(spark, d).where("g % 3 <> 1").select(F.lit(0).cast("long").alias("scn"), "g")
    return _run(spark, d, rows=[(0, 0, 0)], allowed=ok)


@query(_sp(f"{RIDE.format(scn='0', wait='5.0 * case when a.line in (0, 1005) then 0.5 else 1 end', src='', where='')} union all {_FOOT}", _O2, 60))
def sssp_wait_scale(spark, d):
    return _run(spark, d, scale=spark.createDataFrame([(0, 0, 0.5), (0, 1005, 0.5)], "scn bigint, line bigint, scale double"))


@query(_sp(f"{_PLAIN} union all {_FOOT} union all select 0, 0, 79, 4.0 union all select 0, 79, 0, 4.0", _O2, 60))
def sssp_extra_links(spark, d):
    return _run(spark, d, links=spark.createDataFrame([(0, 0, 79, 4.0), (0, 79, 0, 4.0)], "scn bigint, f bigint, t bigint, minutes double"))


@query(_sp(f"{_PLAIN} union all {_FOOT}", "select 0 scn, 7 origin, 0 g, 0 t0 union all select 0, 7, 77, 3", 60))
def sssp_multi_origin(spark, d):
    return _run(spark, d, rows=[(0, 7, 0, 0.0), (0, 7, 77, 3.0)])


@query(_sp(f"{RIDE.format(scn='1', wait='5.0', src='', where='and a.mode not in (2, 3, 4, 5, 6, 7)')} union all {RIDE.format(scn='2', wait='5.0', src='', where='and a.g in (select g from f2_ps where mode = 2) and b.g in (select g from f2_ps where mode = 2)')}", "select 1 scn, 0 origin, 0 g, 0 t0 union all select 2, 0, 0, 0", 60))
def scope_mode(spark, d):
    ps = net(spark, d)
    local = ps.where("mode >= 2").select(F.lit(1).cast("long").alias("scn"), "line").distinct()
    both = ps.select("g").distinct().select(F.lit(1).cast("long").alias("scn"), "g").unionByName(ps.where("mode = 2").select(F.lit(2).cast("long").alias("scn"), "g").distinct())
    return _out(T.shortest_times(ps, None, T.Scenarios(origins(spark, [(1, 0, 0), (2, 0, 0)]), disabled=local, allowed=both)))


@query(_sp(f"{_PLAIN} union all {_FOOT}", _O2, 60, "select origin, cast(sum(case when g % 7 = 0 then 1 else 0 end) as bigint) reached from r where m <= 25 group by 1"))
def reach_dest(spark, d):
    t = T.shortest_times(net(spark, d), V.f2_walk(spark, d), T.Scenarios(origins(spark, [(0, 0, 0), (0, 55, 55)])))
    return T.reach(t, V.f2_stop(spark, d), 25.0).select("origin", F.col("reached").cast("long").alias("reached"))


# ---------------------------------------------------------------- sinks


@query(V.with_views("select part, id, score, rank from (select 0 part, g id, pop score, row_number() over (order by pop desc, g) rank from f2_stop where g % 4 = 3 union all select 1, c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) from customer where c_custkey % 4 = 3)", "f2_stop"))
def sink_csv_export(spark, d):
    from stopgrid.sources.sinks import export_rows

    a = V.f2_stop(spark, d).select(F.col("g").alias("id"), "name", F.col("pop").alias("score"), (F.col("g") % 4).alias("grade"))
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 4).alias("grade"))
    return export_rows(a, c).select("part", "id", "score", "rank")


@query(V.with_views("select pat, pos, x - coalesce(lag(x) over (partition by pat order by pos), 0) dx, y - coalesce(lag(y) over (partition by pat order by pos), 0) dy from (select p.pat, p.pos, cast(round_even(s.lon * 1e6, 0) as bigint) x, cast(round_even(s.lat * 1e6, 0) as bigint) y from f2_ps p join f2_stop s on s.g = p.g)", "f2_ps", "f2_stop"))
def sink_delta_polyline(spark, d):
    from stopgrid.sources.sinks import delta_polyline

    p = V.f2_ps(spark, d).join(V.f2_stop(spark, d).select("g", "lon", "lat"), "g")
    return delta_polyline(p, "pat")


@query("select c_custkey, cast(least(greatest(round_even(c_acctbal * 10, 0), 0), 65535) as bigint) c_acctbal from customer")
def sink_packed_columns(spark, d):
    from stopgrid.sources.sinks import packed

    return packed(V.read(spark, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": (10, 65535)})


# ---------------------------------------------------------------- roads


_XY = "(select g, lon * 111320.0 * cos(radians(36.2)) x, lat * 111320.0 y from f2_stop)"
_HOPS = "hop as (select distinct least(g, nxt) a, greatest(g, nxt) b from (select g, lead(g) over (partition by pat order by pos) nxt from f2_ps) where nxt is not null)"


def _plane(spark, d):
    from stopgrid.functions.geo import local_x, local_y

    return V.f2_stop(spark, d).select("g", local_x(F.col("lon")).alias("x"), local_y(F.col("lat")).alias("y"))


def _hops(spark, d):
    e = S.edges(V.f2_ps(spark, d), "pat").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = _plane(spark, d)
    return e.join(p.select(F.col("g").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1")), "a").join(p.select(F.col("g").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), "b")


@query()
def polyline_simplify(spark, d):
    from stopgrid.operators.roads import simplify

    p = V.f2_ps(spark, d).join(_plane(spark, d), "g").groupBy("pat").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return simplify(p.select(F.col("pat").alias("id"), F.transform("p", lambda q: q["x"]).alias("xs"), F.transform("p", lambda q: q["y"]).alias("ys"))).select("id", F.size("xs").alias("n"))


@query(V.with_views("select g, sum(trips) trips from f2_ps group by 1", "f2_ps"))
def group_trips(spark, d):
    return V.f2_ps(spark, d).groupBy("g").agg(F.sum("trips").alias("trips"))
