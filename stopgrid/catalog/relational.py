"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.functions import geo
from stopgrid.operators import matching as M
from stopgrid.operators import ranks as R
from stopgrid.operators import sequences as S
from stopgrid.operators import spatial as X


def _sql(body, *views, more=""):
    s = V.with_views("", *views)
    return s.rstrip() + (", " + more if more else "") + " " + body


# ---------------------------------------------------------------- joins


@query("""select l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(o.o_custkey % 40, -1) route, case when c.c_custkey is null then 3 else o.o_custkey % 8 end as route_type from lineitem l join orders o on o.o_orderkey = l.l_orderkey left join customer c on c.c_custkey = o.o_custkey and c.c_custkey % 3 > 0""")
def join_trip_route(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = V.read(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("known"))
    j = V.read(spark, d, "lineitem").join(o, "l_orderkey").join(c, "o_custkey", "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("o_custkey") % 40).alias("route"), F.when(F.col("known").isNull(), 3).otherwise(F.col("o_custkey") % 8).alias("route_type"))


def _pts(spark, d):
    """Customers placed near stops by key arithmetic."""
    k = F.col("c_custkey")
    return V.read(spark, d, "customer").select(k.alias("id"), (127.0 + (k % 10) * 0.004 + (k % 7) * 0.0007).alias("lon"), (36.0 + (k % 11) * 0.004 + (k % 5) * 0.0011).alias("lat"), F.concat(F.lit("n"), (k % 3).cast("string")).alias("name"))


_PTS = "pts as (select c_custkey id, 127.0::double + (c_custkey % 10) * 0.004::double + (c_custkey % 7) * 0.0007::double lon, 36.0::double + (c_custkey % 11) * 0.004::double + (c_custkey % 5) * 0.0011::double lat, 'n' || (c_custkey % 3)::varchar as name from customer)"
_D = "sqrt(power(({0}.lon - {1}.lon) * 111320.0 * cos(radians(36.2)), 2) + power(({0}.lat - {1}.lat) * 111320.0, 2))"


@query(f"with {_PTS} select a.id a, b.id b from pts a join pts b on a.id < b.id and a.name = b.name and {_D.format('a', 'b')} <= 100")
def join_same_name_100m(spark, d):
    p = _pts(spark, d)
    return X.within(p, p, P.GROUP_M, extra=("name",)).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query(V.with_views("select a, b, round(minutes, 5) mins from f2_walk", "f2_walk"))
def join_walk_400m(spark, d):
    return V.f2_walk(spark, d).select("a", "b", F.round("minutes", 5).alias("mins"))


@query(V.with_views(f"select a.g, round(min({_D.format('a', 'b')}), 3) m from f2_stop a join f2_stop b on a.g <> b.g group by a.g", "f2_stop"))
def join_knn_other(spark, d):
    return X.nearest_other(V.f2_stop(spark, d).select("g", "lon", "lat")).select("g", F.round("dist", 3).alias("m"))


_AREAS = "areas as (select r_regionkey area, 127.0::double + r_regionkey * 0.008 x0, 127.008::double + r_regionkey * 0.008 x1 from region)"


def _areas(spark, d):
    x0 = 127.0 + F.col("r_regionkey") * 0.008
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    return V.read(spark, d, "region").select(F.col("r_regionkey").alias("area"), F.array(corner(x0, 35.99), corner(x0 + 0.008, 35.99), corner(x0 + 0.008, 36.03), corner(x0, 36.03)).alias("ring"))


@query(_sql("select cast(floor((s.lon + 0.001 - 124.0) / 0.05) as bigint) cx, cast(floor((s.lat + 0.0003 - 33.0) / 0.05) as bigint) cy, count(*) n from f2_stop s join areas a on s.lon + 0.001 > a.x0 and s.lon + 0.001 < a.x1 and s.lat + 0.0003 > 35.99 and s.lat + 0.0003 < 36.03 group by 1, 2", "f2_stop", more=_AREAS))
def reachable_land_check(spark, d):
    s = V.f2_stop(spark, d).select("g", (F.col("lon") + 0.001).alias("lon"), (F.col("lat") + 0.0003).alias("lat"))
    j = X.locate(s, _areas(spark, d), 0.01).where("area is not null")
    return j.groupBy(geo.grid_x(F.col("lon")).alias("cx"), geo.grid_y(F.col("lat")).alias("cy")).agg(F.count("*").alias("n"))


@query(V.with_views(f"select a.g a, b.g b, round({_D.format('a', 'b')}, 3) m from f2_stop a join f2_stop b on a.g <> b.g and {_D.format('a', 'b')} <= 800", "f2_stop"))
def join_groups_within_r(spark, d):
    s = V.f2_stop(spark, d).select("g", "lon", "lat")
    return X.within(s, s, P.STRANDED_M).where("a_g <> b_g").select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), F.round("dist", 3).alias("m"))


@query("""with b as (select regexp_replace('S' || (user_id % 50)::varchar || '(' || event_id::varchar || ')', '\\(\\d+\\)', '', 'g') base, sum(value) n from events group by 1), g as (select s_suppkey g, regexp_replace('S' || s_suppkey::varchar || '(중)', '\\(중\\)', '', 'g') base from supplier) select g.g, round(b.n, 3) boardings from g join b using (base) where b.n > 0""")
def join_name_boardings(spark, d):
    b = agg_boardings_base(spark, d)
    g = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("g"), F.regexp_replace(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("(중)")), r"\(중\)", "").alias("base"))
    return g.join(b.where("n > 0"), "base").select("g", F.round("n", 3).alias("boardings"))


def agg_boardings_base(spark, d):
    name = F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string"), F.lit("("), F.col("event_id").cast("string"), F.lit(")"))
    return V.read(spark, d, "events").groupBy(F.regexp_replace(name, r"\(\d+\)", "").alias("base")).agg(F.sum("value").alias("n"))


@query("select 'S' || (user_id % 50)::varchar base, round(sum(value), 3) boardings from events group by 1")
def agg_boardings(spark, d):
    return agg_boardings_base(spark, d).select("base", F.round("n", 3).alias("boardings"))


_LG = "lg as (select distinct line, g from f2_ps)"


@query(_sql("select a, b, n, r as rank from (select x.line a, y.line b, count(*) n, row_number() over (partition by x.line order by count(*) desc, y.line) r from lg x join lg y on x.g = y.g and x.line <> y.line group by 1, 2) where r <= 8", "f2_ps", more=_LG))
def shared_lines(spark, d):
    return R.top_per(M.co_located(V.f2_ps(spark, d).select("line", "g").distinct()), ["a"], [F.desc("n"), "b"], 8)


@query(_sql("select x.g, x.line from lg x where exists (select 1 from lg y where y.g = x.g and y.line <> x.line) or exists (select 1 from f2_walk w join lg y on y.g = w.b where w.a = x.g and y.line <> x.line)", "f2_ps", "f2_walk", more=_LG))
def semi_other_service(spark, d):
    lg = V.f2_ps(spark, d).select("line", "g").distinct()
    near = lg.unionByName(V.f2_walk(spark, d).join(lg.withColumnRenamed("g", "b"), "b").select("line", F.col("a").alias("g"))).select("g", F.col("line").alias("o"))
    return lg.join(near, (lg["g"] == near["g"]) & (lg["line"] != near["o"]), "left_semi")


@query(_sql("select x.g, count(*) n from lg x where not exists (select 1 from f2_walk w join lg y on y.g = w.b where w.a = x.g and y.line = x.line) group by 1", "f2_ps", "f2_walk", more=_LG))
def anti_line_loss(spark, d):
    lg = V.f2_ps(spark, d).select("line", "g").distinct()
    near = V.f2_walk(spark, d).join(lg.withColumnRenamed("g", "b"), "b").select(F.col("a").alias("g"), "line")
    return lg.join(near, ["g", "line"], "left_anti").groupBy("g").agg(F.count("*").alias("n"))


_CELL = "cast(floor((lon - 124.0::double) / 0.05::double) as bigint)", "cast(floor((lat - 33.0::double) / 0.05::double) as bigint)"


@query(_sql(f"select coalesce(a.cx, b.cx) cx, coalesce(a.cy, b.cy) cy, coalesce(a.n, 0) stops, coalesce(b.n, 0) points from (select {_CELL[0]} cx, {_CELL[1]} cy, count(*) n from f2_stop group by 1, 2) a full join (select {_CELL[0].replace('lon', 'lon + 0.03')} cx, {_CELL[1]} cy, count(*) n from pts group by 1, 2) b on a.cx = b.cx and a.cy = b.cy", "f2_stop", more=_PTS))
def grid_full_outer(spark, d):
    by = lambda df, dx, n: df.groupBy(geo.grid_x(F.col("lon") + dx).alias("cx"), geo.grid_y(F.col("lat")).alias("cy")).agg(F.count("*").alias(n))
    return by(V.f2_stop(spark, d), 0.0, "stops").join(by(_pts(spark, d), 0.03, "points"), ["cx", "cy"], "full").fillna(0, ["stops", "points"])


# ---------------------------------------------------------------- aggregates


@query(V.with_views("select g, route, count(*) trips from st group by 1, 2", "st"))
def agg_group_line_trips(spark, d):
    return V.st(spark, d).groupBy("g", "route").agg(F.count("*").alias("trips"))


@query(V.with_views("select least(g, nxt) a, greatest(g, nxt) b, count(*) trips from (select g, lead(g) over (partition by trip order by pos) nxt from st) where nxt is not null group by 1, 2", "st"))
def edge_trips(spark, d):
    return S.edges(V.st(spark, d), "trip").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("trips"))


@query("select o_orderkey, cast((o_totalprice >= a)::int + (o_totalprice >= b)::int + (o_totalprice >= c)::int as int) grade from orders, (select quantile_cont(o_totalprice, 0.5) a, quantile_cont(o_totalprice, 0.8) b, quantile_cont(o_totalprice, 0.95) c from orders)")
def agg_quantile_thresholds(spark, d):
    return R.graded(V.read(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.col("grade").cast("int").alias("grade"))


@query("select o_custkey % 8 as mode, round(avg(o_totalprice), 4) score from orders group by 1")
def agg_mode_mean(spark, d):
    return V.read(spark, d, "orders").groupBy((F.col("o_custkey") % 8).alias("mode")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))


# ---------------------------------------------------------------- windows, sorts, sets


@query("select o_orderkey, round((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double - 1) / greatest(1, count(*) over () - 1), 8) pct from (select o_orderkey, floor(o_totalprice / 100) v from orders)")
def win_pct_rank(spark, d):
    o = V.read(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("v"))
    return R.pct_rank(o, "v").select("o_orderkey", F.round("pct", 8).alias("pct"))


@query(V.with_views("select route, trip from (select route, trip, row_number() over (partition by route order by max(pos) desc, trip) r from st group by 1, 2) where r = 1", "st"))
def win_main_pattern(spark, d):
    n = V.st(spark, d).groupBy("route", "trip").agg(F.max("pos").alias("n"))
    return R.top_per(n, ["route"], [F.desc("n"), "trip"], 1).select("route", "trip")


@query(V.with_views("select trip, pos, g a, nxt b from (select trip, pos, g, lead(g) over (partition by trip order by pos) nxt from st) where nxt is not null", "st"))
def win_lag_lead_edges(spark, d):
    return S.edges(V.st(spark, d), "trip").select("trip", "pos", "a", "b")


@query("select l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding), 3) cum from lineitem")
def win_running_cum(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sum("l_quantity").over(w), 3).alias("cum"))


@query(V.with_views("select s.trip, min(case when s.pos > 0 and s.g = f.g then s.pos end) as end from st s join st f on f.trip = s.trip and f.pos = 0 group by 1".replace("as end", 'as "end"'), "st"))
def win_first_loop_end(spark, d):
    return S.first_loop_end(V.st(spark, d), "trip")


@query(V.with_views("select distinct s.trip, s.pos, s.g from st s join (select trip, max(pos) m from st group by 1) n on n.trip = s.trip join (values (0.0), (0.25), (0.5), (0.75), (1.0)) f(x) on s.pos = cast(floor(n.m * f.x + 0.5) as bigint)", "st"))
def win_od_sample(spark, d):
    st = V.st(spark, d)
    at = st.groupBy("trip").agg((F.max("pos") + 1).alias("n")).select("trip", F.explode(F.transform(S.od_positions(F.col("n"), P.OD_FRACTIONS), lambda x: x.cast("long"))).alias("pos"))
    return st.join(at, ["trip", "pos"]).select("trip", "pos", "g")


@query(V.with_views("select pat, pos, round(cum + min(off_) over (partition by pat order by pos rows between unbounded preceding and 1 preceding), 4) arrival from (select pat, pos, cum, (g * 7 % 40) + 5 - cum off_ from f2_ps) where true qualify pos > 0", "f2_ps"))
def win_running_min_board(spark, d):
    w = Window.partitionBy("pat").orderBy("pos", "g").rowsBetween(Window.unboundedPreceding, -1)
    p = V.f2_ps(spark, d).withColumn("off", (F.col("g") * 7 % 40) + 5 - F.col("cum"))
    return p.select("pat", "pos", F.round(F.col("cum") + F.min("off").over(w), 4).alias("arrival")).where("pos > 0")


@query("select o_orderkey from (select o_orderkey, count(*) over (partition by o_custkey, o_orderpriority) n from orders) where n = 1")
def win_unique_key(spark, d):
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    return V.read(spark, d, "orders").withColumn("n", F.count("*").over(w)).where("n = 1").select("o_orderkey")


@query("select c_nationkey, round(avg(c_acctbal), 4) score from customer group by 1 order by avg(c_acctbal) desc, 1 limit 6")
def topk_regions(spark, d):
    a = V.read(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("s"))
    return a.orderBy(F.desc("s"), "c_nationkey").limit(6).select("c_nationkey", F.round("s", 4).alias("score"))


@query(V.with_views("select route, trip, r as rank from (select route, trip, row_number() over (partition by route order by max(pos) desc, trip) r from st group by 1, 2) where r <= 2", "st"))
def topk_longest_patterns(spark, d):
    n = V.st(spark, d).groupBy("route", "trip").agg(F.max("pos").alias("n"))
    return R.top_per(n, ["route"], [F.desc("n"), "trip"], 2).drop("n")


@query(V.with_views("select route, trip from (select route, trip, row_number() over (partition by route order by trip) r from (select distinct route, trip from st)) where r <= 30", "st"))
def limit_caps(spark, d):
    return R.top_per(V.st(spark, d).select("route", "trip").distinct(), ["route"], ["trip"], 30).drop("rank")


@query(V.with_views("select a, string_agg(b::varchar, ',' order by b) nbrs from f2_walk group by 1", "f2_walk"))
def sort_walk_neighbours(spark, d):
    w = V.f2_walk(spark, d)
    return w.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x.cast("string")), ",").alias("nbrs"))


@query("select distinct least(l_suppkey, l_partkey % 100) a, greatest(l_suppkey, l_partkey % 100) b from lineitem")
def sort_road_pairs(spark, d):
    p = F.col("l_partkey") % 100
    return V.read(spark, d, "lineitem").select(F.least("l_suppkey", p).alias("a"), F.greatest("l_suppkey", p).alias("b")).distinct().sortWithinPartitions("a", "b")


@query("select code, min(src) src from (select c_custkey % 700 code, 1 src from customer union all select s_suppkey * 3 code, 2 src from supplier) group by 1")
def union_all(spark, d):
    a = V.read(spark, d, "customer").select((F.col("c_custkey") % 700).alias("code"), F.lit(1).alias("src"))
    b = V.read(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("code"), F.lit(2).alias("src"))
    return a.unionByName(b).groupBy("code").agg(F.min("src").alias("src"))


@query(_sql(f"select {_CELL[0]} cx, {_CELL[1]} cy from f2_stop union select {_CELL[0]}, {_CELL[1]} from pts", "f2_stop", more=_PTS))
def union_distinct_keys(spark, d):
    c = lambda df: df.select(geo.grid_x(F.col("lon")).alias("cx"), geo.grid_y(F.col("lat")).alias("cy"))
    return c(V.f2_stop(spark, d)).unionByName(c(_pts(spark, d))).distinct()


@query("with r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double rb from (select floor(l_quantity) a, floor(l_extendedprice / 100) b from lineitem)) select round(corr(ra, rb), 8) rho from r")
def corr_spearman(spark, d):
    x = V.read(spark, d, "lineitem").select(F.floor("l_quantity").alias("a"), F.floor(F.col("l_extendedprice") / 100).alias("b"))
    return R.spearman(x, "a", "b").select(F.round("rho", 8).alias("rho"))


@query("""select kind, id, rank from (select 'line' as kind, c_custkey id, row_number() over (order by case when lower(c_name) = 'customer#000000007' then 0 when lower(c_name) like 'customer#00000000%' then 1 else 2 end, c_acctbal desc, c_custkey) rank from customer where contains(lower(c_name), '00000000')) where rank <= 12""")
def topk_search(spark, d):
    from stopgrid.query import search

    c = V.read(spark, d, "customer").select(F.lit("line").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight"))
    return search(c, "customer#000000007", 12, contains="00000000", prefix="customer#00000000")

