"""Removals of lines, stops and segments on the grid network, their scores and roll-ups, and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.operators import ranks as R
from stopgrid.plans import scores as K
from stopgrid.plans import simulation as M
from stopgrid.plans.storage import written


# ---------------------------------------------------------------- what all queries share


@V.once
def removal(spark, d):
    return M.line_removal(V.f2_net(spark, d))


@V.once
def closure(spark, d):
    return written(M.stop_closure(V.f2_net(spark, d)), "closure")


@V.once
def line_scores(spark, d):
    return written(K.score_lines(V.f2_net(spark, d), removal(spark, d)), "line_scores")


@V.once
def stop_scores(spark, d):
    return written(K.score_stops(V.f2_net(spark, d), closure(spark, d), lines(spark, d)), "stop_scores")


def lines(spark, d):
    """(line, trips): a line runs as often as its patterns together."""
    return V.f2_ps(spark, d).select("line", "pat", "trips").distinct().groupBy("line").agg(F.sum("trips").alias("trips"))


# ---------------------------------------------------------------- SQL

#: Pairs of sampled groups; scopes; every removal and the two bases as scenarios; times of all within 120 minutes.
PARTS = {
    "lg": "select distinct line, g from f2_ps",
    "nn": "select line, pat, max(pos) + 1 n, row_number() over (partition by line order by max(pos) desc, pat) r from f2_ps group by 1, 2",
    "ss": "select line, pat, r, list_sort(list_distinct([floor((n - 1) * x + 0.5)::bigint for x in [0, 0.25, 0.5, 0.75, 1]])) s from nn where r <= 2",
    "ij": "select line, pat, r * 1000 + i - 1 nth, s[i] i, s[i + 1] j from ss, range(1, 5) t(i) where i < len(s) union all select line, pat, r * 1000 + len(s) - 1, s[1], s[len(s) // 2 + 1] from ss union all select line, pat, r * 1000 + len(s), s[len(s) // 2 + 1], s[len(s)] from ss",
    "od": "select ij.line, a.g f, b.g t, arg_min(b.cum - a.cum + 5, ij.nth) ride, min(ij.nth) nth from ij join f2_ps a on a.pat = ij.pat and a.pos = ij.i join f2_ps b on b.pat = ij.pat and b.pos = ij.j where i < j and a.g <> b.g group by 1, 2, 3",
    "sc": "select distinct line, case when mode >= 2 then 2 else 1 end scope from f2_ps",
    "far": "select distinct g from f2_ps where mode >= 2",
    "scn": "select line scn, line off, scope from sc union all select distinct -1 - scope, -1, scope from sc",
    "x": """select s.scn, a.g f, b.g t, min(b.cum - a.cum + 5.0) m from f2_ps a join f2_ps b on a.pat = b.pat and a.pos < b.pos join scn s on a.line <> s.off and (s.scope = 2 or a.mode < 2) and (s.scope = 1 or (a.g in (from far) and b.g in (from far))) group by 1, 2, 3
union all select s.scn, w.a, w.b, w.minutes from f2_walk w join scn s on s.scope = 1 or (w.a in (from far) and w.b in (from far))""",
    "o": "select distinct line scn, f origin, f g, 0 t0 from od union select distinct -1 - scope, f, f, 0 from od join sc using (line)",
}
SEARCH = """r(scn, origin, g, m) using key (scn, origin, g) as (select scn::bigint, origin::bigint, g::bigint, t0::double from o union
select n.scn, n.origin, n.g, n.m from (select r.scn, r.origin, x.t g, min(r.m + x.m) m from r join x on x.scn = r.scn and x.f = r.g where r.m + x.m <= 120 group by 1, 2, 3) n left join recurring.r q on q.scn = n.scn and q.origin = n.origin and q.g = n.g where q.m is null or n.m < q.m - 1e-9)"""
#: Measures of each line's removal; people; islands; scores.
MEASURES = {
    "pr": "select od.*, scope, least(coalesce(b.m, ride), ride) before, case when a.m <= 2 * ride + 10 + 1e-9 then a.m end as after from od join sc using (line) left join r a on a.scn = od.line and a.origin = od.f and a.g = od.t left join r b on b.scn = -1 - scope and b.origin = od.f and b.g = od.t",
    "tm": "select line, avg(case when after is null then 1 else least(1, greatest(0, (after - before) / greatest(1, before))) end) ti, count(*) filter (where after is null) disc, count(*) n from pr group by 1",
    "st": "select lg.line, lg.g from lg where not exists (select 1 from lg o where o.g = lg.g and o.line <> lg.line) and not exists (select 1 from f2_walk w join lg o on o.g = w.b where w.a = lg.g and o.line <> lg.line)",
    "pe": "select own.line, sum(s.pop) pop, sum(s.pop * own.n / tot.n) aff, coalesce(sum(s.pop) filter (where st.g is not null), 0) lost, count(st.g) n_lost from (select line, g, sum(trips) n from f2_ps group by 1, 2) own join (select g, sum(trips) n from f2_ps group by 1) tot on tot.g = own.g join f2_stop s on s.g = own.g left join st on st.line = own.line and st.g = own.g group by 1",
    "ed": "select line, least(g, nxt) a, greatest(g, nxt) b, sum(trips) own, sum(sum(trips)) over (partition by least(g, nxt), greatest(g, nxt)) tot from (select *, lead(g) over (partition by pat order by pos) nxt from f2_ps) where nxt is not null group by 1, 2, 3",
    "de": "select line, avg(case when own / tot >= 0.9 then 1.0::double else 0 end) dep from ed group by 1",
    "ao": "select line, scope, f from (select line, scope, f, row_number() over (partition by line order by min(nth)) k from pr group by 1, 2, 3) where k <= 3",
    "rd": "select scn, origin, cast(sum(s.dest) as double) d from r join f2_stop s on s.g = r.g where m <= 60 + 1e-9 group by 1, 2",
    "ac": "select line, avg(case when coalesce(b.d, 0) > 0 then greatest(0, 1 - coalesce(a.d, 0) / b.d) else 0 end) acc from ao left join rd a on a.scn = line and a.origin = f left join rd b on b.scn = -1 - scope and b.origin = f group by 1",
    "lr": "select line, ti, disc, n, dep, case when pop > 0 then lost / pop else 0 end no_alt, lost, n_lost, aff, 0.5 * disc / n + 0.5 * dep conn, case when ti >= 0.05 or pop > 0 and lost > 0 or disc > 0 then acc else 0 end acc from tm join pe using (line) join de using (line) join ac using (line)",
}
RANK = "(rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0::double - 1) / greatest(1, count(*) over () - 1)"
GRADE = "cast(({0} >= quantile_cont({0}, 0.5) over ())::int + ({0} >= quantile_cont({0}, 0.8) over ())::int + ({0} >= quantile_cont({0}, 0.95) over ())::int as int)"
ISLANDS = {
    "e": "select g a, nxt b from (select pat, g, lead(g) over (partition by pat order by pos) nxt from f2_ps where mode <> 2) where nxt is not null union select nxt, g from (select pat, g, lead(g) over (partition by pat order by pos) nxt from f2_ps where mode <> 2) where nxt is not null union select a, b from f2_walk",
    "lab(id, c)": "select g, g from f2_stop union select e.b, lab.c from lab join e on e.a = lab.id",
    "isl": "select g, component, groups, people, groups < 3000 and people < 150000 island from (select id g, min(c) component from lab group by 1) join (select component, count(*) groups, sum(pop) people from (select id, min(c) component from lab group by 1) join f2_stop on g = id group by 1) using (component)",
    "fer": "select line, sum(people / n) people from (select distinct line, component, people from lg join isl using (g) where island and line in (select line from f2_ps where mode = 2)) join (select component, count(distinct line) n from lg join isl using (g) where island and line in (select line from f2_ps where mode = 2) group by 1) using (component) group by 1",
}
SCORES = {
    "af": "select lr.*, greatest(aff, coalesce(people, 0)) affected from lr left join fer using (line)",
    "sh": f"select *, {RANK.format('round(ln(1 + affected), 9)')} share from af",
    "sl": "select *, round(100 * (ti * 0.3::double + acc * 0.2::double + no_alt * 0.2::double + conn * 0.15::double + share * 0.15::double), 9) score from sh",
    "gl": f"select *, {GRADE.format('score')} grade from sl",
}


def recursive(body: str, *groups: dict | str, views: tuple = ("f2_stop", "f2_ps", "f2_walk")) -> str:
    """``body`` under a recursive WITH of the views and the named parts."""
    head = V.with_views("", *views).replace("with ", "with recursive ", 1).rstrip()
    parts = [p for g in groups for p in ([g] if isinstance(g, str) else [f"{k} as ({v})" for k, v in g.items()])]
    return f"{head}, {', '.join(parts)} {body}"


def removal_sql(body: str, *more) -> str:
    return recursive(body, PARTS, SEARCH, MEASURES, *more)


# ---------------------------------------------------------------- lines


def _digits(df, *names, digits=6):
    return df.select(*[F.round(n, digits).alias(n) if n in names else n for n in df.columns])


@query(recursive("select line, f, t, round(ride, 4) ride, nth from od", PARTS, views=("f2_ps", "f2_walk")))
def od_pairs(spark, d):
    return _digits(M.od_pairs(V.f2_net(spark, d).stops), "ride", digits=4)


@query(removal_sql("select line, round(ti, 6) time_increase, disc disconnected, n n_pairs from lr"))
def line_removal(spark, d):
    return _digits(removal(spark, d).lines.select("line", "time_increase", "disconnected", "n_pairs"), "time_increase")


@query(removal_sql("select line, round(acc, 6) access_loss from lr"))
def line_access_loss(spark, d):
    return _digits(removal(spark, d).lines.select("line", "access_loss"), "access_loss")


@query(removal_sql("select line, f, t, round(before, 4) as before, round(after, 4) as after from pr"))
def removed_pairs(spark, d):
    return _digits(removal(spark, d).pairs.select("line", "f", "t", "before", "after"), "before", "after", digits=4)


@query(removal_sql("select line, round(aff, 4) affected, round(no_alt, 6) no_alternative from lr"))
def line_removal_people(spark, d):
    r = removal(spark, d).lines.select("line", "affected", "no_alternative")
    return _digits(_digits(r, "affected", digits=4), "no_alternative")


@query(removal_sql("select line, round(dep, 6) dependency, round(conn, 6) connectivity from lr"))
def line_segment_dependency(spark, d):
    return _digits(removal(spark, d).lines.select("line", "dependency", "connectivity"), "dependency", "connectivity")


@query(recursive("select line, round(coalesce(sum(pop), 0), 4) pop, count(*) n from st join f2_stop using (g) group by 1", {k: PARTS[k] for k in ("lg",)}, {"st": MEASURES["st"]}))
def stranded_population(spark, d):
    """People at the groups that a line's removal strands."""
    n = V.f2_net(spark, d)
    return M.stranded_groups(n).join(n.groups.select("g", "pop"), "g").groupBy("line").agg(F.round(F.sum("pop"), 4).alias("pop"), F.count("*").alias("n"))


@query(removal_sql("select line, f, t, round((after - before) / greatest(1, before), 6) increase from pr where after is null or (after - before) / greatest(1, before) > 0.3"))
def affected_pairs_filter(spark, d):
    """Pairs that a removal cuts or makes slower by three tenths, the least increase first."""
    inc = (F.col("after") - F.col("before")) / F.greatest(F.lit(1.0), F.col("before"))
    p = removal(spark, d).pairs.select("line", "f", "t", F.round(inc, 6).alias("increase"))
    return p.where("increase is null or increase > 0.3").sortWithinPartitions("increase")


@query(recursive("select g, component, groups, round(people, 2) people, island from isl", ISLANDS | {"lg": PARTS["lg"]}))
def cc_islands(spark, d):
    return _digits(K.islands(V.f2_net(spark, d)), "people", digits=2)


@query(removal_sql("select line, round(affected, 4) affected from af", ISLANDS, SCORES))
def island_affected(spark, d):
    return _digits(line_scores(spark, d).select("line", "affected"), "affected", digits=4)


@query(removal_sql("select line, round(score, 6) score, grade from gl", ISLANDS, SCORES))
def score_lines(spark, d):
    return _digits(line_scores(spark, d).select("line", "score", "grade"), "score")


@query(recursive("select line, region from (select lg.line, s.region, row_number() over (partition by lg.line order by count(*) desc, s.region) r from lg join f2_stop s on s.g = lg.g group by 1, 2) where r = 1", {"lg": PARTS["lg"]}))
def win_modal_value(spark, d):
    return K.main_region(V.f2_net(spark, d))


@query(removal_sql("select region, count(*) n from (select lg.line, s.region, row_number() over (partition by lg.line order by count(*) desc, s.region) r from lg join f2_stop s on s.g = lg.g group by 1, 2) join gl using (line) where r = 1 and grade = 3 group by 1", ISLANDS, SCORES))
def agg_region_very_lines(spark, d):
    very = line_scores(spark, d).where("grade = 3").select("line")
    return K.main_region(V.f2_net(spark, d)).join(very, "line", "left_semi").groupBy("region").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- stops

_W = "sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(36.2)), 2) + power((a.lat - b.lat) * 111320.0, 2))"
STOPS = {
    "ch": f"select a g, b alt, minutes m from f2_walk where b in (select g from lg) union all select a.g, b.g, {_W} * 1.25 / 75.0 from f2_stop a join f2_stop b on a.g <> b.g and {_W} <= 800 where a.g not in (select a from f2_walk) and b.g in (select g from lg)",
    "be": "select g, alt, round(m, 9) way from (select *, row_number() over (partition by g order by round(m, 9), alt) k from ch) where k = 1",
    "ll": "select lg.g, count(*) filter (where not exists (select 1 from ch join lg y on y.g = ch.alt where ch.g = lg.g and y.line = lg.line)) / count(*)::double loss from lg group by 1",
    "h": "select line, g from (select *, row_number() over (partition by g order by line) k from lg) where k <= 30",
    "mt": "select p.line l1, q.line l2, p.g h, q.g w from lg p join lg q on p.g = q.g union select p.line, q.line, p.g, q.g from lg p join f2_walk w on w.a = p.g join lg q on q.g = w.b",
    "tb": "select x.g, avg(case when exists (select 1 from mt where l1 = x.line and l2 = y.line and h <> x.g and w <> x.g) then 0.0::double else 1 end) tb from h x join h y on x.g = y.g and x.line < y.line group by 1",
    "x": """select s.scn, a.g f, b.g t, min(b.cum - a.cum + 5.0) m from f2_ps a join f2_ps b on a.pat = b.pat and a.pos < b.pos join scn s on a.g <> s.off and b.g <> s.off group by 1, 2, 3 union all select s.scn, w.a, w.b, w.minutes from f2_walk w join scn s on w.a <> s.off and w.b <> s.off""",
    "cl": "select f2.g, least(1, coalesce(way, 20) / 12.0) wp, loss, coalesce(tb, 0) tb, coalesce(alt, -1) alt, coalesce(way, 20.0) extra, coalesce(b.d, 0) b, coalesce(a.d, 0) a, case when coalesce(b.d, 0) > 0 then greatest(0, 1 - coalesce(a.d, 0) / b.d) when alt is null then 1 else 0 end acc from ll f2 left join be using (g) left join tb using (g) left join rd b on b.scn = -1 and b.origin = f2.g left join rd a on a.scn = f2.g and a.origin = f2.g",
    "ts": "select g, sum(trips) trips from lg join (select line, sum(trips) trips from (select distinct line, pat, trips from f2_ps) group by 1) using (line) group by 1",
    "dm": f"select cl.*, region, pop, lon, lat, {RANK.format('round(ln(1 + sqrt(greatest(pop, 0)) * trips), 9)')} share from cl join ts using (g) join f2_stop using (g)",
    "sg": "select *, round(100 * (wp * 0.3::double + acc * 0.25::double + loss * 0.15::double + tb * 0.15::double + share * 0.15::double), 9) score from dm",
    "gg": f"select *, {GRADE.format('score')} grade from sg",
}


def closure_sql(body: str) -> str:
    first = {"lg": PARTS["lg"], **{k: STOPS[k] for k in ("ch", "be", "ll", "h", "mt", "tb")}, "scn": "select distinct g scn, g off from lg union all select -1, -1", "x": STOPS["x"]}
    origins = {"o": "select g scn, g origin, alt g, way t0 from be where g in (select g from lg) union all select distinct -1, g, g, 0 from lg"}
    last = {"rd": MEASURES["rd"], **{k: STOPS[k] for k in ("cl", "ts", "dm", "sg", "gg")}}
    return recursive(body, first, origins, SEARCH.replace("<= 120", "<= 60 + 1e-9"), last)


@query(closure_sql("select g, round(wp, 6) walk_penalty, round(loss, 6) line_loss, round(tb, 6) transfer_break, alt alternative from cl"))
def stop_closure(spark, d):
    return _digits(closure(spark, d).select("g", "walk_penalty", "line_loss", "transfer_break", "alternative"), "walk_penalty", "line_loss", "transfer_break")


@query(closure_sql("select g, round(b, 3) as before, round(a, 3) as after, round(acc, 6) access_loss from cl"))
def stop_access_loss(spark, d):
    return closure(spark, d).select("g", F.round("access_before", 3).alias("before"), F.round("access_after", 3).alias("after"), F.round("access_loss", 6).alias("access_loss"))


@query(closure_sql("select g, round(score, 6) score, grade from gg"))
def score_stops(spark, d):
    return _digits(stop_scores(spark, d).select("g", "score", "grade"), "score")


_ROLL = "count(*) n, sum(pop) people, 0.5::double * case when sum(pop) > 0 then sum(score * pop) / sum(pop) else avg(score) end + 0.5::double * quantile_cont(score, 0.8) score, avg(case when grade >= 2 then 1.0::double else 0 end) weak"


@query(closure_sql(f"select region, n, round(people, 2) people, round(score, 6) score, round(weak, 6) weak, {GRADE.format('score')} grade from (select region, n, people, round(score, 9) score, weak from (select region, {_ROLL} from gg group by 1))"))
def agg_region(spark, d):
    r = region_scores(spark, d).select("region", "n", F.round("people", 2).alias("people"), "score", "weak", "grade")
    return _digits(r, "score", "weak")


@V.once
def region_scores(spark, d):
    return written(K.score_regions(V.f2_net(spark, d), stop_scores(spark, d), line_scores(spark, d)), "region_scores")


_CX, _CY = "cast(floor(({} - 124.0::double) / 0.05::double) as bigint)", "cast(floor(({} - 33.0::double) / 0.05::double) as bigint)"
_PTS = "select c_custkey id, 127.0::double + (c_custkey % 10) * 0.004::double + (c_custkey % 7) * 0.0007::double lon, 36.0::double + (c_custkey % 11) * 0.004::double + (c_custkey % 5) * 0.0011::double lat from customer"


@query(closure_sql(f"""select cx, cy, s.score, coalesce(n, 0) n, coalesce(people, 0) people, coalesce(u.unserved, 0) unserved, cast(case when s.score < 0 then 4 else (s.score >= t1)::int + (s.score >= t2)::int + (s.score >= t3)::int end as int) grade
from (select coalesce(c.cx, l.cx) cx, coalesce(c.cy, l.cy) cy, coalesce(c.score, -1) score, n, people from (select {_CX.format('lon')} cx, {_CY.format('lat')} cy, n, round(people, 1) people, round(score, 2) score from (select {_CX.format('lon')} * 0.05::double + 124.025 lon, {_CY.format('lat')} * 0.05::double + 33.025 lat, {_ROLL} from gg group by 1, 2)) c full join (select 59 + r_regionkey cx, 60 cy from region) l on l.cx = c.cx and l.cy = c.cy) s
left join (select {_CX.format('lon + 0.03')} cx, {_CY.format('lat')} cy, round(sum(id % 10)::double, 1) unserved from ({_PTS}) group by 1, 2) u using (cx, cy),
(select round(quantile_cont(score, 0.5), 2) t1, round(quantile_cont(score, 0.8), 2) t2, round(quantile_cont(score, 0.95), 2) t3 from (select round(score, 2) score from (select {_CX.format('lon')} a, {_CY.format('lat')} b, {_ROLL} from gg group by 1, 2)))"""))
def agg_grid(spark, d):
    from stopgrid.catalog.relational import _pts

    land = V.read(spark, d, "region").select((59 + F.col("r_regionkey")).cast("long").alias("cx"), F.lit(60).cast("long").alias("cy"))
    lost = _pts(spark, d).select((F.col("lon") + 0.03).alias("lon"), "lat", (F.col("id") % 10).cast("double").alias("people"))
    return K.score_grid(V.f2_net(spark, d), stop_scores(spark, d), land, lost)


@query(removal_sql("select count(*) filter (where disc / n >= 0.3 or no_alt >= 0.3) isolating_lines, count(*) filter (where grade = 3) very_lines from gl", ISLANDS, SCORES))
def agg_kpis(spark, d):
    return K.kpis(V.f2_net(spark, d), region_scores(spark, d), line_scores(spark, d)).select("isolating_lines", "very_lines")


@query(closure_sql(f"select count(*) filter (where grade = 3) very_regions, round(coalesce(sum(people) filter (where grade = 3), 0), 2) very_people from (select *, {GRADE.format('score')} grade from (select region, people, round(score, 9) score from (select region, {_ROLL} from gg group by 1)))"))
def agg_region_kpis(spark, d):
    return K.kpis(V.f2_net(spark, d), region_scores(spark, d), line_scores(spark, d)).select("very_regions", F.round("very_people", 2).alias("very_people"))


# ---------------------------------------------------------------- segments

@V.once
def segment_scores(spark, d):
    net = V.f2_net(spark, d)
    return written(K.score_segments(net, M.segment_removal(net), line_scores(spark, d)), "segment_scores")


#: An undirected edge, its rides and the way round it, of at most two more rides, on the grid.
SEGMENTS = {
    "hp": "select line, pat, pos, g, trips, lead(g) over (partition by pat order by pos) nxt from f2_ps",
    "sgm": "select least(g, nxt) a, greatest(g, nxt) b, sum(trips) trips from hp where nxt is not null group by 1, 2",
    "cut": "select distinct sgm.a, sgm.b, pat, pos from sgm join hp on least(g, nxt) = a and greatest(g, nxt) = b",
    "x": "select s.a sa, s.b sb, p.g f, q.g t, min(q.cum - p.cum + 5.0) m from sgm s cross join f2_ps p join f2_ps q on q.pat = p.pat and q.pos > p.pos where not exists (select 1 from cut c where c.a = s.a and c.b = s.b and c.pat = p.pat and c.pos >= p.pos and c.pos < q.pos) group by 1, 2, 3, 4 union all select s.a, s.b, w.a, w.b, w.minutes from sgm s cross join f2_walk w",
}
SEGMENT_SEARCH = """r(sa, sb, g, m) using key (sa, sb, g) as (select a::bigint, b::bigint, a::bigint, 0::double from sgm union
select n.sa, n.sb, n.g, n.m from (select r.sa, r.sb, x.t g, min(r.m + x.m) m from r join x on x.sa = r.sa and x.sb = r.sb and x.f = r.g where r.m + x.m <= 68 group by 1, 2, 3) n left join recurring.r q on q.sa = n.sa and q.sb = n.sb and q.g = n.g where q.m is null or n.m < q.m - 1e-9)"""
DETOURS = {"dt": "select sgm.a, sgm.b, trips, case when m is null then 1 else least(1, greatest(0, m - direct) / 30.0) end detour from (select *, case when exists (select 1 from hp where hp.g = b and nxt = a) then 6 else 8 end direct from sgm) sgm left join r on r.sa = a and r.sb = b and r.g = b and m <= direct + 60 + 1e-9"}


@query(recursive("select a, b, trips, round(detour, 6) detour from dt", SEGMENTS, SEGMENT_SEARCH, DETOURS, views=("f2_ps", "f2_walk")))
def segment_removal(spark, d):
    return _digits(segment_scores(spark, d).select("a", "b", "trips", "detour"), "detour")


@query(removal_sql("select least(g, nxt) a, greatest(g, nxt) b, round(max(score) / 100, 6) risk from (select line, g, lead(g) over (partition by pat order by pos) nxt from f2_ps) join gl using (line) where nxt is not null group by 1, 2", ISLANDS, SCORES))
def join_edge_lines_max(spark, d):
    """The highest score of the lines on each undirected edge."""
    return K.line_risk(V.f2_net(spark, d), line_scores(spark, d)).select("a", "b", F.round("line_risk", 6).alias("risk"))


@query()
def score_segments(spark, d):
    return _digits(segment_scores(spark, d).select("a", "b", "score", "grade"), "score")


@query(removal_sql("select least(g, nxt) a, greatest(g, nxt) b, arg_max(line, struct_pack(g := grade, n := case when mode >= 2 then 0 else 1 end, i := -line)) line, max(grade) grade from (select line, mode, g, lead(g) over (partition by pat order by pos) nxt from f2_ps) join gl using (line) where nxt is not null group by 1, 2", ISLANDS, SCORES))
def segment_dedupe_by_grade(spark, d):
    return K.segment_grades(V.f2_net(spark, d), line_scores(spark, d))


@query(closure_sql("select cast(floor(x / 0.00005) as bigint) cx, cast(floor(y / 0.00005) as bigint) cy, arg_max(g, struct_pack(a := grade, b := score, c := g)) id from (select *, (lon + 180) / 360 x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 y from gg) group by 1, 2"))
def lod_cell_max(spark, d):
    """Of the groups in each cell of a drawing the one of the highest grade."""
    from stopgrid.functions.geo import mercator_x, mercator_y

    p = stop_scores(spark, d).join(V.f2_stop(spark, d).select("g", "lon", "lat"), "g")
    return K.cell_best(p.select(F.col("g").alias("id"), "grade", "score", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y")), 0.00005)


# ---------------------------------------------------------------- journeys

_ALL = """e as (select a.g f, b.g t, min(b.cum - a.cum + 5.0) m from f2_ps a join f2_ps b on a.pat = b.pat and a.pos < b.pos group by 1, 2 union all select a, b, minutes from f2_walk),
j(o, g, m) using key (o, g) as (select g::bigint, g::bigint, 0::double from f2_stop union
select n.o, n.g, n.m from (select j.o, e.t g, min(j.m + e.m) m from j join e on e.f = j.g where j.m + e.m <= 600 group by 1, 2) n left join recurring.j q on q.o = n.o and q.g = n.g where q.m is null or n.m < q.m - 1e-9)"""


def _trips(spark, d):
    return V.f2_trip(spark, d).withColumn("scn", F.lit(0).cast("long"))


@query(recursive("select p.f, p.t, round(m, 4) m from f2_trip p join j on j.o = p.f and j.g = p.t", _ALL, views=("f2_stop", "f2_ps", "f2_walk", "f2_trip")))
def journey(spark, d):
    return M.journey(V.f2_net(spark, d), _trips(spark, d)).where("m is not null").select("f", "t", F.round("m", 4).alias("m"))


@query()
def path_legs(spark, d):
    return M.journey_legs(V.f2_net(spark, d), _trips(spark, d)).withColumn("tf", F.round("tf", 4))


@query()
def journey_resilience(spark, d):
    return M.journey_resilience(V.f2_net(spark, d), _trips(spark, d)).withColumn("after", F.round("after", 4)).withColumn("increase", F.round("increase", 6))


@query(V.with_views("select a.pat, a.pos p1, b.pos p2 from f2_ps a join f2_ps b on a.pat = b.pat and a.pos < b.pos where a.g = 2 and b.g = 8 order by a.pat limit 1", "f2_ps"))
def od_pair_path(spark, d):
    """The first pattern that runs from one group to another."""
    ps = V.f2_ps(spark, d)
    a, b = ps.where("g = 2").select("pat", F.col("pos").alias("p1")), ps.where("g = 8").select("pat", F.col("pos").alias("p2"))
    return a.join(b, "pat").where("p1 < p2").orderBy("pat").limit(1)


@query(closure_sql("select g, region, r as rank from (select g, region, row_number() over (partition by region order by round(score, 6) desc, g) r from gg)"))
def win_dense_order_rank(spark, d):
    s = stop_scores(spark, d).join(V.f2_stop(spark, d).select("g", "region"), "g").withColumn("score", F.round("score", 6))
    return K.numbered(s, ["region"], "g").select("g", "region", "rank")


@query(closure_sql("select g, region, r as rank from (select g, region, row_number() over (partition by region order by round(score, 6) desc, g) r from gg) where r <= 6"))
def topk_region_members(spark, d):
    s = stop_scores(spark, d).join(V.f2_stop(spark, d).select("g", "region"), "g").withColumn("score", F.round("score", 6))
    return R.top_per(s.select("g", "region", "score"), ["region"], [F.desc("score"), "g"], 6).drop("score")
