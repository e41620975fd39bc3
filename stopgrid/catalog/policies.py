"""Policies on the grid network, and portfolios of items made of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.catalog.removals import ISLANDS, MEASURES, PARTS, SCORES, SEARCH, closure, line_scores, lines, recursive, removal
from stopgrid.operators import ranks as R
from stopgrid.plans import policies as Q
from stopgrid.plans import simulation as M
from stopgrid.plans.storage import written

_LG = {"lg": PARTS["lg"]}


@query(recursive("select distinct x.line, y.line other from lg x join lg y on y.line <> x.line and (y.g = x.g or exists (select 1 from f2_walk w where w.a = x.g and w.b = y.g))", _LG))
def policy_frequency(spark, d):
    return Q.touched_lines(V.f2_net(spark, d))


_H = "2 * 6371000.0 * asin(sqrt(power(sin(radians(s2.lat - s1.lat) / 2), 2) + cos(radians(s1.lat)) * cos(radians(s2.lat)) * power(sin(radians(s2.lon - s1.lon) / 2), 2))) / 1000"
#: Targets; what is reached without ferries; the nearest group of another line.
LINKS = {
    "tg": "select line, g from (select line, g, row_number() over (partition by line order by nth, g) k from (select line, g, g nth from st union all select line, f, min(nth) from pr where (after is null or after > 1.3 * before) and line not in (select line from st) group by 1, 2)) where k <= 30",
    "e2": "select a.g f, b.g t, min(b.cum - a.cum + 5.0) m from f2_ps a join f2_ps b on a.pat = b.pat and a.pos < b.pos and a.mode <> 2 group by 1, 2 union all select a, b, minutes from f2_walk",
}
REACH = """j(o, g, m) using key (o, g) as (select distinct g::bigint, g::bigint, 0::double from tg union
select n.o, n.g, n.m from (select j.o, e2.t g, min(j.m + e2.m) m from j join e2 on e2.f = j.g where j.m + e2.m <= 120 group by 1, 2) n left join recurring.j q on q.o = n.o and q.g = n.g where q.m is null or n.m < q.m - 1e-9)"""


def _links_sql(km, speed, wait):
    way = f"select * from (select t.line, t.g, y.g too, y.line via, round({_H}, 9) km, row_number() over (partition by t.line, t.g order by round({_H}, 9), y.g, y.line) k from tg t join f2_stop s1 on s1.g = t.g join lg y on y.line <> t.line and y.g <> t.g join f2_stop s2 on s2.g = y.g join j on j.o = t.g and j.g = y.g where t.line not in (select line from f2_ps where mode = 2) and round({_H}, 9) < {km}) where k = 1"
    return recursive(f'select line, g, too "to", via, round(km, 6) km, round(km * 1.3 / {speed} * 60 + {wait}, 5) as mins from way', PARTS, SEARCH, MEASURES, LINKS, REACH, {"way": way})


def _links(spark, d, kind, km, wait):
    found = Q.links(V.f2_net(spark, d), Q.targets(removal(spark, d)), [(kind, km, wait)])
    return found.select("line", "g", "to", "via", F.round("km", 6).alias("km"), F.round("minutes", 5).alias("mins"))


@query(_links_sql(3.0, 25, 10.0))
def policy_drt(spark, d):
    return _links(spark, d, Q.DRT, 3.0, 10.0)


@query(_links_sql(2.0, 20, 5.0))
def policy_extension(spark, d):
    return _links(spark, d, Q.EXTENSION, 2.0, 0.0)


@query(_links_sql(3.0, 25, 10.0).replace('select line, g, too "to", via, round(km, 6) km, round(km * 1.3 / 25 * 60 + 10.0, 5) as mins from way', "select line, count(*) links, round(sum(km), 2) link_km, round(max(km * 1.3 / 25 * 60 + 10.0), 1) link_max_min, array_to_string(list_sort(list(distinct via)), ',') via from way group by 1"))
def link_summary(spark, d):
    found = Q.links(V.f2_net(spark, d), Q.targets(removal(spark, d)), [(Q.DRT, 3.0, 10.0)])
    return Q.link_summary(found, "line").withColumn("via", F.array_join(F.transform("via", lambda x: x.cast("string")), ","))


@V.once
def evaluated(spark, d):
    """Every candidate policy of every vulnerable line, with its cost and gains."""
    net, trips = V.f2_net(spark, d), lines(spark, d)
    weak = line_scores(spark, d).where("grade >= 2").select("line")
    got = Q.evaluate(net, Q.candidates(weak), removal(spark, d))
    carbon = Q.sample_trip_km(net).select("line", F.col("km").alias("trip_km"), F.lit(P.TRIPS_A_DAY / P.RETURN_SHARE * P.TRANSIT_SHARE[2]).alias("transit"), F.lit(0.4).alias("cars"), F.lit(0.17).alias("kg"), F.lit(0.19).alias("kg_all"))
    return written(Q.gains(got, Q.costs(got, Q.line_vehicles(net, trips)), line_scores(spark, d), carbon), "gains")


@query(recursive("select f.line, k.combo from gl f, range(35) k(combo) where grade >= 2", PARTS, SEARCH, MEASURES, ISLANDS, SCORES))
def cross_candidates(spark, d):
    """Each vulnerable line with each combination of policies."""
    weak = line_scores(spark, d).where("grade >= 2").select("line")
    return Q.candidates(weak).select("line", "combo")


def _policy(spark, d):
    keep = ["scn", "line", "freq", "kind", "km", "wait", "feasible", "links", "link_km", "link_max_min"]
    rounded = ["b_time_increase", "a_time_increase", "a_access_loss", "a_no_alternative", "a_connectivity", "saved", "benefit", "cost", "score_before", "score_after", "co2_mid"]
    return evaluated(spark, d).select(*keep, *[F.round(c, 6).alias(c) for c in rounded])


@query()
def policy_combo(spark, d):
    return _policy(spark, d)


@query()
def policy_temp_stop(spark, d):
    """Every group closed, with a temporary stop 150 metres away."""
    c = M.stop_closure(V.f2_net(spark, d), temporary_m=150.0).select("g", "walk_penalty", "access_loss", "line_loss", "transfer_break")
    was = closure(spark, d).select("g", F.col("access_loss").alias("without"))
    return c.join(was, "g").select("g", *[F.round(x, 6).alias(x) for x in ("walk_penalty", "access_loss", "line_loss", "transfer_break", "without")])


# ---------------------------------------------------------------- budgets


def _items(spark, d):
    o = V.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("item"), F.round(F.col("o_totalprice") / 1000, 3).alias("benefit"), (10.0 + F.col("o_orderkey") % 37).alias("cost"))


_ITEMS = "it as (select o_custkey line, o_orderkey item, round(o_totalprice / 1000, 3) benefit, (10 + o_orderkey % 37)::double as cost from orders where round(o_totalprice / 1000, 3) > 0)"


def _greedy(items: str, name: str = "", scale: float = 1.0) -> str:
    """Parts of SQL: ``ch``: the items chosen, one more for each budget in a step."""
    rk, g, ch = f"rk{name}", f"gr{name}", f"ch{name}"
    return f"""{rk} as materialized (select *, row_number() over (order by round(benefit / cost, 9) desc, line, item) rk from {items}),
{g}(budget, rk, spent, used) as (select b::double * {scale}::double, 0::bigint, 0::double, []::bigint[] from (values (20), (50), (100), (200), (500)) t(b) union all
select n.budget, n.rk, n.spent + i.cost, list_append(n.used, i.line::bigint) from (select {g}.budget, {g}.spent, {g}.used, min(i.rk) rk from {g} join {rk} i on i.rk > {g}.rk and {g}.spent + i.cost <= {g}.budget and not list_contains({g}.used, i.line::bigint) group by 1, 2, 3) n join {rk} i on i.rk = n.rk),
{ch} as (select {g}.budget, i.line, i.item, i.benefit, i.cost, {g}.spent from {g} join {rk} i on i.rk = {g}.rk)"""


_CHOSEN = f"with recursive {_ITEMS}, {_greedy('it')} "


@query(_CHOSEN + "select budget, line, item, benefit, cost, spent from ch")
def greedy_budget(spark, d):
    return R.greedy_budget(_items(spark, d), P.BUDGETS).select("budget", "line", "item", "benefit", "cost", "spent")


@query(_CHOSEN + "select budget, count(*) lines, round(sum(benefit), 3) benefit, max(spent) spent from ch group by 1")
def agg_portfolio(spark, d):
    return Q.portfolio(R.greedy_budget(_items(spark, d), P.BUDGETS)).withColumn("benefit", F.round("benefit", 3))


@query()
def policy_portfolio(spark, d):
    """The portfolios of the evaluated candidates: people, emissions, kinds."""
    items = evaluated(spark, d).withColumnRenamed("scn", "item")
    out = Q.portfolio(R.greedy_budget(items, P.BUDGETS))
    return out.select("budget", "lines", *[F.round(c, 4).alias(c) for c in ("benefit", "spent", "saved", "co2_low", "co2_mid", "co2_high")], "drt", "extension", "frequency", "combined")


@query(f"with recursive {_ITEMS}, {_greedy('it', 'a', 0.5)}, {_greedy('(select * from it where item % 5 < 2)', 'b', 0.5)}, {_greedy('(select * from it where item % 5 = 2)', 'c', 0.5)} " + """select a.budget * 2 budget, round(a.s, 3) optimal, round(coalesce(b.s, 0), 3) as found, round(coalesce(c.s, 0), 3) random, round(coalesce(b.s, 0) / a.s, 6) share, round(coalesce(c.s, 0) / a.s, 6) random_share
from (select budget, sum(benefit) s from cha group by 1) a left join (select budget, sum(benefit) s from chb group by 1) b using (budget) left join (select budget, sum(benefit) s from chc group by 1) c using (budget)""")
def agg_capture(spark, d):
    """Benefit within half of each budget of two fifths of the items, and of another fifth, against all."""
    items = _items(spark, d)
    got = Q.capture(items, items.where("item % 5 < 2"), items.where("item % 5 = 2"), P.BUDGETS, 0.5)
    return got.select("budget", *[F.round(c, 3).alias(c) for c in ("optimal", "found", "random")], *[F.round(c, 6).alias(c) for c in ("share", "random_share")])


@query(_CHOSEN + "select budget, item, r as rank from (select budget, item, row_number() over (partition by budget order by round(benefit / cost, 9) desc, item) r from ch) where r <= 8")
def topk_portfolio_items(spark, d):
    got = R.greedy_budget(_items(spark, d), P.BUDGETS).withColumn("ratio", F.round(F.col("benefit") / F.col("cost"), 9))
    return R.top_per(got, ["budget"], [F.desc("ratio"), "item"], 8).select("budget", "item", "rank")


@query(_CHOSEN + "select budget, item, place from ch join (select item, row_number() over (order by ratio desc, item) - 1 place from (select distinct item, round(benefit / cost, 9) ratio from ch)) using (item)")
def portfolio_item_index(spark, d):
    return Q.item_index(R.greedy_budget(_items(spark, d), P.BUDGETS))


@query("select item from (select o_orderkey item, row_number() over (order by round(o_totalprice / (1 + o_orderkey % 37), 9) desc, o_orderkey) r, count(*) over () n from orders where o_totalprice > 50) where r <= floor(n * 0.1::double)")
def topk_shortlist(spark, d):
    """The tenth of the items of the highest predicted ratio."""
    o = V.read(spark, d, "orders").where("o_totalprice > 50").select(F.col("o_orderkey").alias("item"), F.round(F.col("o_totalprice") / (1 + F.col("o_orderkey") % 37), 9).alias("ratio"))
    return R.top_share(o, P.SHORTLIST_SHARE, ["ratio"], ["item"]).select("item")


@query(V.with_views("""select line, round(km, 4) km from (select line, avg(c2 - c1) km from (select pr.line, x.km c1, y.km c2 from pr join along x on x.pat = pr.pat and x.pos = pr.i join along y on y.pat = pr.pat and y.pos = pr.j where j > i) group by 1)""", "f2_stop", "f2_ps").replace(
    ") select line, round(km", """), mn as (select line, pat, n from (select line, pat, count(*) n, row_number() over (partition by line order by count(*) desc, pat) k from f2_ps group by 1, 2) where k = 1),
along as (select pat, pos, sum(step) over (partition by pat order by pos) km from (select p.pat, p.pos, coalesce(2 * 6371000.0 * asin(sqrt(power(sin(radians(s.lat - lag(s.lat) over w) / 2), 2) + cos(radians(lag(s.lat) over w)) * cos(radians(s.lat)) * power(sin(radians(s.lon - lag(s.lon) over w) / 2), 2))) / 1000, 0) step from f2_ps p join mn on mn.pat = p.pat join f2_stop s on s.g = p.g window w as (partition by p.pat order by p.pos))),
sm as (select line, pat, list_distinct([round_even((n - 1) * x, 0)::bigint for x in [0, 0.25, 0.5, 0.75, 1]]) l, list_sort(l) s from mn),
pr as (select line, pat, s[i] i, s[i + 1] j from sm, range(1, 5) t(i) where i < len(s) union all select line, pat, s[1], s[len(s) // 2 + 1] from sm union all select line, pat, s[len(s) // 2 + 1], s[len(s)] from sm) select line, round(km""", 1))
def sample_trip_km(spark, d):
    return Q.sample_trip_km(V.f2_net(spark, d)).withColumn("km", F.round("km", 4))
