"""Models and statistics over the grid network's scores and the evaluated policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid import views as V
from stopgrid.catalog import query
from stopgrid.catalog.policies import evaluated
from stopgrid.catalog.removals import ISLANDS, SCORES, closure, closure_sql, line_scores, recursive, removal, removal_sql, stop_scores
from stopgrid.operators import learn as L
from stopgrid.operators import ranks as R
from stopgrid.operators import spatial as X
from stopgrid.plans import network as N
from stopgrid.plans import policies as Q
from stopgrid.plans.simulation import Net
from stopgrid.plans.storage import written

_D2 = "sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(36.2)), 2) + power((a.lat - b.lat) * 111320.0, 2))"
_HAV = "2 * 6371000.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"


@V.once
def network(spark, d):
    """The grid with the distance to the nearest other group, and its line table."""
    net = V.f2_net(spark, d)
    near = X.nearest_other(net.groups.select("g", "lon", "lat")).select("g", F.round("dist", 1).alias("nearest_other_m"))
    groups = written(net.groups.join(near, "g", "left").withColumn("stops_in_group", 1 + F.col("g") % 3), "groups")
    pats = net.stops.select("pat", F.concat(F.lit("L"), (F.col("line") % 7).cast("string")).alias("name"), F.col("mode").cast("int").alias("mode"), "trips").distinct()
    return Net(net.stops, net.walks, groups), written(N.line_table(pats, net.stops, groups), "lines")


#: The line table and the features in SQL.
TABLE = {
    "lg": "select distinct line, g from f2_ps",
    "nr": f"select a.g, round(min({_D2}), 1) m from f2_stop a join f2_stop b on a.g <> b.g group by 1",
    "mp": "select line, pat from (select line, pat, row_number() over (partition by line order by count(*) desc, pat) k from f2_ps group by 1, 2) where k = 1",
    "km": f"select line, round(coalesce(sum(m), 0) / 1000, 2) length_km from (select p.line, {_HAV} m from (select line, pat, g, lead(g) over (partition by pat order by pos) nxt from f2_ps) p join mp using (line, pat) join f2_stop a on a.g = p.g join f2_stop b on b.g = p.nxt) group by 1",
    "tr": "select line, round(sum(trips), 2) trips, count(*) n_patterns from (select distinct line, pat, trips from f2_ps) group by 1",
    "rg": "select line, region from (select line, region, row_number() over (partition by line order by count(*) desc, region) k from lg join f2_stop using (g) group by 1, 2) where k = 1",
    "lt": "select line, 'L' || (line % 7)::varchar as name, min(mode) as mode, any_value(trips) trips, any_value(n_patterns) n_patterns, count(distinct g) n_groups, any_value(length_km) length_km, any_value(rg.region) region, count(distinct s.region) spans from lg join (select distinct line, mode from f2_ps) using (line) join tr using (line) join km using (line) join rg using (line) join f2_stop s using (g) group by 1",
}


@query(recursive("select line, name, cast(mode as int) as mode, trips, n_patterns, n_groups, length_km, region, spans from lt", TABLE))
def agg_line(spark, d):
    return network(spark, d)[1].select("line", "name", "mode", "trips", "n_patterns", "n_groups", "length_km", "region", "spans")


@query(recursive("""select line, round(ln(1 + any_value(lt.trips)), 6) log_trips, any_value(n_groups)::double n_groups, any_value(length_km) length_km, round(avg(ln(1 + m)), 6) mean_nearest, round(avg(o.n - 1), 6) mean_other_lines, round(avg(case when o.n = 1 then 1.0::double else 0 end), 6) single_line_share, round(avg(coalesce(w.n, 0)), 6) mean_walks,
(any_value(lt.mode) = 2)::int::double is_ferry, (any_value(lt.mode) >= 2)::int::double is_long, (any_value(lt.mode) = 1)::int::double is_metro from lg join lt using (line) join nr using (g) join (select g, count(*) n from lg group by 1) o using (g) left join (select a g, count(*) n from f2_walk group by 1) w using (g) group by 1""", TABLE))
def ml_line_features(spark, d):
    net, lines = network(spark, d)
    f = N.line_features(net, lines)
    return f.select("line", *[F.round(c, 6).alias(c) for c in N.LINE_FEATURES])


@query(recursive("""select g, round(ln(1 + any_value(m)), 6) log_nearest, coalesce(any_value(w.n), 0)::double walks, count(distinct line)::double n_lines, round(ln(1 + sum(trips)), 6) log_trips, bit_count(bit_or(cast(1 << lt.mode as bigint)))::double n_modes, case when any_value(dest) > 0 then 1.0::double else 0 end is_hub, (1 + g % 3)::double stops_in_group
from lg join lt using (line) join nr using (g) join f2_stop using (g) left join (select a g, count(*) n from f2_walk group by 1) w using (g) group by 1""", TABLE))
def ml_stop_features(spark, d):
    net, lines = network(spark, d)
    return N.stop_features(net, lines).select("g", *[F.round(c, 6).alias(c) for c in N.STOP_FEATURES])


@V.once
def _explained(spark, d):
    net, lines = network(spark, d)
    x = written(N.stop_features(net, lines).join(stop_scores(spark, d).select("g", "score"), "g"), "explained")
    return L.explain(x, N.STOP_FEATURES, "score", "g")


@query()
def ml_explainer(spark, d):
    """How well the stops' scores are explained by what they are, held out in five folds, and what counts most."""
    quality, importance, _ = _explained(spark, d)
    return importance.crossJoin(F.broadcast(quality))  # one row


@query()
def win_top3_drivers(spark, d):
    """The three features that add or take most of each stop's score, with their values."""
    return _explained(spark, d)[2]


@query()
def ml_surrogate_access(spark, d):
    """The access loss of stops that weren't simulated, from those that were: a stratified sample of half."""
    net, lines = network(spark, d)
    c = closure(spark, d).select("g", "access_loss", "walk_penalty", "line_loss", "transfer_break")
    x = written(N.stop_features(net, lines).join(c, "g"), "surrogate")
    some = L.stratified_sample(x.withColumn("s1", F.least(F.lit(4.0), F.col("n_lines"))), ["s1", "is_hub"], "g", max(1, x.count() // 2), least=5).select("g", F.lit(1).alias("exact"))
    y = written(x.join(some, "g", "left").withColumn("access_loss", F.when(F.col("exact") == 1, F.col("access_loss"))), "sampled")
    return L.predict_missing(y, [*N.STOP_FEATURES, "walk_penalty", "line_loss", "transfer_break"], "access_loss").select("g", "access_loss", "source")


@query("""select o_orderkey from (select o_orderkey, k, row_number() over (partition by s, t order by o_orderkey) r from (select o_orderkey, least(4, o_custkey % 6) s, o_orderkey % 2 t, greatest(20, floor(6000.0::double * count(*) over (partition by least(4, o_custkey % 6), o_orderkey % 2) / count(*) over () + 0.5)) k from orders)) where r <= k""")
def ml_stratified_sample(spark, d):
    """About 6000 rows over ten strata; here in the order of the key, as SQL has no such hash."""
    o = V.read(spark, d, "orders").select("o_orderkey", F.least(F.lit(4), F.col("o_custkey") % 6).alias("s"), (F.col("o_orderkey") % 2).alias("t"))
    n = o.count()
    sizes = o.groupBy("s", "t").agg(F.greatest(F.lit(20), F.floor(6000.0 * F.count("*") / n + 0.5)).alias("k"))
    return R.top_per(o.join(F.broadcast(sizes), ["s", "t"]), ["s", "t"], ["o_orderkey"], 6020, "r").where("r <= k").select("o_orderkey")


@V.once
def _types(spark, d):
    lines = line_scores(spark, d).join(network(spark, d)[1].select("line", "mode", "trips"), "line")
    return L.clusters(L.profiles(lines), L.PROFILE)


@query()
def ml_kmeans_types(spark, d):
    """Types of vulnerability over all lines: their centres, sizes, names and what they ask for."""
    centres = written(L.centre_table(_types(spark, d), L.PROFILE), "centres")
    remedy = F.create_map(*[F.lit(x) for kv in L.REMEDIES.items() for x in kv])
    return centres.join(L.named_types(centres), "cluster").withColumn("remedy", remedy[F.col("type")])


@query()
def cluster_representative(spark, d):
    return L.representatives(_types(spark, d))


#: Fifteen features of a line and five of a combination.
_LINE = ["b_time_increase", "b_access_loss", "b_no_alternative", "b_connectivity", "affected_share", "n_stranded", "stranded_near", "log_trips", "n_groups", "length_km", "is_ferry", "is_long", "cluster", "log_vehicles", "log_affected"]
_COMBO = ["freq", "is_drt", "is_extension", "km", "wait"]


@V.once
def candidates(spark, d):
    """Every evaluated candidate with its features; ``train`` marks a tenth of them, ``valid`` those of a part of the lines."""
    net, lines = network(spark, d)
    r = removal(spark, d)
    near = r.stranded.join(net.groups.select("g", "nearest_other_m"), "g").groupBy("line").agg(F.count("*").alias("n_stranded"), F.avg("nearest_other_m").alias("stranded_near"))
    v = Q.line_vehicles(net, lines).select("line", F.log1p("vehicles").alias("log_vehicles"))
    f = N.line_features(net, lines).select("line", "log_trips", "n_groups", "length_km", "is_ferry", "is_long")
    x = evaluated(spark, d).join(near, "line", "left").fillna(0, ["n_stranded"]).fillna(0.0, ["stranded_near"]).join(v, "line").join(f, "line")
    x = x.join(_types(spark, d).select("line", "cluster"), "line", "left").fillna(-1, ["cluster"]).withColumn("log_affected", F.log1p("affected"))
    x = x.withColumn("is_drt", (F.col("kind") == Q.DRT).cast("int")).withColumn("is_extension", (F.col("kind") == Q.EXTENSION).cast("int"))
    by = lambda c, share, k: F.pmod(F.xxhash64(F.lit(k), c), F.lit(1000)) < int(1000 * share)
    x = x.withColumn("train", by("scn", P.TRAIN_SHARE, 1)).withColumn("valid", by("line", max(P.VALIDATION_SHARE, 0.3), 2))
    return written(x.withColumn("log_ratio", F.log((F.col("benefit") + 0.1) / (F.col("cost") + 0.01))).withColumn("log_benefit", F.log1p("benefit")), "candidates")


@V.once
def searched(spark, d):
    """Candidates with both predictions, and whether they would be evaluated: the training tenth and the shortlist."""
    x = candidates(spark, d)
    t = x.where("train")
    for label, out in (("log_ratio", "p_ratio"), ("log_benefit", "p_benefit")):
        x = L.predicted(*L.gbt(t, [*_LINE, *_COMBO], label), x, out)
    x = written(x.withColumn("p_benefit", F.expm1("p_benefit")), "predicted")
    n = int(x.count() * P.SHORTLIST_SHARE)
    rest = R.numbered_all(x.where(~F.col("train") & (F.col("p_benefit") > P.SHORTLIST_LEAST)).select("scn", "p_ratio"), ["p_ratio"], ["scn"])
    short = rest.where(F.col("place") < n).select("scn", F.lit(True).alias("short"))
    return written(x.join(short, "scn", "left").withColumn("chosen", F.col("train") | F.coalesce("short", F.lit(False))), "searched")


@query()
def ml_policy_surrogate(spark, d):
    return searched(spark, d).select("scn", F.round("p_ratio", 4).alias("p_ratio"), F.round("p_benefit", 4).alias("p_benefit"), "train", "chosen")


@query()
def ml_validate_capture(spark, d):
    """Within each budget, the benefit that the search and as many random candidates capture; with the quality on candidates held out."""
    x = searched(spark, d).withColumnRenamed("scn", "item")
    held = x.where("not train").withColumn("p", F.log1p(F.greatest(F.col("p_benefit"), F.lit(-0.99))))
    quality = L.fit_quality(held, "log_benefit", "p").select(F.col("r2").alias("r2_holdout"))
    rho = R.spearman(held.select(F.round("benefit", 9).alias("b"), F.round("p_benefit", 9).alias("p")), "b", "p").withColumnRenamed("rho", "spearman_holdout")
    share = x.agg(F.avg(F.col("chosen").cast("double"))).first()[0] or 0.0
    random = x.where(F.pmod(F.xxhash64(F.lit(5), "item"), F.lit(10_000)) < int(10_000 * share)).select("item")
    got = Q.capture(x.select("line", "item", "benefit", "cost"), x.where("chosen").select("item"), random, P.BUDGETS)
    return got.crossJoin(F.broadcast(quality)).crossJoin(F.broadcast(rho))  # one row each


@query()
def ml_policy_insights(spark, d):
    """What makes on-demand links and extensions work, over all feasible candidates."""
    x, out = candidates(spark, d).where("feasible"), None
    _, model = L.gbt(candidates(spark, d), [*_LINE, *_COMBO], "log_benefit")
    for kind, flag in (("drt", "is_drt"), ("extension", "is_extension")):
        some = x.where(f"{flag} = 1")
        if not some.isEmpty():
            got = L.drivers_of(some, [*_LINE, *_COMBO], model).where(F.col("feature").isin(*_LINE)).orderBy(F.desc("importance"), "feature").limit(3).withColumn("kind", F.lit(kind))
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "feature string, importance double, direction double, kind string")


# ---------------------------------------------------------------- statistics

_DRAWS = L.weight_draws(P.LINE_WEIGHTS)
_VALUES = ", ".join(str(x) for x in _DRAWS)
_PARTS = ["time_increase", "access_loss", "no_alternative", "connectivity", "affected_share"]
_SENSITIVE = {
    "w(draw, w0, w1, w2, w3, w4)": f"values {_VALUES}",
    "ws": "select draw, line, sl.score base, round((ti * w0 + acc * w1 + no_alt * w2 + conn * w3 + share * w4)::double / (w0 + w1 + w2 + w3 + w4)::double, 9) s from sl, w",
    "wr": "select draw, line, rank() over (partition by draw order by s) + (count(*) over (partition by draw, s) - 1) / 2.0::double rs, rank() over (partition by draw order by base) + (count(*) over (partition by draw, base) - 1) / 2.0::double rb, row_number() over (partition by draw order by s desc, line) ps, row_number() over (partition by draw order by base desc, line) pb, greatest(1, floor(count(*) over (partition by draw) * 0.05::double)) n from ws",
    "wd": "select draw, corr(rs, rb) rho, count(*) filter (where ps <= n and pb <= n) / max(n)::double kept from wr group by 1",
}


def _sensitivity(spark, d):
    draws = spark.createDataFrame(_DRAWS, "draw int, w0 double, w1 double, w2 double, w3 double, w4 double")
    return L.sensitivity(line_scores(spark, d), "line", _PARTS, "score", draws)


@query(removal_sql("select draw, round(rho, 6) rho, round(kept, 6) kept from wd", ISLANDS, SCORES, _SENSITIVE))
def stat_weight_sensitivity(spark, d):
    return _sensitivity(spark, d).select("draw", F.round("rho", 6).alias("rho"), F.round("kept", 6).alias("kept"))


@query(removal_sql("select count(*) draws, round(quantile_cont(rho, 0.5), 6) rho_median, round(quantile_cont(rho, 0.05), 6) rho_p5, round(quantile_cont(kept, 0.5), 6) kept_median, round(quantile_cont(kept, 0.05), 6) kept_p5 from wd", ISLANDS, SCORES, _SENSITIVE))
def stat_sensitivity_summary(spark, d):
    s = L.sensitivity_summary(_sensitivity(spark, d))
    return s.select("draws", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


_OLD = "old as (select c_custkey k, round(avg(o_totalprice), 9) o, round(max(c_acctbal), 9) n from customer join orders on o_custkey = c_custkey group by 1)"


@query(f"with {_OLD}, r as (select rank() over (order by o) + (count(*) over (partition by o) - 1) / 2.0::double ro, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0::double rn, row_number() over (order by o desc, k) po, row_number() over (order by n desc, k) pn, greatest(1, floor(count(*) over () * 0.05::double)) m from old) select count(*) n, round(corr(ro, rn), 8) rho, round(count(*) filter (where po <= m and pn <= m) / max(m)::double, 6) overlap from r")
def stat_v6_comparison(spark, d):
    """Customers' mean order against their balance, as an old score against a new one."""
    o = V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("old"))
    c = V.read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("new")).join(o, "c_custkey", "left")
    return L.compared(c, "c_custkey", "old", "new").select("n", F.round("rho", 8).alias("rho"), F.round("overlap", 6).alias("overlap"))


_BOARD = "select user_id % 100 g, round(sum(value), 9) b from events group by 1 having sum(value) > 0"
_RHO = "select '{0}' proxy, round(corr(rx, rb), 8) rho from (select rank() over (order by round({1}, 9)) + (count(*) over (partition by round({1}, 9)) - 1) / 2.0::double rx, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double rb from j)"
_PROXY = {"people": "pop", "lines": "n::double", "people by lines": "pop * n", "root of people by lines": "sqrt(pop) * n"}


@query(closure_sql(f"select * from (with j as (select pop, n, b from f2_stop join (select g, count(*) n from lg group by 1) using (g) join ({_BOARD}) using (g)) " + " union all ".join(_RHO.format(k, v) for k, v in _PROXY.items()) + ")"))
def stat_demand_validation(spark, d):
    """Four proxies of demand at the stops against boardings."""
    b = V.read(spark, d, "events").groupBy((F.col("user_id") % 100).alias("g")).agg(F.round(F.sum("value"), 9).alias("boardings")).where("boardings > 0")
    n = V.f2_net(spark, d).served().groupBy("g").agg(F.count("*").alias("n"))
    j = written(V.f2_stop(spark, d).select("g", "pop").join(n, "g").join(b, "g"), "boardings")
    names = {"people": F.col("pop"), "lines": F.col("n").cast("double"), "people by lines": F.col("pop") * F.col("n"), "root of people by lines": F.sqrt("pop") * F.col("n")}
    return L.proxies(j, "boardings", names).select("proxy", F.round("rho", 8).alias("rho"))
