"""Policies that soften a removal: built for scenarios, evaluated by the same removal, chosen under a budget.

A candidate is a row (scn, line, freq, kind, km, wait): a frequency multiplier
(0: none) with a kind of link (0 none, 1 on demand, 2 an extension of a line)
of at most ``km``, on demand after ``wait`` minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid.functions import score
from stopgrid.functions.geo import haversine_m
from stopgrid.operators import ranks as K
from stopgrid.operators.spatial import within
from stopgrid.plans import routing as R
from stopgrid.plans.scores import LINE_PARTS
from stopgrid.plans.simulation import Net, Removal, line_removal
from stopgrid.plans.storage import written

NONE, DRT, EXTENSION = 0, 1, 2
CANDIDATE = "freq double, kind int, km double, wait double"


def combos() -> list[tuple]:
    """(freq, kind, km, wait): every frequency, or none, with every link, or none, without doing nothing."""
    links = [(NONE, 0.0, 0.0), *[(DRT, k, w) for k in P.DRT_KM for w in P.DRT_WAIT], *[(EXTENSION, k, 0.0) for k in P.EXTENSION_KM]]
    return [(float(f), *x) for f in (0.0, *P.FREQUENCIES) for x in links if f or x[0]]


def candidates(lines: DataFrame) -> DataFrame:
    """(scn, line, combo, freq, kind, km, wait): each line with each combination; scn tells them apart."""
    c = lines.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(combos())], f"combo int, {CANDIDATE}")
    out = lines.select("line").distinct().crossJoin(F.broadcast(c))  # a fixed number of combinations
    return out.select((F.col("line") * 1000 + F.col("combo")).cast("long").alias("scn"), "*")


def touched_lines(net: Net) -> DataFrame:
    """(line, other): lines at a line's groups or at walking neighbours, whose service a higher frequency can raise."""
    lg = net.served()
    near = lg.unionByName(net.walks.join(lg.withColumnRenamed("g", "a"), "a").select("line", F.col("b").alias("g"))).distinct()
    return near.join(lg.select(F.col("line").alias("other"), "g"), "g").where("line <> other").select("line", "other").distinct()


def targets(before: Removal) -> DataFrame:
    """(line, g, nth): the first POLICY_TARGETS groups to link: those stranded, by id; without any, where pairs start that are cut or much slower."""
    slow = before.pairs.where(F.col("after").isNull() | (F.col("after") > P.POLICY_SLOWER * F.col("before")))
    slow = slow.groupBy("line", F.col("f").alias("g")).agg(F.min("nth").cast("long").alias("nth"))
    lost = before.stranded.select("line", "g", F.col("g").cast("long").alias("nth"))
    every = lost.unionByName(slow.join(lost.select("line").distinct(), "line", "left_anti"))
    return K.top_per(every, ["line"], ["nth", "g"], P.POLICY_TARGETS, "r").drop("r")


def nearest_served(net: Net, wanted: DataFrame, max_km: float) -> DataFrame:
    """(line, g, to, via, km): for each target (line, g) the nearest group of another line, nearer than ``max_km``, and the least such line there.

    Only groups that can be reached without ferries within POLICY_REACH_MIN on
    the whole network; lines that are ferries have none.
    """
    ferry = net.stops.where(F.col("mode") == P.FERRY).select("line").distinct()
    at = wanted.join(ferry, "line", "left_anti").select("line", "g").distinct().join(net.groups.select("g", "lon", "lat"), "g")
    places = net.stops.select("g").distinct().join(net.groups.select("g", "lon", "lat"), "g")
    near = within(at.select("g", "lon", "lat").distinct(), places, max_km * 1100).where("a_g <> b_g")
    km = F.round(haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")) / 1000, 9)
    near = written(near.select(F.col("a_g").alias("g"), F.col("b_g").alias("to"), km.alias("km")).where(F.col("km") < max_km), "near")
    zero = F.lit(0).cast("long").alias("scn")
    lim = F.lit(P.POLICY_REACH_MIN).alias("lim")
    asked = near.select(zero, F.col("g").alias("origin"), F.col("to").alias("g"), lim)
    origins = near.select(zero, F.col("g").alias("origin"), "g", F.lit(0.0).alias("t0"), lim).distinct()
    got = net.router().times(R.Scenarios(origins, disabled=ferry.select(zero, "line"), targets=asked))
    open_ = near.join(got.select(F.col("origin").alias("g"), F.col("g").alias("to")), ["g", "to"], "left_semi")
    ways = at.select("line", "g").join(open_, "g").join(net.served().select(F.col("line").alias("via"), F.col("g").alias("to")), "to").where("via <> line")
    return ways.groupBy("line", "g").agg(F.min(F.struct("km", "to", "via")).alias("x")).select("line", "g", "x.to", "x.via", "x.km")


def first_wait(net: Net) -> DataFrame:
    """(line, wait): of each line's first pattern."""
    return net.stops.groupBy("line").agg(F.min(F.struct("pat", "wait")).alias("x")).select("line", F.col("x.wait").alias("wait"))


def links(net: Net, wanted: DataFrame, options: list[tuple]) -> DataFrame:
    """(line, kind, km_max, wait, g, to, via, km, minutes): the targets' links for each option (kind, km_max, wait)."""
    spark, out = net.stops.sparkSession, None
    waits = first_wait(net).select(F.col("line").alias("via"), F.col("wait").alias("own"))
    for km_max in sorted({o[1] for o in options}):
        way = written(nearest_served(net, wanted, km_max).join(waits, "via"), "ways")
        own = F.broadcast(spark.createDataFrame([(int(k), float(m), float(w)) for k, m, w in options if m == km_max], "kind int, km_max double, wait double"))
        x = way.crossJoin(own)  # a fixed number of options
        speed = F.when(F.col("kind") == DRT, P.DRT_SPEED).otherwise(P.EXTENSION_SPEED)
        minutes = F.col("km") * P.POLICY_DETOUR / speed * 60 + F.when(F.col("kind") == DRT, F.col("wait")).otherwise(F.col("own"))
        x = x.select("line", "kind", "km_max", "wait", "g", "to", "via", "km", minutes.alias("minutes"))
        out = x if out is None else out.unionByName(x)
    return out


def both_ways(l: DataFrame) -> DataFrame:
    """Links (scn, g, to, minutes) as scenario links (scn, f, t, minutes)."""
    one = l.select("scn", F.col("g").alias("f"), F.col("to").alias("t"), "minutes")
    return one.unionByName(one.select("scn", F.col("t").alias("f"), F.col("f").alias("t"), "minutes"))


def link_summary(l: DataFrame, by: str = "scn") -> DataFrame:
    """(by, links, link_km, link_max_min, via): number, kilometres and slowest of links, and the lines extended."""
    return l.groupBy(by).agg(F.count("*").alias("links"), F.round(F.sum("km"), 2).alias("link_km"), F.round(F.max("minutes"), 1).alias("link_max_min"), F.array_sort(F.collect_set("via")).alias("via"))


def evaluate(net: Net, wanted: DataFrame, before: Removal) -> DataFrame:
    """Candidates with feasible, links, link_km, link_max_min, via, touched, and the measures before (b_*) and after (a_*) the policy.

    A candidate is feasible if each of its parts is: other lines are near for a
    frequency, and a link was found for a kind. Infeasible ones keep b_* as a_*.
    """
    wanted = written(wanted.select("scn", "line", "freq", "kind", "km", "wait"), "candidates")
    touched = written(touched_lines(net).join(wanted.select("line").distinct(), "line", "left_semi"), "touched")
    near = touched.groupBy("line").agg(F.array_sort(F.collect_set("other")).alias("touched"))
    kinds = [tuple(r) for r in wanted.where("kind > 0").select("kind", "km", "wait").distinct().collect()]  # as many as there are combinations
    x = wanted.join(near, "line", "left")
    if kinds:
        found = links(net, targets(before).join(wanted.select("line").distinct(), "line", "left_semi"), kinds)
        own = wanted.select("scn", "line", "kind", F.col("km").alias("km_max"), "wait").join(found, ["line", "kind", "km_max", "wait"])
        own = written(own.select("scn", "g", "to", "via", "km", "minutes"), "links")
        x = x.join(link_summary(own), "scn", "left").fillna(0, ["links"]).fillna(0.0, ["link_km", "link_max_min"])
        ways = both_ways(own)
    else:
        x, ways = x.withColumn("links", F.lit(0)).withColumn("link_km", F.lit(0.0)).withColumn("link_max_min", F.lit(0.0)).withColumn("via", F.array().cast("array<bigint>")), None
    ok = ((F.col("freq") == 0) | (F.coalesce(F.size("touched"), F.lit(0)) > 0)) & ((F.col("kind") == NONE) | (F.col("links") > 0))
    x = written(x.withColumn("feasible", ok), "built")
    run = x.where("feasible")
    scale = run.where("freq > 0").select("scn", F.explode("touched").alias("line"), (1 / F.col("freq")).alias("scale"))
    after = line_removal(net, run.select("scn", "line"), scale, None if ways is None else ways.join(run.select("scn"), "scn", "left_semi"))
    measures = ("time_increase", "access_loss", "no_alternative", "connectivity", "stranded_pop", "disconnected")
    b = before.lines.select("line", "affected", "n_pairs", *[F.col(c).alias(f"b_{c}") for c in measures])
    a = after.lines.select("scn", *[F.col(c).alias(f"a_{c}") for c in measures])
    out = x.join(b, "line").join(a, "scn", "left")
    for c in measures:
        out = out.withColumn(f"a_{c}", F.coalesce(f"a_{c}", f"b_{c}"))
    return written(out, "evaluated")


def line_vehicles(net: Net, lines: DataFrame) -> DataFrame:
    """(line, trips, vehicles): trips (line, trips) a day times the duration of the longest pattern, over the service day."""
    n = net.stops.groupBy("line", "pat").agg(F.count("*").alias("n"), F.max("cum").alias("minutes"))
    main = K.top_per(n, ["line"], [F.desc("n"), "pat"], 1).select("line", "minutes")
    return main.join(lines.select("line", "trips"), "line").select("line", "trips", score.vehicles_needed(F.col("trips"), F.col("minutes")).alias("vehicles"))


def costs(results: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(scn, cost) of evaluated candidates, in units of 10^8 a year; 0 if infeasible."""
    x = results.select("scn", "line", "freq", "kind", "wait", "links", "link_km", "link_max_min", "via", "touched", "feasible")
    v = vehicles.select(F.col("line").alias("other"), F.col("trips").alias("other_trips"), "vehicles")
    sums = lambda col, value, out: x.select("scn", F.explode(col).alias("other")).join(v, "other").groupBy("scn").agg(F.sum(value).alias(out))
    x = x.join(sums("touched", "vehicles", "near"), "scn", "left").join(sums("via", "other_trips", "ext_trips"), "scn", "left")
    x = x.join(vehicles.select("line", "trips"), "line", "left").fillna(0.0, ["near", "ext_trips", "trips"])
    more = F.when(F.col("freq") > 0, F.col("near") * (F.col("freq") - 1)).otherwise(0.0)
    longer = F.when(F.col("kind") == EXTENSION, score.extension_vehicles(F.col("ext_trips"), F.col("link_km"), F.col("links"), F.size("via"))).otherwise(0.0)
    demand = F.when(F.col("kind") == DRT, score.drt_vehicles(F.col("trips"), F.col("link_km"), F.col("link_max_min"), F.col("wait"), F.col("links"))).otherwise(0.0)
    return x.select("scn", score.cost_eok(more + longer, demand, F.col("feasible")).alias("cost"))


def isolation(disconnected: Column, no_alternative: Column, n_pairs: Column) -> Column:
    """How far a removal isolates: the share of people without other service, or of pairs cut."""
    return F.greatest(no_alternative, disconnected / F.greatest(n_pairs, F.lit(1)))


def gains(results: DataFrame, cost: DataFrame, scores: DataFrame, carbon: DataFrame | None = None) -> DataFrame:
    """Evaluated candidates with saved (people), benefit, cost, score_before, score_after and co2_low, co2_mid, co2_high (tonnes a year).

    ``scores`` has line, affected and affected_share; ``carbon`` line, trip_km,
    transit, cars, kg, kg_all: without it no emission is told.
    """
    x = results.drop("affected").join(scores.select("line", "affected", "affected_share"), "line").join(cost, "scn")
    ok = F.col("feasible")
    saved = F.when(ok, F.col("b_stranded_pop") - F.col("a_stranded_pop")).otherwise(0.0)
    quicker = F.when(ok, F.col("b_time_increase") - F.col("a_time_increase")).otherwise(0.0)
    x = x.withColumn("saved", saved).withColumn("benefit", score.benefit(saved, quicker, F.col("affected"), ok))
    for k, out in (("b", "score_before"), ("a", "score_after")):
        x = x.withColumn(out, score.weighted_score([*[F.col(f"{k}_{p}") for p in LINE_PARTS[:4]], F.col("affected_share")], P.LINE_WEIGHTS))
    if carbon is None:
        return x
    x = x.join(carbon, "line", "left")
    tonnes = {k: score.carbon(F.col("affected"), isolation(F.col(f"{k}_disconnected"), F.col(f"{k}_no_alternative"), F.col("n_pairs")), F.col(f"{k}_time_increase"), F.col("trip_km"), F.col("transit"), F.col("cars"), F.col("kg"), F.col("kg_all")) for k in "ba"}
    for i, out in enumerate(("co2_low", "co2_mid", "co2_high")):
        x = x.withColumn(out, F.when(ok, F.coalesce(tonnes["b"][i] - tonnes["a"][i], F.lit(0.0))).otherwise(0.0))
    return x


def portfolio(chosen: DataFrame) -> DataFrame:
    """(budget, lines, benefit, spent, ...) of chosen items; people saved, emissions and kinds where the items tell them."""
    own = [F.count("*").alias("lines"), F.sum("benefit").alias("benefit"), F.max("spent").alias("spent")]
    own += [F.sum(c).alias(c) for c in ("saved", "co2_low", "co2_mid", "co2_high") if c in chosen.columns]
    if "kind" in chosen.columns:
        own += [F.count_if(F.col("kind") == k).alias(n) for k, n in ((DRT, "drt"), (EXTENSION, "extension"), (NONE, "frequency"))]
        own.append(F.count_if((F.col("kind") > 0) & (F.col("freq") > 0)).alias("combined"))
    return chosen.groupBy("budget").agg(*own)


def item_index(chosen: DataFrame) -> DataFrame:
    """(budget, item, place): the items of all budgets numbered from 0 by benefit over cost, as each budget lists them."""
    ratio = F.round(F.col("benefit") / F.greatest(F.col("cost"), F.lit(1e-9)), 9)
    one = chosen.select("item", ratio.alias("ratio")).distinct()
    return chosen.select("budget", "item").join(K.numbered_all(one, ["ratio"], ["item"]), "item").select("budget", "item", "place")


def capture(known: DataFrame, found: DataFrame, random: DataFrame, budgets: tuple, share: float = 1.0) -> DataFrame:
    """(budget, optimal, found, random, share, random_share): benefit within each budget times ``share`` of all ``known`` items, of those ``found``, and of ``random`` ones.

    ``known`` has line, item, benefit, cost; the others name items.
    """
    scaled = tuple(float(b) * share for b in budgets)

    def best(items, out):
        got = K.greedy_budget(items, scaled).groupBy("budget").agg(F.sum("benefit").alias(out))
        return got

    spark = known.sparkSession
    out = F.broadcast(spark.createDataFrame([(float(b), float(b) * share) for b in budgets], "of double, budget double"))
    # A choice reads its items more than once.
    some = lambda of, name: written(known.join(of.select("item"), "item", "left_semi").select("line", "item", "benefit", "cost"), name)
    for items, name in ((known, "optimal"), (some(found, "found_items"), "found"), (some(random, "random_items"), "random")):
        out = out.join(best(items, name), "budget", "left").fillna(0.0, [name])
    part = lambda c: F.col(c) / F.greatest(F.col("optimal"), F.lit(1e-9))
    return out.select(F.col("of").alias("budget"), "optimal", "found", "random", part("found").alias("share"), part("random").alias("random_share"))


def sample_trip_km(net: Net) -> DataFrame:
    """(line, km): the mean distance along a line's longest pattern between sampled groups of its first round: neighbours, first to middle, middle to last.

    Places are the fractions' halves to even; where the sample has no pairs, the length of the round.
    """
    from stopgrid.operators import sequences as S

    n = net.stops.groupBy("line", "pat").agg(F.count("*").alias("n"))
    main = K.top_per(n, ["line"], [F.desc("n"), "pat"], 1).select("line", "pat", "n")
    own = net.stops.join(main.select("pat"), "pat", "left_semi").join(net.groups.select("g", "lon", "lat"), "g")
    w = Window.partitionBy("pat").orderBy("pos")
    step = F.coalesce(haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")) / 1000, F.lit(0.0))
    at = own.withColumn("step", step).withColumn("at", F.sum("step").over(w)).select("pat", "pos", "at")
    ends = S.first_loop_end(own, "pat")
    end = F.coalesce(F.col("end"), F.col("n") - 1)
    s = F.array_distinct(F.array(*[F.rint(end * f).cast("long") for f in P.OD_FRACTIONS]))
    some = main.join(ends, "pat", "left").withColumn("last", end.cast("long")).withColumn("s", s)
    mid = F.floor(F.size("s") / 2).cast("int")
    near = F.transform(F.sequence(F.lit(0), F.greatest(F.size("s") - 2, F.lit(0))), lambda i: F.struct(F.get("s", i).alias("i"), F.get("s", i + 1).alias("j")))
    far = F.array(F.struct(F.get("s", F.lit(0)).alias("i"), F.get("s", mid).alias("j")), F.struct(F.get("s", mid).alias("i"), F.get("s", F.size("s") - 1).alias("j")))
    pos = some.select("line", "pat", F.explode(F.concat(near, far)).alias("x")).select("line", "pat", "x.i", "x.j").where("j > i")
    d = pos.join(at.select("pat", F.col("pos").alias("i"), F.col("at").alias("x1")), ["pat", "i"]).join(at.select("pat", F.col("pos").alias("j"), F.col("at").alias("x2")), ["pat", "j"])
    mean = d.groupBy("line").agg(F.avg(F.col("x2") - F.col("x1")).alias("mean"))
    whole = some.join(at.select("pat", F.col("pos").alias("last"), "at"), ["pat", "last"]).select("line", "at")
    return whole.join(mean, "line", "left").select("line", F.coalesce("mean", "at").alias("km"))
