"""What if a line, a stop or a segment is gone: scenarios for ``routing`` and the measures of their results.

A network is a ``Net`` of tables: stops of patterns (line, pat, pos, g, cum,
wait, trips, mode), walks (a, b, minutes) both ways, groups (g, lon, lat, pop,
dest). A line's scope is what may stand in for it: a local line no long-distance
one; a long-distance line only what goes between groups that such lines serve.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid.functions.geo import walk_minutes
from stopgrid.operators import sequences as S
from stopgrid.operators.spatial import within
from stopgrid.plans import routing as R
from stopgrid.plans import search
from stopgrid.plans.storage import written


@dataclass
class Net:
    stops: DataFrame
    walks: DataFrame
    groups: DataFrame
    _router: R.Router | None = None

    def router(self) -> R.Router:
        """The network prepared for searches, once."""
        if self._router is None:
            self._router = R.Router.of(self.stops, self.walks)
        return self._router

    def served(self) -> DataFrame:
        """(line, g): each group of each line."""
        return self.stops.select("line", "g").distinct()


@dataclass
class Removal:
    """``lines``: (scn, line, measures); ``pairs``: (scn, line, f, t, ride, nth, before, after); ``stranded``: (scn, line, g)."""

    lines: DataFrame
    pairs: DataFrame
    stranded: DataFrame


def scopes(stops: DataFrame) -> DataFrame:
    """(line, scope): of local lines and of those for long distances."""
    is_long = F.max(F.col("mode").isin(*P.LONG_DISTANCE).cast("int"))
    return stops.groupBy("line").agg(F.when(is_long == 1, search.LONG).otherwise(search.LOCAL).alias("scope"))


def _sampled(s: Column, far: list[tuple]) -> Column:
    """Pairs of positions from a sample: neighbours, then those that ``far`` names."""
    at = lambda i: F.get(s, i).cast("long")
    near = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0))), lambda i: F.struct(at(i).alias("i"), at(i + 1).alias("j")))
    return F.concat(near, F.array(*[F.struct(at(a).alias("i"), at(b).alias("j")) for a, b in far]))


def _placed(pos: DataFrame, stops: DataFrame) -> DataFrame:
    """(line, f, t, ride, nth) of pairs of positions (line, pat, nth, i, j)."""
    a = stops.select("pat", F.col("pos").alias("i"), F.col("g").alias("f"), F.col("cum").alias("c1"), "wait")
    b = stops.select("pat", F.col("pos").alias("j"), F.col("g").alias("t"), F.col("cum").alias("c2"))
    got = pos.where("i < j").join(a, ["pat", "i"]).join(b, ["pat", "j"]).where("f <> t")
    first = F.min(F.struct("nth", (F.col("c2") - F.col("c1") + F.col("wait")).alias("ride")))
    return got.groupBy("line", "f", "t").agg(first.alias("x")).select("line", "f", "t", "x.ride", "x.nth")


def od_pairs(stops: DataFrame) -> DataFrame:
    """(line, f, t, ride, nth): pairs of sampled groups of a line's two longest patterns, each once, in the order ``nth``.

    They are neighbours in the sample, first to middle, and middle to last. A
    line that gets none so, as its samples are one group, gets the pairs of the
    first round of its longest pattern.
    """
    n = stops.groupBy("line", "pat").agg((F.max("pos") + 1).alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("n"), "pat"))).where("r <= 2")
    s, last = F.col("s"), F.size("s") - 1
    mid = F.floor(F.size("s") / 2).cast("int")
    some = top.withColumn("s", S.od_positions(F.col("n"), P.OD_FRACTIONS))
    pos = some.select("line", "pat", "r", F.posexplode(_sampled(s, [(F.lit(0), mid), (mid, last)])).alias("k", "x"))
    plain = _placed(pos.select("line", "pat", (F.col("r") * 1000 + F.col("k")).alias("nth"), "x.i", "x.j"), stops)
    alone = top.where("r = 1").join(plain.select("line").distinct(), "line", "left_anti")
    ends = S.first_loop_end(stops.join(alone.select("pat"), "pat", "left_semi"), "pat")
    rounds = alone.join(ends, "pat").withColumn("s", S.od_positions(F.coalesce("end", "n"), P.OD_FRACTIONS))
    whole = F.when(F.size("s") > 2, last).otherwise(0)
    pos = rounds.select("line", "pat", F.posexplode(_sampled(s, [(F.lit(0), whole)])).alias("k", "x"))
    return plain.unionByName(_placed(pos.select("line", "pat", F.col("k").cast("long").alias("nth"), "x.i", "x.j"), stops))


def stranded_groups(net: Net) -> DataFrame:
    """(line, g): groups where no other line stops, nor within a walk."""
    lg = net.served()
    near = lg.unionByName(net.walks.join(lg.withColumnRenamed("g", "b"), "b").select("line", F.col("a").alias("g"))).distinct()
    alone = near.groupBy("g").agg(F.count("*").alias("n")).where("n = 1").select("g")
    return lg.join(alone, "g", "left_semi").select("line", "g")


def affected_people(net: Net) -> DataFrame:
    """(line, affected, pop): people at a line's groups, by the line's share of the trips there, and all of them."""
    own = net.stops.groupBy("line", "g").agg(F.sum("trips").alias("own"))
    total = own.groupBy("g").agg(F.sum("own").alias("all"))
    at = own.join(total, "g").join(net.groups.select("g", "pop"), "g")
    return at.groupBy("line").agg(F.sum(F.col("pop") * F.col("own") / F.greatest(F.col("all"), F.lit(1e-6))).alias("affected"), F.sum("pop").alias("pop"))


def edge_trips(stops: DataFrame) -> DataFrame:
    """(line, a, b, own, all): a line's undirected edges with its trips and all lines'."""
    e = S.edges(stops.select("line", "pat", "pos", "g", "trips"), "pat").groupBy("line", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("trips").alias("own"))
    return e.join(e.groupBy("a", "b").agg(F.sum("own").alias("all")), ["a", "b"])


def dependency(stops: DataFrame) -> DataFrame:
    """(line, dependency): the share of a line's edges of whose trips it runs nine tenths or more."""
    return edge_trips(stops).groupBy("line").agg(F.avg((F.col("own") / F.greatest(F.col("all"), F.lit(1e-6)) >= 0.9).cast("double")).alias("dependency"))


def line_removal(net: Net, cuts: DataFrame | None = None, scale: DataFrame | None = None, links: DataFrame | None = None) -> Removal:
    """Every scenario of ``cuts`` (scn, line), by default each line's own, with that line gone; ``scale`` and ``links`` are policies.

    Measures are time_increase, access_loss, no_alternative, connectivity;
    disconnected of n_pairs pairs; dependency; affected people; pop of which
    stranded_pop; access_before and access_after, null where no access was
    searched for, as the removal has next to no effect. Scenario ids are not
    negative. Times before the removal are searched once for each scope and group.
    """
    stops, router = net.stops, net.router()
    of = scopes(stops)
    cuts = (of.select(F.col("line").alias("scn"), "line") if cuts is None else cuts.select("scn", "line")).select(F.col("scn").cast("long").alias("scn"), "line")
    cuts = cuts.join(of, "line")
    lim = P.OD_LIMIT_FACTOR * F.col("ride") + P.OD_LIMIT_MORE
    asked = written(cuts.join(od_pairs(stops), "line").withColumn("lim", lim), "od")
    base = (-1 - F.col("scope")).cast("long")
    every = asked.select("scn", "scope", "f", "t", "lim").unionByName(asked.select(base.alias("scn"), "scope", "f", "t", "lim"))
    origins = every.groupBy("scn", F.col("f").alias("origin")).agg(F.max("lim").alias("lim")).select("scn", "origin", F.col("origin").alias("g"), F.lit(0.0).alias("t0"), "lim")
    targets = every.groupBy("scn", F.col("f").alias("origin"), F.col("t").alias("g")).agg(F.max("lim").alias("lim"))
    options = {"disabled": cuts.select("scn", "line"), "scale": scale, "links": links, "scope": every.select("scn", "scope").distinct()}
    times = written(router.times(R.Scenarios(origins, targets=targets, **options)), "od_times").select("scn", F.col("origin").alias("f"), F.col("g").alias("t"), F.col("t").alias("m"))
    after = times.where("scn >= 0").select("scn", "f", "t", F.col("m").alias("after"))
    before = times.where("scn < 0").select((-1 - F.col("scn")).cast("int").alias("scope"), "f", "t", F.col("m").alias("before"))
    p = asked.join(before, ["scope", "f", "t"], "left").join(after, ["scn", "f", "t"], "left")
    p = p.withColumn("before", F.least(F.coalesce("before", "ride"), "ride")).withColumn("after", F.when(F.col("after") <= F.col("lim") + R.EPS, F.col("after")))
    pairs = written(p.select("scn", "line", "scope", "f", "t", "ride", "nth", "before", "after"), "removed_pairs")
    inc = F.when(F.col("after").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("after") - F.col("before")) / F.greatest(F.lit(1.0), F.col("before")))))
    by_pair = pairs.groupBy("scn").agg(F.avg(inc).alias("time_increase"), F.count_if(F.col("after").isNull()).alias("disconnected"), F.count("*").alias("n_pairs"))
    lost = cuts.select("scn", "line").join(stranded_groups(net), "line")
    if links is not None:
        lost = lost.join(links.select("scn", F.col("f").alias("g")).distinct(), ["scn", "g"], "left_anti")
    lost = written(lost.select("scn", "line", "g"), "stranded")
    lost_pop = lost.join(net.groups.select("g", F.col("pop").alias("p")), "g").groupBy("scn").agg(F.sum("p").alias("stranded_pop"), F.count("*").alias("n_stranded"))
    out = cuts.join(by_pair, "scn", "left").join(affected_people(net), "line", "left").join(dependency(stops), "line", "left").join(lost_pop, "scn", "left")
    out = out.fillna(0.0, ["time_increase", "affected", "pop", "dependency", "stranded_pop"]).fillna(0, ["disconnected", "n_pairs", "n_stranded"])
    out = out.withColumn("no_alternative", F.when(F.col("pop") > 0, F.col("stranded_pop") / F.col("pop")).otherwise(0.0))
    out = written(out.withColumn("connectivity", 0.5 * F.col("disconnected") / F.greatest(F.col("n_pairs"), F.lit(1)) + 0.5 * F.col("dependency")), "removed_lines")
    felt = out.where((F.col("time_increase") >= P.ACCESS_LEAST_INCREASE) | (F.col("no_alternative") > 0) | (F.col("disconnected") > 0)).select("scn")
    access = line_access(net, pairs.join(felt, "scn", "left_semi"), options)
    lines = out.join(access, "scn", "left").fillna(0.0, ["access_loss"]).drop("scope")
    return Removal(written(lines, "removal"), pairs, lost)


def line_access(net: Net, pairs: DataFrame, options: dict) -> DataFrame:
    """(scn, access_loss, access_before, access_after): destinations lost within ACCESS_MIN, on average of the first origins of the scenario's pairs."""
    first = pairs.groupBy("scn", "scope", "f").agg(F.min("nth").alias("nth"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("scn").orderBy("nth"))).where(F.col("r") <= P.ACCESS_ORIGINS)
    first = written(first.select("scn", "scope", "f"), "access_origins")
    row = lambda scn: first.select(scn.cast("long").alias("scn"), F.col("f").alias("origin"), F.col("f").alias("g"), F.lit(0.0).alias("t0"), F.lit(P.ACCESS_MIN).alias("lim"))
    origins = row(F.col("scn")).unionByName(row(-1 - F.col("scope")).distinct())
    got = written(net.router().reached(R.Scenarios(origins, **options), net.groups.select("g", "dest")), "access")
    after = got.where("scn >= 0").select("scn", F.col("origin").alias("f"), F.col("reached").alias("a"))
    before = got.where("scn < 0").select((-1 - F.col("scn")).cast("int").alias("scope"), F.col("origin").alias("f"), F.col("reached").alias("b"))
    x = first.join(before, ["scope", "f"], "left").join(after, ["scn", "f"], "left").fillna(0.0, ["a", "b"])
    loss = F.when(F.col("b") > 0, F.greatest(F.lit(0.0), 1 - F.col("a") / F.col("b"))).otherwise(0.0)
    return x.groupBy("scn").agg(F.avg(loss).alias("access_loss"), F.sum("b").alias("access_before"), F.sum("a").alias("access_after"))


# ---------------------------------------------------------------- stops


def alternatives(net: Net) -> DataFrame:
    """(g, alt, minutes): served groups within a walk of a group; only where there is no group at all within a walk, those within STRANDED_M."""
    xy = net.groups.select("g", "lon", "lat")
    far = within(xy, xy, P.STRANDED_M).where("a_g <> b_g").select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), walk_minutes(F.col("dist")).alias("minutes"))
    alone = far.join(net.walks.select("a").distinct(), "a", "left_anti")
    served = net.stops.select(F.col("g").alias("b")).distinct()
    return net.walks.select("a", "b", "minutes").unionByName(alone).join(served, "b", "left_semi").select(F.col("a").alias("g"), F.col("b").alias("alt"), "minutes")


def transfer_pairs(net: Net) -> DataFrame:
    """(g, l1, l2): pairs of the first HUB_LINES lines, by id, of each group."""
    some = net.served().withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("line"))).where(F.col("r") <= P.HUB_LINES).drop("r")
    a, b = some.withColumnRenamed("line", "l1"), some.withColumnRenamed("line", "l2")
    return a.join(b, "g").where("l1 < l2").select("g", "l1", "l2")


def broken_transfers(net: Net) -> DataFrame:
    """(g, pairs, broken): pairs of lines at a group, and those that meet nowhere else, at another group or within a walk between two others.

    Counted for each pair of lines as a whole, and for each place that a meeting
    touches: a pair meets elsewhere if not all its meetings touch the group.
    """
    pairs = written(transfer_pairs(net), "transfer_pairs")
    lg = net.served()
    of = pairs.select("l1", "l2").distinct().join(lg.select(F.col("line").alias("l1"), F.col("g").alias("h")), "l1")
    other = lg.select(F.col("line").alias("l2"), F.col("g").alias("w"))
    here = of.withColumn("w", F.col("h")).join(other, ["l2", "w"], "left_semi").select("l1", "l2", F.array("h").alias("places"))
    foot = of.join(net.walks.select(F.col("a").alias("h"), F.col("b").alias("w")), "h").join(other, ["l2", "w"], "left_semi").select("l1", "l2", F.array("h", "w").alias("places"))
    meets = written(here.unionByName(foot), "meetings")
    every = meets.groupBy("l1", "l2").agg(F.count("*").alias("n"))
    touch = meets.select("l1", "l2", F.explode("places").alias("g")).groupBy("l1", "l2", "g").agg(F.count("*").alias("k"))
    x = pairs.join(every, ["l1", "l2"]).join(touch, ["l1", "l2", "g"], "left")
    return x.groupBy("g").agg(F.count("*").alias("pairs"), F.count_if(F.col("n") == F.coalesce("k", F.lit(0))).alias("broken"))


def stop_closure(net: Net, temporary_m: float | None = None, only: DataFrame | None = None, access: bool = True) -> DataFrame:
    """(g, walk_penalty, access_loss, line_loss, transfer_break, alternative, extra, access_before, access_after) for each group with service.

    ``only`` (g) limits which groups are closed. With a temporary stop
    ``temporary_m`` away no line and no transfer is lost, and riders start there
    after that walk. ``access`` False leaves access_loss null.
    """
    lg = net.served()
    at = lg if only is None else lg.join(only.select("g").distinct(), "g", "left_semi")
    choice = written(alternatives(net), "alternatives")
    # Times are compared at nine digits, as sums in another order differ; ties go to the least id.
    best = choice.groupBy("g").agg(F.min(F.struct(F.round("minutes", 9).alias("m"), "alt")).alias("x")).select("g", F.col("x.m").alias("way"), F.col("x.alt").alias("alternative"))
    reached = choice.join(lg.select(F.col("g").alias("alt"), "line"), "alt").select("g", "line").distinct()
    lines = at.groupBy("g").agg(F.count("*").alias("n")).join(at.join(reached, ["g", "line"], "left_anti").groupBy("g").agg(F.count("*").alias("lost")), "g", "left")
    out = lines.join(best, "g", "left")
    none = 1.5 * walk_minutes(F.lit(P.STRANDED_M))
    if temporary_m is None:
        out = out.join(broken_transfers(net), "g", "left").withColumn("extra", F.coalesce("way", none))
        out = out.withColumn("line_loss", F.coalesce("lost", F.lit(0)) / F.col("n")).withColumn("transfer_break", F.coalesce(F.col("broken") / F.col("pairs"), F.lit(0.0)))
    else:
        out = out.withColumn("extra", walk_minutes(F.lit(float(temporary_m)))).withColumn("line_loss", F.lit(0.0)).withColumn("transfer_break", F.lit(0.0))
    out = written(out.withColumn("walk_penalty", F.least(F.lit(1.0), F.col("extra") / P.WALK_FULL_MIN)), "closures")
    made = ["g", "walk_penalty", "access_loss", "line_loss", "transfer_break", F.coalesce("alternative", F.lit(-1)).alias("alternative"), "extra", "access_before", "access_after"]
    if not access:
        nil = F.lit(None).cast("double")
        return out.withColumn("access_loss", nil).withColumn("access_before", nil).withColumn("access_after", nil).select(*made)
    scn = F.col("g").cast("long").alias("scn")
    lim = F.lit(P.ACCESS_MIN).alias("lim")
    base = out.select(F.lit(-1).cast("long").alias("scn"), F.col("g").alias("origin"), "g", F.lit(0.0).alias("t0"), lim)
    if temporary_m is None:
        moved = out.where("alternative is not null").select(scn, F.col("g").alias("origin"), F.col("alternative").alias("g"), F.col("extra").alias("t0"), lim)
        closed = out.select(scn, "g")
    else:
        moved, closed = out.select(scn, F.col("g").alias("origin"), "g", F.col("extra").alias("t0"), lim), None
    got = written(net.router().reached(R.Scenarios(base.unionByName(moved), closed=closed), net.groups.select("g", "dest")), "closure_access")
    before = got.where("scn = -1").select(F.col("origin").alias("g"), F.col("reached").alias("access_before"))
    after = got.where("scn <> -1").select(F.col("origin").alias("g"), F.col("reached").alias("access_after"))
    out = out.join(before, "g", "left").join(after, "g", "left").fillna(0.0, ["access_before", "access_after"])
    loss = F.when(F.col("access_before") > 0, F.greatest(F.lit(0.0), 1 - F.col("access_after") / F.col("access_before"))).otherwise(F.when(F.col("alternative").isNull(), 1.0).otherwise(0.0))
    return out.withColumn("access_loss", loss).select(*made)


# ---------------------------------------------------------------- segments


def segments(stops: DataFrame) -> DataFrame:
    """(scn, a, b, trips): the undirected edges, numbered by a hash; a < b."""
    e = S.edges(stops.select("line", "pat", "pos", "g", "trips"), "pat").where("a <> b")
    e = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("trips").alias("trips"))
    return e.select(F.xxhash64("a", "b").alias("scn"), "a", "b", "trips")


def segment_removal(net: Net, some: DataFrame | None = None) -> DataFrame:
    """(scn, a, b, trips, direct, after, detour): each segment blocked both ways.

    ``direct`` is the quickest ride along it, or a minute after boarding where
    only a ride the other way is known; the detour is the added minutes over
    DETOUR_FULL_MIN, at most 1, and 1 where there is no way.
    """
    segs = written(segments(net.stops) if some is None else some, "segments")
    hop = S.edges(net.stops, "pat").select("pat", "pos", "a", "b", "cum", "wait")
    hop = hop.join(net.stops.select("pat", (F.col("pos") - 1).alias("pos"), F.col("cum").alias("c2")), ["pat", "pos"])
    along = hop.select("a", "b", (F.col("c2") - F.col("cum") + F.col("wait")).alias("m"))
    back = hop.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("wait") + 1).alias("m"))
    direct = along.unionByName(back).groupBy("a", "b").agg(F.min("m").alias("direct"))
    asked = segs.join(direct, ["a", "b"], "left").fillna(P.DIRECT_MIN, ["direct"])
    lim = (F.col("direct") + P.SEGMENT_MORE_MIN).alias("lim")
    origins = asked.select("scn", F.col("a").alias("origin"), F.col("a").alias("g"), F.lit(0.0).alias("t0"), lim)
    targets = asked.select("scn", F.col("a").alias("origin"), F.col("b").alias("g"), lim)
    t = net.router().times(R.Scenarios(origins, blocked=asked.select("scn", "a", "b"), targets=targets))
    j = asked.join(t.select("scn", F.col("t").alias("after")), "scn", "left")
    detour = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("after") - F.col("direct")) / P.DETOUR_FULL_MIN)
    return j.withColumn("detour", F.when(F.col("after").isNull(), 1.0).otherwise(detour))


# ---------------------------------------------------------------- journeys


def journey(net: Net, trips: DataFrame, limit: float = P.JOURNEY_MIN, disabled: DataFrame | None = None) -> DataFrame:
    """(scn, f, t, m): times of (scn, f, t), with a column ``lim`` where trips have limits of their own; null if there is no way."""
    lim = F.col("lim") if "lim" in trips.columns else F.lit(float(limit)).alias("lim")
    asked = trips.select("scn", F.col("f").alias("origin"), F.col("t").alias("g"), lim)
    origins = asked.groupBy("scn", "origin").agg(F.max("lim").alias("lim")).select("scn", "origin", F.col("origin").alias("g"), F.lit(0.0).alias("t0"), "lim")
    got = net.router().times(R.Scenarios(origins, disabled=disabled, targets=asked))
    return trips.join(got.select("scn", F.col("origin").alias("f"), F.col("g").alias("t"), F.col("t").alias("m")).distinct(), ["scn", "f", "t"], "left")


def journey_legs(net: Net, trips: DataFrame, limit: float = P.JOURNEY_MIN) -> DataFrame:
    """(scn, origin, target, step, f, g, kind, pat, line, tf): the legs of the trips (scn, f, t), backwards."""
    origins = trips.select("scn", F.col("f").alias("origin"), F.col("f").alias("g"), F.lit(0.0).alias("t0"), F.lit(float(limit)).alias("lim")).distinct()
    times = written(net.router().times(R.Scenarios(origins)), "journeys")
    return R.path_legs(net.stops, net.walks, times, trips.select("scn", F.col("f").alias("origin"), F.col("t").alias("target")))


def journey_resilience(net: Net, trips: DataFrame) -> DataFrame:
    """(f, t, line, before, after, increase) for each line of the best journey of each trip (f, t), with that line gone.

    Times beyond max(RESILIENCE_MIN, four times the best) are no way: after and
    increase are infinite there. A trip by foot alone has no rows.
    """
    numbered = written(trips.select("f", "t").distinct().withColumn("scn", F.lit(0).cast("long")), "trips")
    best = journey(net, numbered).select("f", "t", F.col("m").alias("before")).where("before is not null")
    used = journey_legs(net, numbered).where("kind = 'ride'").select(F.col("origin").alias("f"), F.col("target").alias("t"), "line").distinct()
    asked = written(used.join(best, ["f", "t"]).withColumn("scn", F.col("line").cast("long")).withColumn("lim", F.greatest(F.lit(P.RESILIENCE_MIN), 4 * F.col("before"))), "used")
    after = journey(net, asked.select("scn", "f", "t", "lim"), disabled=asked.select("scn", "line").distinct())
    out = asked.join(after.select("scn", "f", "t", F.col("m").alias("after")), ["scn", "f", "t"])
    out = out.withColumn("after", F.when(F.col("after") <= F.col("lim") + R.EPS, F.col("after")).otherwise(float("inf")))
    return out.select("f", "t", "line", "before", "after", ((F.col("after") - F.col("before")) / F.greatest(F.lit(1.0), F.col("before"))).alias("increase"))
