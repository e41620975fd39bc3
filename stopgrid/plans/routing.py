"""Time-bounded shortest paths for many scenarios at once.

A label is the least time for (scn, origin, g); a time beyond the limit is
unreachable. A network small enough to be broadcast is searched within tasks
(``search``). For a larger one ``by_rounds`` relaxes by joins: a round takes the
labels improved by the last one: each boards every pattern at its group, rides
on to all later groups (one running minimum along a pattern gives all of them),
and walks. All scenarios and origins share a round, so the rounds are few
however many scenarios there are. What a round improves is written to the
shared folder, so a lost executor costs one round.

Network tables: stops of patterns (line, pat, pos, g, cum, wait, and mode where
scopes are used), walks (a, b, minutes). Scenario tables, all optional but
origins: origins (scn, origin, g, t0, lim), disabled (scn, line), closed
(scn, g), blocked (scn, a, b), scale (scn, line, scale), links (scn, f, t,
minutes), allowed (scn, g), scope (scn, scope: 0 all, 1 no long-distance lines,
2 only groups that have such a line), targets (scn, origin, g, lim): the only
groups asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopgrid.params import LONG_DISTANCE
from stopgrid.plans import search
from stopgrid.plans.search import EPS
from stopgrid.plans.storage import written


@dataclass
class Scenarios:
    origins: DataFrame
    disabled: DataFrame | None = None
    closed: DataFrame | None = None
    blocked: DataFrame | None = None
    scale: DataFrame | None = None
    links: DataFrame | None = None
    allowed: DataFrame | None = None
    scope: DataFrame | None = None
    targets: DataFrame | None = None


@dataclass
class Router:
    """A network, prepared once for any number of searches."""

    stops: DataFrame
    walks: DataFrame | None
    net: search.Network | None

    @classmethod
    def of(cls, stops: DataFrame, walks: DataFrame | None) -> Router:
        return cls(stops, walks, search.Network.of(stops, walks) if search.fits(stops, walks) else None)

    def times(self, s: Scenarios) -> DataFrame:
        """(scn, origin, g, t): all groups reached, or the targets, if there are any."""
        if self.net is not None:
            return (search.all_times if s.targets is None else search.target_times)(self.net, s)
        labels = by_rounds(self.stops, self.walks, s)
        if s.targets is None:
            return labels
        got = labels.join(s.targets.groupBy("scn", "origin", "g").agg(F.max("lim").alias("lim")), ["scn", "origin", "g"])
        return got.where(F.col("t") <= F.col("lim") + EPS).drop("lim")

    def reached(self, s: Scenarios, weights: DataFrame) -> DataFrame:
        """(scn, origin, reached): the sum of the weights (g, dest) within the limit."""
        if self.net is not None:
            return search.reached(self.net, s, weights)
        got = by_rounds(self.stops, self.walks, s).join(weights.select("g", "dest"), "g").groupBy("scn", "origin").agg(F.sum("dest").alias("reached"))
        return s.origins.select("scn", "origin").distinct().join(got, ["scn", "origin"], "left").fillna(0.0, ["reached"])


def shortest_times(stops: DataFrame, walks: DataFrame | None, s: Scenarios) -> DataFrame:
    """(scn, origin, g, t)."""
    return Router.of(stops, walks).times(s)


def _runs(stops: DataFrame, s: Scenarios) -> DataFrame | None:
    """(scn, pat, pos, run) of the patterns that a scenario blocks somewhere: which unbroken stretch a stop is on. All others are on stretch 0."""
    if s.blocked is None:
        return None
    w = Window.partitionBy("pat").orderBy("pos")
    was = F.lag("g").over(w)
    e = stops.select("pat", "pos", F.least(was, F.col("g")).alias("a"), F.greatest(was, F.col("g")).alias("b")).where(F.col("pos") > 0)
    cut = s.blocked.select("scn", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hits = e.join(cut, ["a", "b"]).select("scn", "pat", "pos", F.lit(1).alias("hit"))
    own = hits.select("scn", "pat").distinct().join(stops.select("pat", "pos"), "pat").join(hits, ["scn", "pat", "pos"], "left")
    run = F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("scn", "pat").orderBy("pos"))
    return written(own.select("scn", "pat", "pos", run.alias("run")), "runs")


def _reachable(df: DataFrame, s: Scenarios, long_groups: DataFrame | None) -> DataFrame:
    """Without places where one can't be in the scenario."""
    if s.closed is not None:
        df = df.join(s.closed.select("scn", "g").distinct(), ["scn", "g"], "left_anti")
    if s.allowed is not None:
        df = df.join(s.allowed.select("scn", "g").distinct(), ["scn", "g"], "left_semi")
    if s.scope is not None:
        of = s.scope.select("scn", F.col("scope").alias("__scope")).distinct()
        df = df.join(of, "scn", "left").join(long_groups, "g", "left").where(F.coalesce("__scope", F.lit(0)).cast("int").isin(0, 1) | F.col("__long").isNotNull()).drop("__scope", "__long")
    return df


def by_rounds(stops: DataFrame, walks: DataFrame | None, s: Scenarios, most_rounds: int = 2_000) -> DataFrame:
    """(scn, origin, g, t), by rounds of joins."""
    key = ["scn", "origin", "g"]
    runs = _runs(stops, s)
    limits = s.origins.groupBy("scn", "origin").agg(F.max("lim").alias("lim"))
    long_groups = None
    if s.scope is not None:
        is_long = F.col("mode").isin(*LONG_DISTANCE)
        long_groups = stops.where(is_long).select("g", F.lit(1).alias("__long")).distinct()
        local = s.scope.where("scope = 1").select("scn", F.lit(1).alias("__local")).distinct()
    front = written(_reachable(s.origins, s, long_groups).where("t0 <= lim").groupBy(*key).agg(F.min("t0").alias("t")), "labels")
    found = [front]
    for _ in range(most_rounds):
        board = front.join(stops, "g")
        if runs is not None:
            board = board.join(runs, ["scn", "pat", "pos"], "left")
        board = board.withColumn("run", F.coalesce("run", F.lit(0)) if runs is not None else F.lit(0))
        if s.disabled is not None:
            board = board.join(s.disabled.select("scn", "line").distinct(), ["scn", "line"], "left_anti")
        if s.scope is not None:
            board = board.join(local, "scn", "left").where(F.col("__local").isNull() | ~is_long)
        wait = F.col("wait")
        if s.scale is not None:
            board = board.join(s.scale, ["scn", "line"], "left")
            wait = wait * F.coalesce("scale", F.lit(1.0))
        off = board.groupBy("scn", "origin", "pat", "run", "pos").agg(F.min(F.col("t") + wait - F.col("cum")).alias("off"))
        ridden = off.select("scn", "origin", "pat", "run").distinct().join(stops.select("pat", "pos", "g", "cum"), "pat")
        if runs is not None:
            ridden = ridden.join(runs.withColumnRenamed("run", "own"), ["scn", "pat", "pos"], "left").where(F.coalesce("own", F.lit(0)) == F.col("run")).drop("own")
        along = ridden.join(off, ["scn", "origin", "pat", "run", "pos"], "left")
        w = Window.partitionBy("scn", "origin", "pat", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        new = along.withColumn("t", F.col("cum") + F.min("off").over(w)).where("t is not null").select(*key, "t")
        if walks is not None:
            on_foot = front.join(walks.select(F.col("a").alias("g"), "b", "minutes"), "g")
            new = new.unionByName(on_foot.select("scn", "origin", F.col("b").alias("g"), (F.col("t") + F.col("minutes")).alias("t")))
        if s.links is not None:
            by_link = front.join(s.links.select("scn", F.col("f").alias("g"), F.col("t").alias("to"), "minutes"), ["scn", "g"])
            new = new.unionByName(by_link.select("scn", "origin", F.col("to").alias("g"), (F.col("t") + F.col("minutes")).alias("t")))
        new = new.join(limits, ["scn", "origin"]).where(F.col("t") <= F.col("lim") + EPS).drop("lim")
        best = _reachable(new.groupBy(*key).agg(F.min("t").alias("n")), s, long_groups)
        # Only what is better is written; the labels are the least of all that was written.
        labels = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("t").alias("t"))
        front = written(best.join(labels, key, "left").where(F.col("t").isNull() | (F.col("n") < F.col("t") - EPS)).select(*key, F.col("n").alias("t")), "labels")
        if front.isEmpty():
            return labels
        found.append(front)
        if len(found) > 16:
            found = [written(reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("t").alias("t")), "labels")]
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def reach(times: DataFrame, dest: DataFrame, limit: float) -> DataFrame:
    """(scn, origin, reached): the sum of destinations within the limit."""
    return times.where(F.col("t") <= limit + EPS).join(dest, "g").groupBy("scn", "origin").agg(F.sum("dest").alias("reached"))


def path_legs(stops: DataFrame, walks: DataFrame | None, times: DataFrame, targets: DataFrame, most_legs: int = 2_000) -> DataFrame:
    """(scn, origin, target, step, f, t, kind, pat) backwards from each target: the leg that gives a group its time, rides before walks.

    More than ``most_legs`` legs are an error, not a cut.
    """
    key = ["scn", "origin"]
    a, b = stops.select("pat", "line", F.col("pos").alias("p1"), F.col("g").alias("f"), F.col("cum").alias("c1"), "wait"), stops.select("pat", F.col("pos").alias("p2"), "g", F.col("cum").alias("c2"))
    at = targets.select(*key, F.col("target"), F.col("target").alias("g")).join(times, [*key, "g"])
    legs, step = None, 0
    while True:
        step += 1
        if step > most_legs:
            raise RuntimeError(f"a path of more than {most_legs} legs")
        ride = at.join(b, "g").join(a, "pat").where("p1 < p2").join(times.withColumnRenamed("g", "f").withColumnRenamed("t", "tf"), [*key, "f"])
        ride = ride.where(F.abs(F.col("tf") + F.col("wait") + F.col("c2") - F.col("c1") - F.col("t")) < 1e-6).select(*key, "target", "g", "f", F.lit("ride").alias("kind"), "pat", "line", F.col("tf"))
        move = ride
        if walks is not None:
            foot = at.join(walks.select(F.col("a").alias("f"), F.col("b").alias("g"), "minutes"), "g").join(times.withColumnRenamed("g", "f").withColumnRenamed("t", "tf"), [*key, "f"])
            foot = foot.where(F.abs(F.col("tf") + F.col("minutes") - F.col("t")) < 1e-6).select(*key, "target", "g", "f", F.lit("walk").alias("kind"), F.lit(-1).cast("long").alias("pat"), F.lit(-1).cast("long").alias("line"), "tf")
            move = ride.unionByName(foot)
        w = Window.partitionBy(*key, "target").orderBy("kind", "tf", "f", "pat")
        one = written(move.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").withColumn("step", F.lit(step)), "legs")
        legs = one if legs is None else legs.unionByName(one)
        at = one.select(*key, "target", F.col("f").alias("g"), F.col("tf").alias("t"))
        if at.isEmpty():
            break
    return legs
