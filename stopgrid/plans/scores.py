"""Scores from 0 to 100, grades and roll-ups of what removals do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid.functions import geo
from stopgrid.functions.score import weighted_score
from stopgrid.operators import ranks as R
from stopgrid.operators import sequences as S
from stopgrid.operators.components import connected_components
from stopgrid.plans.simulation import Net, Removal
from stopgrid.plans.storage import written

#: Components of a line's, a stop's and a segment's score, in the order of their weights.
LINE_PARTS = ("time_increase", "access_loss", "no_alternative", "connectivity", "affected_share")
STOP_PARTS = ("walk_penalty", "access_loss", "line_loss", "transfer_break", "demand_share")
SEGMENT_PARTS = ("detour", "volume_share", "line_risk")


def islands(net: Net) -> DataFrame:
    """(g, component, groups, people, island): parts of the network that hang together without ferries, on foot or by rides.

    A part with fewer groups and people than the limits is an island.
    """
    rides = S.edges(net.stops.where(F.col("mode") != P.FERRY).select("pat", "pos", "g"), "pat").select("a", "b")
    parts = connected_components(rides.unionByName(net.walks.select("a", "b")))
    of = net.groups.select("g", "pop").join(parts.withColumnRenamed("node", "g"), "g", "left").withColumn("component", F.coalesce("component", "g"))
    size = of.groupBy("component").agg(F.count("*").alias("groups"), F.sum("pop").alias("people"))
    out = of.join(size, "component").withColumn("island", (F.col("groups") < P.ISLAND_GROUPS) & (F.col("people") < P.ISLAND_PEOPLE))
    return out.select("g", "component", "groups", "people", "island")


def island_affected(net: Net) -> DataFrame:
    """(line, people): for each ferry line the people of the islands it serves, shared by all ferry lines of an island."""
    ferry = net.stops.where(F.col("mode") == P.FERRY).select("line", "g").distinct()
    at = ferry.join(islands(net).where("island"), "g").select("line", "component", "people").distinct()
    n = at.groupBy("component").agg(F.count("*").alias("n"))
    return at.join(n, "component").groupBy("line").agg(F.sum(F.col("people") / F.col("n")).alias("people"))


def _scored(df: DataFrame, parts: tuple, weights: tuple) -> DataFrame:
    """``df`` with score, grade and pct. Scores are compared at nine digits, as sums in another order differ."""
    s = F.round(weighted_score([F.col(p) for p in parts], weights), 9)
    graded = R.graded(written(df.withColumn("score", s), "scores"), "score")
    return R.pct_rank(graded, "score", "pct")


def _share(df: DataFrame, value: Column, out: str) -> DataFrame:
    """``df`` with the rank of log(1 + value) from 0 to 1."""
    return R.pct_rank(written(df.withColumn("__l", F.round(F.log1p(value), 9)), "shares"), "__l", out).drop("__l")


def score_lines(net: Net, removal: Removal) -> DataFrame:
    """(line, components, affected, score, grade, pct); people affected by a ferry line are at least its share of its islands'."""
    x = removal.lines.join(island_affected(net), "line", "left").withColumn("affected", F.greatest("affected", F.coalesce("people", F.lit(0.0))))
    x = _share(x.drop("people", "pop"), F.col("affected"), "affected_share")
    return _scored(x, LINE_PARTS, P.LINE_WEIGHTS)


def stop_trips(net: Net, lines: DataFrame) -> DataFrame:
    """(g, trips): the trips (line, trips) of all lines at a group."""
    return net.served().join(lines.select("line", "trips"), "line").groupBy("g").agg(F.sum("trips").alias("trips"))


def score_stops(net: Net, closure: DataFrame, lines: DataFrame, population: bool = True) -> DataFrame:
    """(g, components, demand, score, grade, pct); demand is the root of people near times trips, or trips alone without ``population``."""
    x = closure.join(stop_trips(net, lines), "g").join(net.groups.select("g", "pop"), "g")
    demand = F.sqrt(F.greatest(F.col("pop"), F.lit(0.0))) * F.col("trips") if population else F.col("trips")
    return _scored(_share(x.withColumn("demand", demand), F.col("demand"), "demand_share"), STOP_PARTS, P.STOP_WEIGHTS)


def line_risk(net: Net, scores: DataFrame) -> DataFrame:
    """(a, b, line_risk): for each undirected edge the highest score of its lines, from 0 to 1."""
    e = S.edges(net.stops.select("line", "pat", "pos", "g"), "pat").where("a <> b").select("line", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return e.join(scores.select("line", "score"), "line").groupBy("a", "b").agg((F.max("score") / 100).alias("line_risk"))


def score_segments(net: Net, removed: DataFrame, scores: DataFrame) -> DataFrame:
    """(a, b, components, trips, score, grade, pct)."""
    x = removed.join(line_risk(net, scores), ["a", "b"])
    return _scored(_share(x, F.col("trips"), "volume_share"), SEGMENT_PARTS, P.SEGMENT_WEIGHTS)


def _rolled(stops: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, people, score, weak): half the mean by people (plain where there are none), half the upper fifth's bound; ``weak``: share of grades 2 and 3."""
    mean = F.when(F.sum("pop") > 0, F.sum(F.col("score") * F.col("pop")) / F.sum("pop")).otherwise(F.avg("score"))
    # Scores of one place are as many as its groups, of a region or a cell.
    return stops.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("pop").alias("people"), (0.5 * mean + 0.5 * F.percentile("score", F.lit(0.8))).alias("score"),
        F.avg((F.col("grade") >= 2).cast("double")).alias("weak"),
    )


def main_region(net: Net) -> DataFrame:
    """(line, region): the region of most of a line's groups; ties go to the least."""
    at = net.served().join(net.groups.select("g", "region"), "g")
    return R.top_per(at.groupBy("line", "region").agg(F.count("*").alias("c")), ["line"], [F.desc("c"), "region"], 1).select("line", "region")


def score_regions(net: Net, stops: DataFrame, lines: DataFrame) -> DataFrame:
    """(region, n, people, score, weak, senior, very_lines, grade, pct) of regions with groups.

    ``stops`` has g, score, grade; ``lines`` line and grade. ``senior`` is the
    mean of the groups where it is known (not negative), else -1.
    """
    have = net.groups if "senior" in net.groups.columns else net.groups.withColumn("senior", F.lit(-1.0))
    at = stops.select("g", "score", "grade").join(have.select("g", "region", "pop", "senior"), "g")
    senior = at.groupBy("region").agg(F.coalesce(F.avg(F.when(F.col("senior") >= 0, F.col("senior"))), F.lit(-1.0)).alias("senior"))
    very = main_region(net).join(lines.where("grade = 3").select("line"), "line", "left_semi").groupBy("region").agg(F.count("*").alias("very_lines"))
    out = _rolled(at, ["region"]).join(senior, "region").join(very, "region", "left").fillna(0, ["very_lines"])
    out = written(out.withColumn("score", F.round("score", 9)), "regions")
    return R.pct_rank(R.graded(out, "score"), "score", "pct")


def score_grid(net: Net, stops: DataFrame, land: DataFrame | None = None, unserved: DataFrame | None = None) -> DataFrame:
    """(cx, cy, score, n, people, unserved, grade) of cells with groups or on ``land`` (cx, cy).

    ``unserved`` has lon, lat, people without a stop. A cell of land without
    groups has score -1 and grade 4. Thresholds are rounded to two digits.
    """
    at = stops.select("g", "score", "grade").join(net.groups.select("g", "lon", "lat", "pop"), "g")
    cells = _rolled(at.withColumn("cx", geo.grid_x(F.col("lon"))).withColumn("cy", geo.grid_y(F.col("lat"))), ["cx", "cy"])
    out = cells.select("cx", "cy", F.round("score", 2).alias("score"), "n", F.round("people", 1).alias("people"))
    if land is not None:
        out = out.join(land.select("cx", "cy").distinct(), ["cx", "cy"], "full")
    lost = None if unserved is None else unserved.groupBy(geo.grid_x(F.col("lon")).alias("cx"), geo.grid_y(F.col("lat")).alias("cy")).agg(F.round(F.sum("people"), 1).alias("unserved"))
    out = out.withColumn("unserved", F.lit(0.0)) if lost is None else out.join(lost, ["cx", "cy"], "left")
    out = written(out.fillna(-1.0, ["score"]).fillna(0, ["n"]).fillna(0.0, ["people", "unserved"]), "grid")
    t = R.thresholds(out.where("score >= 0"), "score")
    t = F.broadcast(t.select(*[F.round(c, 2).alias(c) for c in t.columns]))  # one row
    grade = sum((F.col(c) <= F.col("score")).cast("int") for c in t.columns)
    return out.crossJoin(t).withColumn("grade", F.when(F.col("score") >= 0, grade).otherwise(4)).drop(*t.columns)


def kpis(net: Net, regions: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: regions of the highest grade, regions of many seniors among grades 2 and 3, lines whose removal isolates, people of the most vulnerable regions."""
    r = regions.agg(
        F.count_if(F.col("grade") == 3).alias("very_regions"), F.count_if((F.col("senior") >= P.SENIOR_REGION) & (F.col("grade") >= 2)).alias("senior_weak"),
        F.coalesce(F.sum(F.when(F.col("grade") == 3, F.col("people"))), F.lit(0.0)).alias("very_people"),
    )
    cut = F.col("disconnected") / F.greatest(F.col("n_pairs"), F.lit(1))
    l = lines.agg(F.count_if((cut >= P.ISOLATES) | (F.col("no_alternative") >= P.ISOLATES)).alias("isolating_lines"), F.count_if(F.col("grade") == 3).alias("very_lines"))
    return r.crossJoin(F.broadcast(l))  # one row each


def segment_grades(net: Net, lines: DataFrame, long: tuple = P.LONG_DISTANCE) -> DataFrame:
    """(a, b, line, grade): for each undirected edge the line of the highest grade that runs on it; among equals a local one, then the least id."""
    e = S.edges(net.stops.select("line", "pat", "pos", "g", "mode"), "pat").where("a <> b")
    e = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "line").agg(F.min(F.col("mode").isin(*long).cast("int")).alias("far"))
    best = F.max(F.struct("grade", (-F.col("far")).alias("near"), (-F.col("line")).alias("id")))
    return e.join(lines.select("line", "grade"), "line").groupBy("a", "b").agg(best.alias("x")).select("a", "b", (-F.col("x.id")).alias("line"), "x.grade")


def cell_best(points: DataFrame, size: float, key: str = "id", order: tuple[str, ...] = ("grade", "score")) -> DataFrame:
    """(cx, cy, key): of the points (x, y) in each square cell the one of the highest grade and score; among equals the greatest id."""
    best = F.max(F.struct(*order, key)).alias("m")
    return points.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(best).select("cx", "cy", F.col(f"m.{key}").alias(key))


def numbered(df: DataFrame, by: list[str], key: str, out: str = "rank") -> DataFrame:
    """Rank 1 to n by score, then key, within each of ``by``."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key)))
