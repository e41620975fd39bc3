"""Road matching: snapping stops to links, distances on the road graph, simpler lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopgrid.plans import routing as R
from stopgrid.plans.storage import written

SNAP_M, LIMIT_M, DETOUR, DETOUR_M, SIMPLIFY_M = 300.0, 25_000.0, 3.0, 2_000.0, 5.0


def snap(points: DataFrame, segments: DataFrame, metres: float = SNAP_M, digits: int = 3) -> DataFrame:
    """(id, link, at, dist): the nearest link of each point (id, x, y) and the share along it; segments are (link, x1, y1, x2, y2), all in metres.

    A segment is put into every cell its box, widened by ``metres``, touches; points meet it by their cell.
    """
    size = 2 * metres
    lo = lambda a, b: F.floor((F.least(a, b) - metres) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + metres) / size)
    s = segments.withColumn("cx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("cy", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))
    p = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / n))).otherwise(0.0)
    j = p.join(s, ["cx", "cy"]).withColumn("at", t)
    d = F.sqrt(F.pow(F.col("x") - F.col("x1") - F.col("at") * dx, 2) + F.pow(F.col("y") - F.col("y1") - F.col("at") * dy, 2))
    best = j.withColumn("dist", F.round(d, digits)).where(F.col("dist") <= metres).groupBy("id").agg(F.min(F.struct("dist", "link", F.round("at", 6).alias("at"))).alias("m"))
    return best.select("id", F.col("m.link").alias("link"), F.col("m.at").alias("at"), F.col("m.dist").alias("dist"))


def split_links(links: DataFrame, snapped: DataFrame) -> DataFrame:
    """Undirected pieces (a, b, m) of links (link, a, b, m) cut at the stops snapped to them (id, link, at, dist).

    A stop is the node -1 - id; two stops on one link are joined along it.
    """
    stops = snapped.select("link", (-1 - F.col("id")).alias("node"), "at")
    ends = links.select("link", F.col("a").alias("node"), F.lit(0.0).alias("at")).unionByName(links.select("link", F.col("b").alias("node"), F.lit(1.0).alias("at")))
    w = Window.partitionBy("link").orderBy("at", "rank", "node")
    every = ends.withColumn("rank", F.when(F.col("at") == 0, 0).otherwise(2)).unionByName(stops.withColumn("rank", F.lit(1)))
    cut = every.withColumn("b", F.lead("node").over(w)).withColumn("to", F.lead("at").over(w)).where("b is not null")
    return cut.join(links.select("link", "m"), "link").select(F.col("node").alias("a"), "b", ((F.col("to") - F.col("at")) * F.col("m")).alias("m"))


def road_distances(links: DataFrame, pairs: DataFrame, limit: float = LIMIT_M) -> DataFrame:
    """(f, t, straight, m, status) for pairs (f, t, straight): 1 by road, 2 no path within the limit, 3 too long a detour. Links (a, b, m) go both ways.

    Origins are searched within tasks where the road graph can be broadcast (``search``), else by rounds.
    """
    both = links.select("a", "b", F.col("m").alias("minutes")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("minutes")))
    none = links.sparkSession.createDataFrame([], "line bigint, pat bigint, pos bigint, g bigint, cum double, wait double")
    lim = F.lit(float(limit)).alias("lim")
    zero = F.lit(0).cast("long").alias("scn")
    o = pairs.select(zero, F.col("f").alias("origin"), F.col("f").alias("g"), F.lit(0.0).alias("t0"), lim).distinct()
    asked = pairs.select(zero, F.col("f").alias("origin"), F.col("t").alias("g"), lim).distinct()
    got = R.Router.of(none, both).times(R.Scenarios(o, targets=asked))
    j = pairs.join(got.select(F.col("origin").alias("f"), F.col("g").alias("t"), F.col("t").alias("m")), ["f", "t"], "left")
    long = F.col("m") > F.greatest(DETOUR * F.col("straight"), F.col("straight") + DETOUR_M)
    return j.withColumn("status", F.when(F.col("m").isNull(), 2).when(long, 3).otherwise(1))


def road_paths(links: DataFrame, pairs: DataFrame, places: DataFrame, limit: float = LIMIT_M) -> DataFrame:
    """(f, t, straight, m, status, xs, ys): road distances of pairs with the way drawn; straight, and status 0, where an end isn't on a road.

    ``places`` has node, x, y; ends that are no node of a link have status 0, and
    those without a usable way are drawn straight as well.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = pairs.join(nodes.withColumnRenamed("node", "f"), "f", "left_semi").join(nodes.withColumnRenamed("node", "t"), "t", "left_semi").select("f", "t", "straight")
    by_road = written(road_distances(links, known, limit), "road_distances")
    walks = links.select("a", "b", F.col("m").alias("minutes")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("minutes")))
    none = links.sparkSession.createDataFrame([], "line bigint, pat bigint, pos bigint, g bigint, cum double, wait double")
    ok = by_road.where("status = 1").select("f", "t")
    zero = F.lit(0).cast("long").alias("scn")
    o = ok.select(zero, F.col("f").alias("origin"), F.col("f").alias("g"), F.lit(0.0).alias("t0"), F.lit(float(limit)).alias("lim")).distinct()
    times = written(R.shortest_times(none, walks, R.Scenarios(o)), "road_times")
    legs = R.path_legs(none, walks, times, ok.select(zero, F.col("f").alias("origin"), F.col("t").alias("target")))
    way = legs.select(F.col("origin").alias("f"), F.col("target").alias("t"), F.col("step").cast("int").alias("step"), F.col("f").alias("node"))
    way = way.unionByName(ok.select("f", "t", F.lit(0).alias("step"), F.col("t").alias("node")))
    xy = F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("k"), "x", "y")))
    drawn = way.join(places, "node").groupBy("f", "t").agg(xy.alias("p")).select("f", "t", F.transform("p", lambda q: q["x"]).alias("xs"), F.transform("p", lambda q: q["y"]).alias("ys"))
    a, b = (places.select(F.col("node").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ft")
    out = pairs.select("f", "t", "straight").join(by_road.select("f", "t", "m", "status"), ["f", "t"], "left").fillna(0, ["status"]).join(drawn, ["f", "t"], "left").join(a, "f", "left").join(b, "t", "left")
    return out.select("f", "t", "straight", "m", "status", F.coalesce("xs", F.array("xf", "xt")).alias("xs"), F.coalesce("ys", F.array("yf", "yt")).alias("ys"))


def status_summary(ways: DataFrame) -> DataFrame:
    """(status, n): 0 off the road, 1 by road, 2 no path, 3 a detour."""
    return ways.groupBy("status").agg(F.count("*").alias("n"))


def _keep(x: np.ndarray, y: np.ndarray, metres: float) -> list[int]:
    """Points that stay: the farthest from a chord splits it, as long as it is farther than ``metres``."""
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        n = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(px * dy - py * dx) / n if n else np.hypot(px, py)
        i = int(d.argmax())
        if d[i] > metres:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return sorted(keep)


def simplify(lines: DataFrame, metres: float = SIMPLIFY_M) -> DataFrame:
    """``lines`` (id, xs, ys) with fewer points, none of which strays by more than ``metres``."""

    def rows(batches):
        for b in batches:
            k = [_keep(np.array(x, float), np.array(y, float), metres) if len(x) else [] for x, y in zip(b["xs"], b["ys"], strict=True)]
            yield b.assign(xs=[[x[i] for i in j] for x, j in zip(b["xs"], k, strict=True)], ys=[[y[i] for i in j] for y, j in zip(b["ys"], k, strict=True)])

    return lines.mapInPandas(rows, lines.schema)
