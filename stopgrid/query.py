"""Interactive queries: search, what is near a point or in a box, and what if one thing is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopgrid.functions.geo import local_x, local_y
from stopgrid.plans import policies as Q
from stopgrid.plans import simulation as M


def search(items: DataFrame, text: str, limit: int = 12, contains: str | None = None, prefix: str | None = None) -> DataFrame:
    """(kind, id, rank): the best ``limit`` names, equal ones before prefixes before others; then by weight."""
    name = F.lower("name")
    t = text.lower()
    match = F.when(name == t, 0).when(name.startswith((prefix or t).lower()), 1).otherwise(2)
    hits = items.where(F.contains(name, F.lit((contains or t).lower()))).withColumn("m", match)
    top = hits.orderBy("m", F.desc("weight"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("m", F.desc("weight"), "id"))).select("kind", "id", "rank")


def nearest_group(groups: DataFrame, lon: float, lat: float) -> DataFrame:
    """(g): the group nearest to a point."""
    d = F.pow(local_x(F.col("lon")) - local_x(F.lit(lon)), 2) + F.pow(local_y(F.col("lat")) - local_y(F.lit(lat)), 2)
    return groups.select("g", F.round(d, 6).alias("d")).orderBy("d", "g").limit(1).select("g")


def near_point(net: M.Net, scores: DataFrame, lon: float, lat: float, metres: float, limit: int = 12) -> DataFrame:
    """(kind, id, line, dist, rank): groups, lines and segments within ``metres`` of a point, nearest first; among lines equally near the higher score.

    ``scores`` has line and score. A segment's id is its ends, ``a-b``.
    """
    px, py = local_x(F.lit(lon)), local_y(F.lit(lat))
    at = net.groups.select("g", local_x(F.col("lon")).alias("x"), local_y(F.col("lat")).alias("y"))
    dist = F.round(F.hypot(F.col("x") - px, F.col("y") - py), 3)
    none = F.lit(None).cast("long").alias("line")
    stops = at.select(F.lit("stop").alias("kind"), F.col("g").cast("string").alias("id"), none, dist.alias("dist"), F.lit(0.0).alias("score"))
    w = Window.partitionBy("pat").orderBy("pos")
    hops = net.stops.withColumn("b", F.lead("g").over(w)).where("b is not null").select("line", F.col("g").alias("a"), "b").distinct()
    hops = hops.join(at.select(F.col("g").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1")), "a").join(at.select(F.col("g").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), "b")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / n))).otherwise(0.0)
    hops = hops.withColumn("t", t).withColumn("dist", F.round(F.hypot(px - F.col("x1") - F.col("t") * dx, py - F.col("y1") - F.col("t") * dy), 3)).where(F.col("dist") <= metres)
    lines = hops.groupBy("line").agg(F.min("dist").alias("dist")).join(scores.select("line", "score"), "line")
    lines = lines.select(F.lit("line").alias("kind"), F.col("line").cast("string").alias("id"), "line", "dist", "score")
    ends = F.concat_ws("-", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    segs = hops.groupBy(ends.alias("id")).agg(F.min("dist").alias("dist")).select(F.lit("segment").alias("kind"), "id", none, "dist", F.lit(0.0).alias("score"))
    every = stops.where(F.col("dist") <= metres).unionByName(lines).unionByName(segs)
    top = every.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("dist", F.desc("score"), "id")))
    return top.where(F.col("rank") <= limit).select("kind", "id", "line", "dist", "rank")


def cell_index(segments: DataFrame, size: float, most: int = 16) -> DataFrame:
    """``segments`` (id, x1, y1, x2, y2) with the cells (cx, cy) of their box; one that touches more than ``most`` has null cells: it is always looked at.

    Written sorted by cell, a range of cells reads few row groups.
    """
    lo, hi = (lambda a, b: F.floor(F.least(a, b) / size)), (lambda a, b: F.floor(F.greatest(a, b) / size))
    x0, x1, y0, y1 = lo("x1", "x2"), hi("x1", "x2"), lo("y1", "y2"), hi("y1", "y2")
    cells = F.flatten(F.transform(F.sequence(x0, x1), lambda i: F.transform(F.sequence(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("cx"), F.lit(None).cast("bigint").alias("cy")))
    many = (x1 - x0 + 1) * (y1 - y0 + 1) > most
    return segments.withColumn("c", F.explode(F.when(many, none).otherwise(cells))).select(*segments.columns, "c.cx", "c.cy").sortWithinPartitions("cx", "cy")


def in_box(index: DataFrame, size: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(id): segments of a ``cell_index`` whose box touches the box asked for."""
    at = F.col("cx").isNull() | (F.col("cx").between(int(x0 // size), int(x1 // size)) & F.col("cy").between(int(y0 // size), int(y1 // size)))
    over = (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x1) & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y1)
    return index.where(at & over).select("id").distinct()


class Engine:
    """What-if questions about one thing at a time: the same jobs as for all, with a table of one row."""

    def __init__(self, net: M.Net):
        self.net = net
        self.spark = net.stops.sparkSession

    def _one(self, kind: str, *values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values)], kind)

    def line(self, line: int) -> M.Removal:
        """A line gone."""
        return M.line_removal(self.net, self._one("scn bigint, line bigint", 0, line))

    def line_policy(self, line: int, freq: float = 0.0, kind: int = Q.NONE, km: float = 0.0, wait: float = 0.0) -> DataFrame:
        """A line gone, before and after a policy or a combination of a frequency and links."""
        wanted = self._one(f"scn bigint, line bigint, {Q.CANDIDATE}", 0, line, float(freq), kind, float(km), float(wait))
        return Q.evaluate(self.net, wanted, self.line(line))

    def stop(self, g: int, temporary_m: float | None = None) -> DataFrame:
        """A stop closed, as it is or with a temporary one."""
        return M.stop_closure(self.net, temporary_m, self._one("g bigint", g))

    def segment(self, a: int, b: int) -> DataFrame:
        """A segment blocked both ways."""
        return M.segment_removal(self.net, self._one("scn bigint, a bigint, b bigint", 0, a, b))

    def journey(self, f: int, t: int) -> DataFrame:
        """The legs of a journey, backwards."""
        return M.journey_legs(self.net, self._one("scn bigint, f bigint, t bigint", 0, f, t))

    def resilience(self, f: int, t: int) -> DataFrame:
        """The journey without each of its lines."""
        return M.journey_resilience(self.net, self._one("f bigint, t bigint", f, t))
