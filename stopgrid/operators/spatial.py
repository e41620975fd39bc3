"""Joins by distance: points fall into square cells, and a point meets those of its own and the eight cells around.

The cell is an equi-join key, so Spark never compares all pairs; the exact
distance is a residual predicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopgrid.functions.geo import local_distance, local_x, local_y
from stopgrid.plans.storage import written


def _cells(df: DataFrame, lon: str, lat: str, metres: float) -> DataFrame:
    return df.withColumn("__cx", F.floor(local_x(F.col(lon)) / metres)).withColumn("__cy", F.floor(local_y(F.col(lat)) / metres))


def within(a: DataFrame, b: DataFrame, metres: float, extra=()) -> DataFrame:
    """Pairs at most ``metres`` apart: a's columns with ``a_``, b's with ``b_``, and dist. Both have lon and lat; ``extra`` names columns that must be equal."""
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    left = _cells(a, "lon", "lat", metres)
    left = left.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).withColumn("__cx", F.col("__cx") + F.col("__dx")).withColumn("__cy", F.col("__cy") + F.col("__dy")).drop("__dx", "__dy")
    left = left.select("__cx", "__cy", *[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = _cells(b, "lon", "lat", metres).select("__cx", "__cy", *[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = (left["__cx"] == right["__cx"]) & (left["__cy"] == right["__cy"])
    for c in extra:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    dist = local_distance(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    return left.join(right, on).drop("__cx", "__cy").withColumn("dist", dist).where(F.col("dist") <= metres)


def nearest(a: DataFrame, b: DataFrame, key: str, metres: float, rest: str = "g") -> DataFrame:
    """For each a, the nearest b within ``metres``; ties go to the least ``rest``."""
    w = Window.partitionBy(f"a_{key}").orderBy("dist", f"b_{rest}")
    return within(a, b, metres).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def nearest_other(points: DataFrame, key: str = "g", start: float = 400.0) -> DataFrame:
    """(key, dist): the distance to the nearest other point, in metres; a point alone has no row."""
    xy = points.select(F.col(key).alias("id"), local_x(F.col("lon")).alias("x"), local_y(F.col("lat")).alias("y"))
    return nearest_any(xy, xy, start, 4e7, other=True).select(F.col("id").alias(key), "dist")


def nearest_any(a: DataFrame, b: DataFrame, start: float, limit: float, other: bool = False) -> DataFrame:
    """(id, to, dist): for each point of ``a`` (id, x, y) the nearest of ``b`` (id, x, y), the least id among equals at nine digits; with ``other``, of another id.

    Points look at square cells around them, first of width ``start``, those
    that find none at cells eight times as wide, and so on up to ``limit``.
    Beyond the first step they compare occupied cells, each sixteen times as
    narrow, and only meet the points of those that may hold the nearest: an
    isolated point never meets all points.
    """
    b = b.select(F.col("id").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    found, todo, size = None, a.select("id", "x", "y"), start
    while size <= limit:
        got = written(_nearest_in(todo, b, size, 1 if size == start else 16, other), "nearest")
        found = got if found is None else found.unionByName(got)
        todo = written(todo.join(got, "id", "left_anti"), "isolated")
        if todo.isEmpty():
            break
        size *= 8
    return found


def _nearest_in(todo: DataFrame, b: DataFrame, size: float, parts: int, other: bool) -> DataFrame:
    """(id, to, dist) for points that have another within ``size``."""
    fine = size / parts
    cell = lambda c, m: F.floor(F.col(c) / m)
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    at = todo.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select("id", "x", "y", (cell("x", size) + F.col("dx")).alias("cx"), (cell("y", size) + F.col("dy")).alias("cy"))
    there = b.select("to", "x2", "y2", cell("x2", fine).alias("fx"), cell("y2", fine).alias("fy"))
    if parts == 1:
        open_ = at.withColumnsRenamed({"cx": "fx", "cy": "fy"})
    else:
        occupied = there.groupBy("fx", "fy").agg(F.count("*").alias("n")).withColumn("cx", F.floor(F.col("fx") / parts)).withColumn("cy", F.floor(F.col("fy") / parts))
        pairs = at.join(occupied, ["cx", "cy"])
        if other:  # a cell that may hold the point itself only bounds nothing
            own = (cell("x", fine) == F.col("fx")) & (cell("y", fine) == F.col("fy"))
            pairs = pairs.where(~own | (F.col("n") > 1))
        low = lambda c, f: F.greatest(F.lit(0.0), F.col(f) * fine - F.col(c), F.col(c) - (F.col(f) + 1) * fine)
        high = lambda c, f: F.greatest(F.abs(F.col(c) - F.col(f) * fine), F.abs(F.col(c) - (F.col(f) + 1) * fine))
        pairs = pairs.withColumn("least", F.hypot(low("x", "fx"), low("y", "fy"))).withColumn("most", F.hypot(high("x", "fx"), high("y", "fy")))
        bound = pairs.groupBy("id").agg(F.min("most").alias("bound"))
        open_ = pairs.join(bound, "id").where(F.col("least") <= F.col("bound") * (1 + 1e-9)).select("id", "x", "y", "fx", "fy")
    met = open_.join(there, ["fx", "fy"])
    if other:
        met = met.where(F.col("to") != F.col("id"))
    dist = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    best = met.withColumn("dist", dist).where(F.col("dist") <= size).groupBy("id").agg(F.min(F.struct(F.round(F.col("dist") / size, 9).alias("d"), "to", "dist")).alias("m"))
    return best.select("id", F.col("m.to").alias("to"), F.col("m.dist").alias("dist"))


def dissolve(areas: DataFrame) -> DataFrame:
    """(parent, parts, members, rings): the areas (area, parent, ring) of each larger area, in order.

    Their rings stay a collection: joining outlines needs a geometry library.
    """
    all_ = F.array_sort(F.collect_list(F.struct("area", "ring")))
    return areas.groupBy("parent").agg(F.count("*").alias("parts"), all_.alias("x")).select("parent", "parts", F.transform("x", lambda v: v["area"]).alias("members"), F.transform("x", lambda v: v["ring"]).alias("rings"))


def in_ring(lon, lat, ring):
    """Even-odd test of a point against a ring, an array of (x, y)."""
    n = F.size(ring)

    def crosses(p, i):
        q = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        return F.when(((p["y"] > lat) != (q["y"] > lat)) & (lon < (q["x"] - p["x"]) * (lat - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def _boxes(areas: DataFrame, cell: float) -> DataFrame:
    """Rings with their boxes, in each cell that a box touches."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = areas.select("area", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return box.withColumn("cx", over("x0", "x1")).withColumn("cy", over("y0", "y1"))


def _nearest_area(points: DataFrame, areas: DataFrame, start: float) -> DataFrame:
    """(lon, lat, area): the area with the nearest edge, by cells that widen for those that have found none."""
    from stopgrid.operators.roads import snap

    n = F.size("ring")
    ends = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at("ring", (i + 1) % n + 1)["x"].alias("x2"), F.element_at("ring", (i + 1) % n + 1)["y"].alias("y2")))
    edges = areas.select(F.col("area").alias("link"), F.explode(ends).alias("e")).select("link", "e.*")
    todo = written(points.select("lon", "lat").withColumn("id", F.xxhash64("lon", "lat")).withColumn("x", F.col("lon")).withColumn("y", F.col("lat")), "outside")
    found, size = None, start
    while not todo.isEmpty():
        # Degrees stand for metres here; distances are compared at nine digits.
        got = written(snap(todo.select("id", "x", "y"), edges, size, digits=9).select("id", F.col("link").alias("area")), "nearest_area")
        own = todo.join(got, "id").select("lon", "lat", "area")
        found = own if found is None else found.unionByName(own)
        todo = written(todo.join(got, "id", "left_anti"), "outside")
        size *= 4
        if size > 1000:
            break
    return found if found is not None else points.select("lon", "lat").join(areas.select("area").limit(0))


def locate(points: DataFrame, areas: DataFrame, cell: float = 0.5, nearest: bool = False) -> DataFrame:
    """``points`` with area: that whose ring holds the point (least id if several), else null or, with ``nearest``, the one of the nearest edge.

    Rings (area, ring) meet points by cells of their boxes; each place is located once.
    """
    places = points.select("lon", "lat").distinct()
    at = places.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    inside = at.join(_boxes(areas, cell), ["cx", "cy"]).where(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")) & in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    found = inside.groupBy("lon", "lat").agg(F.min("area").alias("area"))
    if nearest and not areas.isEmpty():
        found = written(found, "located")
        found = found.unionByName(_nearest_area(places.join(found, ["lon", "lat"], "left_anti"), areas, cell / 4))
    named = found.select(F.col("lon").alias("__lon"), F.col("lat").alias("__lat"), "area")
    own = points.drop("area")
    return own.join(named, (F.col("lon") == F.col("__lon")) & (F.col("lat") == F.col("__lat")), "left").select(*own.columns, "area")
