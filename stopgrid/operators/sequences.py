"""Stop sequences: patterns, edges, frequencies, samples along a line.

Every function works on rows (sequence, position, group); a sequence is a
window partition, as long as a trip, so no partition grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(stops: DataFrame, trip: str = "trip", pos: str = "pos", g: str = "g", least: int = 2) -> DataFrame:
    """Rows whose group differs from the one before, renumbered from 0; sequences of fewer than ``least`` rows are dropped."""
    w = Window.partitionBy(trip).orderBy(pos)
    kept = stops.withColumn("__was", F.lag(g).over(w)).where(F.col("__was").isNull() | (F.col("__was") != F.col(g))).drop("__was")
    n = kept.withColumn("__n", F.count("*").over(Window.partitionBy(trip))).where(F.col("__n") >= least).drop("__n")
    return n.withColumn(pos, F.row_number().over(w) - 1)


def patterns(stops: DataFrame, trip: str = "trip", pos: str = "pos", g: str = "g", route: str = "route") -> DataFrame:
    """(route, stops, trips): trips with one ordered sequence of groups are one pattern of their route."""
    seq = stops.groupBy(trip, route).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, g))), lambda x: x[g]).alias("stops"))
    return seq.groupBy(route, "stops").agg(F.count("*").alias("trips"))


def edges(stops: DataFrame, by: str, pos: str = "pos", g: str = "g") -> DataFrame:
    """(by, a, b) for consecutive groups, directed; of one position the lesser group comes first."""
    w = Window.partitionBy(by).orderBy(pos, g)
    return stops.withColumn("b", F.lead(g).over(w)).where("b is not null").withColumnRenamed(g, "a")


def ends(stops: DataFrame, by: str, *more: Column, pos: str = "pos", g: str = "g") -> DataFrame:
    """(by, x, y, more): the first and the last group in the order of ``edges``."""
    at = F.struct(pos, g)
    return stops.groupBy(by).agg(F.min_by(g, at).alias("x"), F.max_by(g, at).alias("y"), *more)


def undirected(e: DataFrame, keys: list[str]) -> DataFrame:
    return e.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_loop_end(stops: DataFrame, by: str, pos: str = "pos", g: str = "g") -> DataFrame:
    """(by, end): the first later position that is at the first group again."""
    first = F.first(g).over(Window.partitionBy(by).orderBy(pos))
    return stops.withColumn("__f", first).groupBy(by).agg(F.min(F.when((F.col(pos) > 0) & (F.col(g) == F.col("__f")), F.col(pos))).alias("end"))


def od_positions(n: Column, fractions: tuple[float, ...]) -> Column:
    """Distinct positions at fractions of a sequence of n, halves up."""
    return F.array_distinct(F.array(*[F.floor((n - 1) * f + 0.5).cast("int") for f in fractions]))
