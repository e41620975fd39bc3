"""Connected components by alternating star contraction.

Each round replaces edges by edges to the least neighbour, first from larger
neighbours (large star), then from smaller ones (small star); the number of
rounds grows with the logarithm of the longest path. Every round is two
aggregates with partial sums and two equi-joins, and its edges are written to
the shared folder, so the lineage stays short and a lost executor costs one
round at most. A caller may let the driver join few edges, of which rounds cost
more than the work in them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopgrid.plans.storage import written


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node that each reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(names))
    while len(apart := np.flatnonzero(root[x] != root[y])):
        p, q = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while len(np.flatnonzero(root[root] != root)):
            root = root[root]
    return names, names[root]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local: int = 0) -> DataFrame:
    """(node, component) for each node of an edge; component is the least node reachable.

    Null ends and self-loops join nothing; a node with only a self-loop is its own component.
    Up to ``local`` edges of longs are joined by the driver.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    if local and {t for _, t in ends.dtypes} == {"bigint"} and ends.count() <= local:
        import pyarrow as pa

        few = ends.toArrow()
        of = pa.table(dict(zip(("node", "component"), _least(few.column("a").to_numpy(), few.column("b").to_numpy()), strict=True)))
        return written(edges.sparkSession.createDataFrame(of, "node bigint, component bigint"), "components")
    loops = ends.where("a = b").select("a").distinct()
    now = written(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _sum(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(small, "a")
        moved = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _sum(now)
        if state == before:
            break
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    linked = stars.unionByName(roots)
    alone = loops.select(F.col("a").alias("node")).join(linked.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return linked.unionByName(alone)


def _sum(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
