"""Matching by keys in tiers, and by overlap of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopgrid.plans.storage import written


def match_regions(areas: DataFrame, people: DataFrame) -> DataFrame:
    """(ix, tier, people, senior, rows): areas (ix, code, name) with the rows of ``people`` (code, name, total, senior) that are theirs.

    Tiers, each for what the ones before left: ``code``; ``name``, the name
    without its first part, once among people's rows; ``sido``, the first
    letters and the last part, once on either side; ``split``, where quarters
    were divided: all rows left of one province whose last part begins with the
    area's without numbers, which go to the first such area by ix. ``senior`` is
    a number of people.
    """
    from stopgrid.functions import text

    a = areas.select("ix", "code", text.dong_key(F.col("name")).alias("k2"), text.sido_dong_key(F.col("name")).alias("k3"), F.substring(F.split(F.trim("name"), r"\s+")[0], 1, 2).alias("sido"), text.split_base(F.element_at(F.split(F.trim("name"), r"\s+"), -1)).alias("base"))
    p = people.select(F.col("code").alias("pcode"), "total", "senior", text.dong_key(F.col("name")).alias("k2"), text.sido_dong_key(F.col("name")).alias("k3"), F.substring(F.split(F.trim("name"), r"\s+")[0], 1, 2).alias("psido"), F.element_at(F.split(F.trim("name"), r"\s+"), -1).alias("last"))
    once = lambda df, k: df.withColumn("__n", F.count("*").over(Window.partitionBy(k))).where("__n = 1").drop("__n")
    t1 = written(a.join(p.select(F.col("pcode").alias("code"), F.col("pcode")), "code").select("ix", "pcode", F.lit("code").alias("tier")), "matched")
    rest, left = p.join(t1, "pcode", "left_anti"), a.join(t1, "ix", "left_anti")
    t2 = written(left.join(once(rest, "k2").select("k2", "pcode"), "k2").select("ix", "pcode", F.lit("name").alias("tier")), "matched")
    # A name that any matched area has is used up.
    used = a.join(t1.unionByName(t2).select("ix"), "ix", "left_semi").select("k2").distinct()
    rest3 = rest.join(used, "k2", "left_anti")
    t3 = once(a, "k3").join(left.join(t2, "ix", "left_anti").select("ix"), "ix", "left_semi").join(once(rest3, "k3").select("k3", "pcode"), "k3").select("ix", "pcode", F.lit("sido").alias("tier"))
    t3 = written(t3, "matched")
    three = t1.unionByName(t2).unionByName(t3)
    open_ = a.join(three, "ix", "left_anti").where(F.length("base") >= 2)
    free = p.join(three, "pcode", "left_anti")
    # Prefixes of a last part are few and short, so rows meet areas by them.
    begins = free.select("pcode", "psido", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("last"), F.lit(2))), lambda n: F.substring("last", 1, n))).alias("base"))
    # Areas of one name stand for each other: only the first of them can get a row.
    first = open_.groupBy("base", F.col("sido").alias("psido")).agg(F.min("ix").alias("ix"))
    t4 = first.join(begins, ["base", "psido"]).groupBy("pcode").agg(F.min("ix").alias("ix")).select("ix", "pcode", F.lit("split").alias("tier"))
    sums = three.unionByName(t4).join(people.select(F.col("code").alias("pcode"), "total", "senior"), "pcode").groupBy("ix", "tier").agg(F.sum("total").alias("people"), F.sum("senior").alias("senior"), F.count("*").alias("rows"))
    return areas.select("ix").join(sums, "ix", "left").fillna("none", ["tier"]).fillna(0, ["rows"]).select("ix", "tier", "people", "senior", "rows")


def reassigned(own: DataFrame) -> DataFrame:
    """(id, new): rows (id, old, new) without a new region get the one that most rows of their old region have; ties go to the least."""
    n = own.where("new is not null").groupBy("old", "new").agg(F.count("*").alias("n"))
    most = n.groupBy("old").agg(F.max(F.struct("n", (-F.col("new")).alias("least"))).alias("x")).select("old", (-F.col("x.least")).alias("most"))
    return own.join(most, "old", "left").select("id", F.coalesce("new", "most").alias("new"))


def overlaps(edges: DataFrame, item: str, block: str, least: float) -> DataFrame:
    """(t1, t2, common, overlap, jaccard) of items in one block that share at least ``least`` of the smaller one's edges."""
    sized = edges.withColumn("__n", F.count("*").over(Window.partitionBy(item)))
    a = sized.select(F.col(item).alias("t1"), block, "a", "b", F.col("__n").alias("n1"))
    b = sized.select(F.col(item).alias("t2"), block, "a", "b", F.col("__n").alias("n2"))
    n = a.join(b, [block, "a", "b"]).where("t1 < t2").groupBy("t1", "t2").agg(F.count("*").alias("common"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    n = n.withColumn("overlap", F.col("common") / F.least("n1", "n2")).withColumn("jaccard", F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")))
    return n.where(F.col("overlap") >= least)


def co_located(line_group: DataFrame) -> DataFrame:
    """(a, b, n): pairs of lines and the number of groups both serve."""
    x, y = line_group.select(F.col("line").alias("a"), "g"), line_group.select(F.col("line").alias("b"), "g")
    return x.join(y, "g").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
