"""Networks made of the star-schema tables, as DataFrames; ``SQL`` holds the same views for an SQL engine.

- st: stop times; a trip is an order, a stop group one of eight supplier classes.
- f2_*: a grid of suppliers, ten columns wide, with a line in both directions
  along each row and each column but three, where groups have one line only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopgrid.operators.sequences import collapse

LON0, LAT0, STEP = 127.0, 36.0, 0.004
HOP, WAIT = 3.0, 5.0

SQL = {
    "st0": """select l_orderkey trip, row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) pos, l_suppkey % 8 g from lineitem""",
    "st1": "select trip, pos, g, lag(g) over (partition by trip order by pos) was from st0",
    "st2": "select trip, pos, g, count(*) over (partition by trip) n from st1 where was is null or was <> g",
    "st": """select s.trip, cast(row_number() over (partition by s.trip order by s.pos) - 1 as bigint) pos, s.g, o.o_custkey % 40 route, o.o_custkey % 8 as mode, c.c_mktsegment as name from st2 s join orders o on o.o_orderkey = s.trip join customer c on c.c_custkey = o.o_custkey where s.n >= 2""",
    "f2_stop": """select cast(s_suppkey as bigint) g, cast(127.0 as double) + (s_suppkey % 10) * cast(0.004 as double) lon, cast(36.0 as double) + cast(floor(s_suppkey / 10) as bigint) * cast(0.004 as double) lat, greatest(cast(0 as double), s_acctbal) pop, case when s_suppkey % 7 = 0 then 1 else 0 end dest, cast(s_nationkey as bigint) region, s_name as name from supplier""",
    "f2_s": """select cast(s_suppkey as bigint) g, cast(s_suppkey % 10 as bigint) x, cast(floor(s_suppkey / 10) as bigint) y, (select cast(floor(max(s_suppkey) / 10) as bigint) from supplier) my from supplier""",
    "f2_all": """select y line, y * 2 pat, x pos, g from f2_s union all select y, y * 2 + 1, 9 - x, g from f2_s union all select 1000 + x, (1000 + x) * 2, y, g from f2_s where x not between 2 and 4 union all select 1000 + x, (1000 + x) * 2 + 1, my - y, g from f2_s where x not between 2 and 4""",
    "f2_ps": """select line, pat, pos, g, pos * cast(3.0 as double) cum, cast(case when line = 1000 then 2 when line >= 1000 then 1 else 0 end as bigint) as mode, cast(5 + line % 30 as double) trips from f2_all where pat in (select pat from f2_all group by pat having count(*) >= 2)""",
    "f2_walk": """select a.g a, b.g b, sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(36.2)), 2) + power((a.lat - b.lat) * 111320.0, 2)) * 1.25 / 75.0 as minutes from f2_stop a join f2_stop b on a.g <> b.g and sqrt(power((a.lon - b.lon) * 111320.0 * cos(radians(36.2)), 2) + power((a.lat - b.lat) * 111320.0, 2)) <= 400""",
}
SQL["f2_trip"] = """select distinct cast(c_custkey % n as bigint) f, cast((c_custkey * 7 + 3) % n as bigint) t from customer, (select max(s_suppkey) + 1 n from supplier) where c_custkey % n <> (c_custkey * 7 + 3) % n"""
NEEDS = {"st1": ["st0"], "st2": ["st1"], "st": ["st2"], "f2_all": ["f2_s"], "f2_ps": ["f2_all"], "f2_walk": ["f2_stop"]}


def with_views(body: str, *names: str, recursive: str = "") -> str:
    """``body`` under a WITH clause of the views named and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({SQL[n]})" for n in order]
    if recursive:
        parts.append(recursive)
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def stop_times(spark: SparkSession, d: str) -> DataFrame:
    """(trip, pos, g): raw, in order, with repeats."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), F.row_number().over(w).alias("pos"), (F.col("l_suppkey") % 8).alias("g"))


def st(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("trip"), (F.col("o_custkey") % 40).alias("route"), (F.col("o_custkey") % 8).alias("mode"), "o_custkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("name"))
    seq = collapse(stop_times(spark, d)).withColumn("pos", F.col("pos").cast("long"))
    return seq.join(o, "trip").join(c, "o_custkey").select("trip", "pos", "g", "route", "mode", "name")


def f2_stop(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey").cast("long")
    return s.select(
        k.alias("g"), (F.lit(LON0) + (k % 10) * STEP).alias("lon"), (F.lit(LAT0) + F.floor(k / 10) * STEP).alias("lat"),
        F.greatest(F.lit(0.0), "s_acctbal").alias("pop"), (k % 7 == 0).cast("int").alias("dest"), F.col("s_nationkey").cast("long").alias("region"), F.col("s_name").alias("name"),
    )


def f2_ps(spark: SparkSession, d: str) -> DataFrame:
    """(line, pat, pos, g, cum, mode, trips)."""
    k = F.col("s_suppkey").cast("long")
    s = read(spark, d, "supplier").select(k.alias("g"), (k % 10).alias("x"), F.floor(k / 10).cast("long").alias("y"))
    s = s.crossJoin(F.broadcast(s.agg(F.max("y").alias("my"))))  # one row
    col = lambda line, pat, pos: F.struct(line.alias("line"), pat.alias("pat"), pos.alias("pos"))
    x, y, my = F.col("x"), F.col("y"), F.col("my")
    rows = F.array(col(y, y * 2, x), col(y, y * 2 + 1, 9 - x))
    columns = F.array(col(1000 + x, (1000 + x) * 2, y), col(1000 + x, (1000 + x) * 2 + 1, my - y))
    # Three columns have no line; a row of their number has one.
    ways = F.when(x.between(2, 4), rows).otherwise(F.concat(rows, columns))
    p = s.select("g", F.explode(ways).alias("p")).select("p.line", "p.pat", "p.pos", "g")
    p = p.withColumn("__n", F.count("*").over(Window.partitionBy("pat"))).where("__n >= 2").drop("__n")
    mode = F.when(F.col("line") == 1000, 2).when(F.col("line") >= 1000, 1).otherwise(0).cast("long")
    return p.withColumn("cum", F.col("pos") * HOP).withColumn("mode", mode).withColumn("trips", (5 + F.col("line") % 30).cast("double"))


def f2_walk(spark: SparkSession, d: str, metres: float = 400.0) -> DataFrame:
    """(a, b, minutes), both ways."""
    from stopgrid.functions.geo import walk_minutes
    from stopgrid.operators.spatial import within

    s = f2_stop(spark, d).select("g", "lon", "lat")
    return within(s, s, metres).where("a_g <> b_g").select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), walk_minutes(F.col("dist")).alias("minutes"))


def f2_trip(spark: SparkSession, d: str) -> DataFrame:
    """(f, t): the journeys that customers ask for."""
    n = F.broadcast(read(spark, d, "supplier").agg((F.max("s_suppkey") + 1).alias("n")))  # one row
    k = F.col("c_custkey").cast("long")
    c = read(spark, d, "customer").crossJoin(n).select((k % F.col("n")).alias("f"), ((k * 7 + 3) % F.col("n")).alias("t"))
    return c.where("f <> t").distinct()


def f2_net(spark: SparkSession, d: str):
    """The grid of suppliers as a network."""
    from stopgrid.plans.simulation import Net

    return Net(f2_ps(spark, d).withColumn("wait", F.lit(WAIT)), f2_walk(spark, d), f2_stop(spark, d))


def once(make):
    """A function (spark, d) whose result, tables in the shared folder, is made once for each session and folder."""
    kept = {}

    def get(spark: SparkSession, d: str):
        key = (spark.sparkContext.applicationId, d)
        if key not in kept:
            kept[key] = make(spark, d)
        return kept[key]

    return get
