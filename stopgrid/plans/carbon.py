"""Inputs of the emissions that a removal causes, from public tables, for each province."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid.functions import text


def cars_per_person(cars: DataFrame) -> DataFrame:
    """(sido, cars): cars per person of registrations (name, cars, people) with a row for the country.

    The one province without a number, JOINT, has what the others leave of the
    country's; a row with the empty name holds the country's mean.
    """
    whole = cars.where(F.col("name") == P.COUNTRY).agg(F.first("cars").alias("c"), F.first("people").alias("p"))
    known = cars.where((F.col("name") != P.COUNTRY) & F.col("cars").isNotNull())
    short = known.select(text.sido_short(F.col("name")).alias("sido"), (F.col("cars") / F.col("people")).alias("cars"))
    sums = known.agg(F.coalesce(F.sum("cars"), F.lit(0.0)).alias("kc"), F.coalesce(F.sum("people"), F.lit(0.0)).alias("kp")).crossJoin(F.broadcast(whole))  # one row each
    rest = sums.select(F.lit(P.JOINT).alias("sido"), ((F.col("c") - F.col("kc")) / (F.col("p") - F.col("kp"))).alias("cars"))
    return short.unionByName(rest.join(short.select("sido"), "sido", "left_anti")).unionByName(whole.select(F.lit("").alias("sido"), (F.col("c") / F.col("p")).alias("cars")))


def emissions(models: DataFrame, makers: tuple[str, ...] = P.DOMESTIC_MAKERS) -> DataFrame:
    """One row (kg, kg_all, n, n_all): kilograms a kilometre, the mean of domestic models (maker, co2 in grams) and of all."""
    own = F.lit(False)
    for m in makers:
        own = own | F.contains("maker", F.lit(m))
    g = F.col("co2") / 1000
    return models.agg(F.avg(F.when(own, g)).alias("kg"), F.avg(g).alias("kg_all"), F.count_if(own).alias("n"), F.count("*").alias("n_all"))


def relative_usage(usage: DataFrame, shares: list[str], mids: tuple[float, ...] = P.USAGE_MIDS, whole: str = "전체") -> DataFrame:
    """(name, relative): mean uses a week by the shares of classes with these middles, against the row named ``whole``."""
    total = sum(F.col(c) for c in shares)
    mean = sum(F.col(c) * m for c, m in zip(shares, mids, strict=True)) / total
    own = usage.where(total > 0).select("name", mean.alias("u"))
    base = own.where(F.col("name") == whole).agg(F.first("u").alias("b"))
    return own.where(F.col("name") != whole).crossJoin(F.broadcast(base)).select("name", (F.col("u") / F.col("b")).alias("relative"))  # one row


def line_inputs(lines: DataFrame, cars: DataFrame, kg: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """(line, transit, cars, kg, kg_all): trips by public transport a person and day, and the rest, of lines (line, sido)."""
    share = F.when(F.col("sido") == P.CAPITAL, P.TRANSIT_SHARE[0]).when(F.col("sido").isin(*P.METRO_CITIES), P.TRANSIT_SHARE[1]).otherwise(P.TRANSIT_SHARE[2])
    x = lines.select("line", "sido").join(cars.where("sido <> ''").withColumnRenamed("cars", "own"), "sido", "left").crossJoin(F.broadcast(cars.where("sido = ''").select(F.col("cars").alias("mean")))).crossJoin(F.broadcast(kg))  # one row each
    x = x.withColumn("relative", F.lit(1.0)) if usage is None else x.join(usage.withColumnRenamed("name", "sido"), "sido", "left").fillna(1.0, ["relative"])
    return x.select("line", (P.TRIPS_A_DAY / P.RETURN_SHARE * share * F.col("relative")).alias("transit"), F.coalesce("own", "mean").alias("cars"), "kg", "kg_all")
