"""External tables whose columns are found by patterns and whose encoding is not known."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid.functions import geo, score, text

ENCODINGS = ("UTF-8", "x-windows-949", "EUC-KR")


def decoding(spark: SparkSession, path: str) -> str:
    """The first of ENCODINGS in which every line of the file can be read; the last one if none can.

    Lines are decoded by the executors, so every byte counts. A line's bytes are
    the same in the encodings tried, as a line end is no part of a longer sign.
    """
    names = {"UTF-8": "utf-8", "x-windows-949": "cp949", "EUC-KR": "euc-kr"}
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))  # the bytes as they are

    def bad(batches):
        import pyarrow as pa

        for b in batches:
            lost = {e: 0 for e in ENCODINGS}
            for line in b.column(0).to_pylist():
                for e in ENCODINGS:
                    try:
                        line.decode(names[e])
                    except UnicodeDecodeError:
                        lost[e] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(lost)), pa.array(list(lost.values()), pa.int64())], ["e", "n"])

    lost = {r.e: r.n for r in raw.mapInArrow(bad, "e string, n bigint").groupBy("e").agg(F.sum("n").alias("n")).collect()}
    return next((e for e in ENCODINGS if not lost.get(e)), ENCODINGS[-1])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, all strings, in the first encoding that reads all of it."""
    e = decoding(spark, path)
    if e != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark else knows Unicode and Latin only
    df = spark.read.csv(path, header=True, encoding=e)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def find(columns: list[str], pattern: str) -> str | None:
    return next((c for c in columns if re.search(pattern, c)), None)


def population_narrow(df: DataFrame) -> DataFrame:
    """(code, name, level, total, senior, senior_pct): a region cell holds a ten-digit code; bins of age are columns of the first month."""
    region = find(df.columns, "행정구역")
    month = next(c.split("_")[0] for c in df.columns if "_계_" in c)
    total = find(df.columns, f"^{re.escape(month)}_계_총인구수")
    bins = []
    for c in df.columns:
        if not c.startswith(f"{month}_계_"):
            continue
        if m := re.search(r"_(\d+)~(\d+)세", c):
            bins.append((int(m[1]), int(m[2]), c))
        elif m := re.search(r"_(\d+)세 ?이상", c):
            bins.append((int(m[1]), 200, c))
    senior = reduce(lambda a, b: a + b, [score.senior_share(F.lit(lo), F.lit(hi), text.num_clean(F.col(f"`{c}`"))) for lo, hi, c in bins], F.lit(0.0))
    out = df.select(F.regexp_extract(region, r"\((\d{10})\)", 1).alias("code"), F.trim(F.regexp_replace(region, r"\(\d{10}\)", "")).alias("name"), text.num_clean(F.col(f"`{total}`")).alias("total"), senior.alias("senior"))
    out = out.where("code <> ''").dropDuplicates(["code"])
    return out.withColumn("level", text.admin_level(F.col("code"))).withColumn("senior_pct", F.when(F.col("total") > 0, 100 * F.col("senior") / F.col("total")))


def population_wide(df: DataFrame) -> DataFrame:
    """The same from one column for each age and sex."""
    code = find(df.columns, "기관코드|코드")
    ages = [(int(m[1]), c) for c in df.columns if (m := re.search(r"(\d+)세", c))]
    both = [(a, c) for a, c in ages if "계" in c] or ages
    add = lambda cs: reduce(lambda a, b: a + b, [text.num_clean(F.col(f"`{c}`")) for c in cs], F.lit(0.0))
    names = [c for c in df.columns if c in ("시도명", "시군구명", "읍면동명")]
    out = df.select(F.col(code).alias("code"), F.concat_ws(" ", *names).alias("name"), add([c for _, c in both]).alias("total"), add([c for a, c in both if a >= 65]).alias("senior"))
    out = out.where(F.col("code").rlike(r"^\d{10}$")).dropDuplicates(["code"])
    return out.withColumn("level", text.admin_level(F.col("code"))).withColumn("senior_pct", F.when(F.col("total") > 0, 100 * F.col("senior") / F.col("total")))


def without_kinds(df: DataFrame, exclude: str = P.EXCLUDED_KINDS) -> DataFrame:
    """Facilities (kind) but those whose kind matches."""
    return df.where(~F.coalesce(F.col("kind"), F.lit("")).rlike(exclude))


def facilities(df: DataFrame, exclude: str | None = P.EXCLUDED_KINDS, kind: str | None = None) -> DataFrame:
    """(name, kind, lon, lat) within the country's box, without excluded kinds; ``kind`` names all of a list of one kind."""
    cols = {k: next((c for c in df.columns if re.search(v, c, re.I)), None) for k, v in P.FACILITY_COLUMNS.items()}
    if cols["lon"] is None or cols["lat"] is None:
        raise ValueError(f"no columns of coordinates among {df.columns}")
    of = lambda k: F.col(f"`{cols[k]}`") if cols[k] else F.lit("")
    own = F.lit(kind) if kind else of("kind")
    out = df.select(of("name").alias("name"), own.alias("kind"), of("lon").try_cast("double").alias("lon"), of("lat").try_cast("double").alias("lat")).where(geo.in_bbox(F.col("lon"), F.col("lat")))
    return without_kinds(out, exclude) if exclude else out


def facility_stats(df: DataFrame, pharmacy: str = P.PHARMACY) -> DataFrame:
    """One row (count, hospitals, pharmacies)."""
    own = F.contains(F.coalesce(F.col("kind"), F.lit("")), F.lit(pharmacy))
    return df.agg(F.count("*").alias("count"), F.count_if(~own).alias("hospitals"), F.count_if(own).alias("pharmacies"))


def senior_optional(df: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, senior): shares (sigungu_code and senior_pct, or sido, sigungu and senior_pct) of regions (region, code, sido, name).

    A code, its first five digits, comes before the names, without marks, under
    the first two letters of the province; -1 where neither is known.
    """
    has = lambda c: F.trim(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    v = F.col("senior_pct").try_cast("double").alias("v")
    by_code = df.select(F.substring(has("sigungu_code"), 1, 5).alias("code"), v).where("code <> ''").groupBy("code").agg(F.last("v").alias("by_code"))
    name = text.normalize_name(has("sigungu"))
    by_name = df.select(F.concat_ws("|", F.substring(F.coalesce(has("sido"), F.lit("")), 1, 2), name).alias("key"), name.alias("n"), v).where("n <> ''").groupBy("key").agg(F.last("v").alias("by_name"))
    r = regions.select("region", F.substring("code", 1, 5).alias("code"), F.concat_ws("|", "sido", text.normalize_name(F.col("name"))).alias("key"))
    return r.join(by_code, "code", "left").join(by_name, "key", "left").select("region", F.coalesce("by_code", "by_name", F.lit(-1.0)).alias("senior"))


def coarse_senior(regions: DataFrame, fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(region, senior, source): the share of seniors of regions (region, parent), from their own row (region, total, senior), else their parent's, else -1."""
    share = lambda df, k: df.select(k, (100.0 * F.col("senior") / F.col("total")).alias("v"))
    x = regions.join(share(fine, "region").withColumnRenamed("v", "a"), "region", "left").join(share(coarse, "parent").withColumnRenamed("v", "b"), "parent", "left")
    return x.select("region", F.coalesce("a", "b", F.lit(-1.0)).alias("senior"), F.when(F.col("a").isNotNull(), "fine").when(F.col("b").isNotNull(), "coarse").otherwise("none").alias("source"))


def carbon_tables(cars: DataFrame, fuel: DataFrame, usage: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``plans.carbon`` from the converted sheets: registrations (name, cars, people), petrol cars (maker, co2), usage (name, s0 to s4).

    Columns are found by place in the first and the last, by name in the second.
    """
    n = lambda c: text.num_clean(F.col(f"`{c}`"))
    c = cars.columns
    has = F.col(f"`{c[2]}`").isNotNull() & (F.trim(F.col(f"`{c[2]}`")) != "")
    a = cars.select(F.trim(F.col(f"`{c[0]}`")).alias("name"), F.when(has, n(c[2])).alias("cars"), n(c[3]).alias("people")).where("name <> '' and people > 0")
    g = fuel.where((F.col("`연료`") == "휘발유") & (F.col("`자동차 종류`") == "승용차") & (F.col("`차량형식`") == "내연기관"))
    b = g.select(F.col("`업체명`").alias("maker"), n("CO2배출량(g/km)").alias("co2"))
    u = usage.columns
    num = [F.col(f"`{x}`").try_cast("double").alias(f"s{i}") for i, x in enumerate(u[-5:])]
    return a, b, usage.select(F.trim(F.col(f"`{u[0]}`")).alias("name"), *num).where(" and ".join(f"s{i} is not null" for i in range(5)))


def points(df: DataFrame) -> DataFrame:
    """(lon, lat, value); rows that are no numbers are left out."""
    v = F.col("value").try_cast("double") if "value" in df.columns else F.lit(1.0)
    return df.select(F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"), v.alias("value")).where("lon is not null and lat is not null")


def boardings(df: DataFrame, stop: str) -> DataFrame:
    """(stop, n): the sum of all boarding columns."""
    cols = [c for c in df.columns if "승차총승객수" in c]
    return df.groupBy(F.regexp_replace(stop, r"\(\d+\)", "").alias("stop")).agg(F.sum(sum(text.num_clean(F.col(f"`{c}`")) for c in cols)).alias("n"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(area, name, ring): the outer rings of polygons and multipolygons."""
    f = spark.read.json(path, multiLine=True, schema="features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>")
    one = f.select(F.posexplode("features").alias("area", "f"))
    ring = "array<array<array<double>>>"
    poly = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", ring)))
    rings = F.coalesce(poly, F.from_json("f.geometry.coordinates", f"array<{ring}>"))
    flat = one.select("area", F.try_element_at("f.properties", F.lit("name")).alias("name"), F.explode(rings).alias("p"))
    # "A시B구" is written "A시 B구".
    return flat.select("area", F.regexp_replace("name", r"(\S+시)(\S+구)$", "$1 $2").alias("name"), F.transform(F.element_at("p", 1), lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("ring"))


def legacy_network(page: str) -> dict:
    """The JSON objects of a page's script blocks by id, plain or gzipped as base64."""
    import base64
    import gzip

    out = {}
    for i, body in re.findall(r'<script[^>]*id="([^"]+)"[^>]*>(.*?)</script>', page, re.S):
        t = body.strip()
        try:
            out[i] = json.loads(t) if t[:1] in "[{" else json.loads(gzip.decompress(base64.b64decode(t)))
        except (ValueError, OSError):
            continue
    return out


def network_tables(spark: SparkSession, page: str, stops: str, routes: str) -> dict[str, DataFrame]:
    """stops and patterns, as ``gtfs.import_network`` gives them, of a page's blocks; patterns have no minutes.

    ``stops`` names a block of lists id, name, lon, lat; ``routes`` one of lists
    id, name, mode, trips, stops (places in the stops' lists).
    """
    found = legacy_network(page)
    s, r = found[stops], found[routes]
    at = spark.createDataFrame([(str(i), str(n or ""), float(x), float(y)) for i, n, x, y in zip(s["id"], s["name"], s["lon"], s["lat"], strict=True)], "stop_id string, name string, lon double, lat double")
    rows = [(f"{i}#0", str(i), str(n or ""), str(m), float(t), [str(s["id"][k]) for k in seq], None) for i, n, m, t, seq in zip(r["id"], r["name"], r["mode"], r["trips"], r["stops"], strict=True) if len(seq) >= 2]
    kind = "pattern_id string, route_id string, name string, mode string, trips double, stops array<string>, minutes array<double>"
    return {"stops": at, "patterns": spark.createDataFrame(rows, kind)}


def config(path: str) -> dict:
    """Values of a JSON file by name, over those of ``stopgrid.params``: a name that is none of them is an error."""
    from stopgrid import params

    own = {k: v for k, v in vars(params).items() if k.isupper()}
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := sorted(set(given) - set(own)):
        raise ValueError(f"no such values: {unknown}")
    return own | {k: tuple(v) if isinstance(own[k], tuple) else v for k, v in given.items()}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file of JSON, a document on one line or on many."""
    return spark.read.json(path, multiLine=True)


def converted_shapes(spark: SparkSession, path: str, projection: str = "xy") -> DataFrame:
    """(link, a, b, m, xs, ys): road links of a shapefile converted to lines of JSON (link, f, t, xy), xy a list of corners in metres; their lengths are measured."""
    raw = spark.read.schema(f"link bigint, f bigint, t bigint, {projection} array<array<double>>").json(path)
    p = F.col(projection)
    step = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: F.sqrt(F.pow(F.get(F.get(p, i), F.lit(0)) - F.get(F.get(p, i + 1), F.lit(0)), 2) + F.pow(F.get(F.get(p, i), F.lit(1)) - F.get(F.get(p, i + 1), F.lit(1)), 2)))
    m = F.aggregate(step, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return raw.where(F.size(p) >= 2).select("link", F.col("f").alias("a"), F.col("t").alias("b"), m.alias("m"), F.transform(p, lambda c: c[0]).alias("xs"), F.transform(p, lambda c: c[1]).alias("ys"))
