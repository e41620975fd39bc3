import gzip
import base64
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stopgrid.functions import text
from stopgrid.operators import matching, roads, spatial
from stopgrid.plans import carbon
from stopgrid.sources import gtfs, sinks, tables

#: A branch: five stops, one route with a long and a short working, run on weekends or daily.
FILES = {
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{s},{n},35.9,{126.5 + i / 100}\n" for i, (s, n) in enumerate([("k1", "Quay"), ("k2", ""), ("k3", "Mill"), ("k4", "Ford"), ("k5", "End")])),
    "routes": "route_id,route_short_name,route_type\nB9,9,3\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nWE,0,0,0,0,0,1,1\n",
    "trips": "route_id,service_id,trip_id\nB9,WE,long1\nB9,WE,long2\nB9,WE,short\nB9,XX,other\nZZ,WE,lost\n",
}
STOPS = {"long1": ("k1", "k2", "k3", "k5"), "long2": ("k1", "k2", "k3", "k5"), "short": ("k3", "k2"), "other": ("k1", "nowhere", "k4"), "lost": ("k4", "k5"), "unknown": ("k1", "k2")}
TIMES = {"long1": ("23:50:00", "", "24:04:00", "24:20:00"), "long2": ("5:00:00", "5:08:00", "5:10:00", "5:20:00"), "short": ("x", "y"), "other": ("1:00:00", "1:05:00", "1:30:00"), "lost": ("1:00:00", "1:10:00"), "unknown": ("1:00:00", "1:10:00")}


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("calendar", [True, False])
def test_feed(spark, tmp_path, zipped, calendar):
    rows = [f"{t},,{x},{s},{i * 3}\n" for t in STOPS for i, (s, x) in enumerate(zip(STOPS[t], TIMES[t], strict=True))]
    files = dict(FILES, stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(sorted(rows, key=lambda r: r[::-1])))
    if not calendar:
        del files["calendar"]
    for k, v in files.items():
        (tmp_path / f"{k}.txt").write_text(v, encoding="utf-8")
    path = str(tmp_path)
    if zipped:
        path = str(tmp_path / "feed.zip")
        with zipfile.ZipFile(path, "w") as z:
            for k in files:
                z.write(tmp_path / f"{k}.txt", f"a/b/{k}.txt")
    feed = gtfs.open_feed(spark, path)
    net = gtfs.import_network(feed)
    p = {tuple(r.stops): r for r in net["patterns"].collect()}
    assert set(p) == {STOPS["long1"], STOPS["short"], ("k1", "k4"), STOPS["lost"]}
    long = p[STOPS["long1"]]
    assert long.minutes == [0, 4, 12, 25] and long.mode == "0" and long["name"] == "9"  # means; a missing time counts as none
    assert long.trips == pytest.approx(2 * (2 / 7 if calendar else 1), abs=0.01) and p["k1", "k4"].trips == 1.0
    assert p[STOPS["short"]].minutes is None and p[STOPS["lost"]]["name"] == ""
    assert {r.pattern_id for r in p.values()} == {"B9#0", "B9#1", "B9#2", "ZZ#0"}
    assert {r.stop_id: r.name for r in net["stops"].collect()}["k2"] == "" and gtfs.split_trips(feed).first().split > 0


def test_direction_free_names(spark):
    pairs = [("Ford ↔ Mill", "Mill -> Ford"), ("a~b>c", "c - b - a"), ("17", " 1 7"), ("NaN", None), ("none", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] == r[1] for r in df.select(text.direction_free_key(F.col("a")), text.direction_free_key(F.col("b"))).collect())


def test_encoding_is_judged_by_the_whole_file(spark, tmp_path):
    rows = [f"{i},plain" for i in range(3000)] + ["3000,한글"]
    for name, enc in (("a", "utf-8"), ("b", "cp949"), ("c", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes("\n".join(["id,name", *rows]).encode(enc))
        df = tables.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["id", "name"] and df.where("id = '3000'").first().name == "한글"


def test_population_narrow(spark, tmp_path):
    cols = ["행정구역", "2025년06월_계_총인구수", *[f"2025년06월_계_{a}~{a + 4}세" for a in (55, 60, 65)], "2025년06월_계_70세 이상", "2025년05월_계_총인구수"]
    rows = [["강원특별자치도 강릉시 옥계면(5115035000)", '"3,300"', "9", "8", "7", "6", "1"], ["강원특별자치도 강릉시 (5115000000)", "5", "1", "1", "1", "1", "1"], ["강원특별자치도 (5100000000)", "5", "1", "1", "1", "1", "1"], ["no code", "5", "1", "1", "1", "1", "1"]]
    (tmp_path / "p.csv").write_bytes("\n".join([",".join(cols), *[",".join(r) for r in rows]]).encode("cp949"))
    got = {r.code: r for r in tables.population_narrow(tables.read_csv(spark, str(tmp_path / "p.csv"))).collect()}
    assert got["5115035000"].total == 3300 and got["5115035000"].senior == 13
    assert {k: r.level for k, r in got.items()} == {"5115035000": "dong", "5115000000": "sigungu", "5100000000": "sido"}


def test_population_wide(spark, tmp_path):
    cols = ["시도명", "시군구명", "읍면동명", "행정기관코드", *[f"{a}세{s}" for a in range(90) for s in ("남자", "여자")]]
    (tmp_path / "w.csv").write_text("\n".join([",".join(cols), ",".join(["도", "시", "면", "4711025000", *["3"] * 180]), ",".join(["x", "y", "z", "bad", *["1"] * 180])]))
    (r,) = tables.population_wide(tables.read_csv(spark, str(tmp_path / "w.csv"))).collect()
    assert (r.total, r.senior) == (540, 150)


def test_facilities_points_and_seniors(spark):
    df = spark.createDataFrame([("가", "의원", "126.0", "35.0"), ("나", "한의원", "126.0", "35.0"), ("다", "종합병원", "200", "35")], ["요양기관명", "종별코드명", "좌표(X)", "좌표(Y)"])
    assert [r.name for r in tables.facilities(df).collect()] == ["가"]
    p = tables.facilities(df, kind="약국")
    both = tables.facilities(df).unionByName(p)
    assert tuple(tables.facility_stats(both).first()) == (3, 1, 2)
    assert tables.points(spark.createDataFrame([("1", "2"), ("x", "2")], "lon string, lat string")).count() == 1
    with pytest.raises(ValueError):
        tables.facilities(df.drop("좌표(X)"))
    s = spark.createDataFrame([("11110", "", "", "20"), ("", "강원", "태백 시", "30.5")], "sigungu_code string, sido string, sigungu string, senior_pct string")
    r = spark.createDataFrame([(0, "11110", "서울", "종로구"), (1, "99999", "강원", "태백시"), (2, "99998", "강원", "없음")], "region int, code string, sido string, name string")
    assert {x.region: x.senior for x in tables.senior_optional(s, r).collect()} == {0: 20.0, 1: 30.5, 2: -1.0}


def test_regions_are_matched_in_four_tiers(spark):
    areas = [(0, "c0", "가나도 갑시 물동"), (1, "x1", "가나도 갑시 불동"), (2, "x2", "가나도 을시 산동"), (3, "x3", "가나도 갑시 강남동"), (4, "x4", "가나도 갑시 강남.1동"), (5, "x5", "다라도 병시 들동"), (6, "x6", "다라도 정시 들동")]
    people = [("c0", "가나도 딴시 딴동", 10.0, 1.0), ("p1", "가나도 갑시 불동", 20.0, 2.0), ("p2", "가나도 새시 산동", 30.0, 3.0), ("p3", "가나도 갑시 강남1동", 40.0, 4.0), ("p4", "가나도 갑시 강남2동", 50.0, 5.0), ("p5", "다라도 무시 들동", 60.0, 6.0)]
    a, p = spark.createDataFrame(areas, "ix int, code string, name string"), spark.createDataFrame(people, "code string, name string, total double, senior double")
    got = {r.ix: (r.tier, r.people, r.senior, r.rows) for r in matching.match_regions(a, p).collect()}
    assert got[0] == ("code", 10.0, 1.0, 1) and got[1] == ("name", 20.0, 2.0, 1) and got[2] == ("sido", 30.0, 3.0, 1)
    assert got[3] == ("split", 90.0, 9.0, 2) and got[4] == ("none", None, None, 0)  # the first area takes what was divided
    assert got[5][0] == got[6][0] == "none"  # its name stands twice, and it has one letter only

def _joined(p):
    """The most rows that a join of a plan has made."""
    own = p.metrics().get("numOutputRows") if "Join" in p.nodeName() else None
    below = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
    return max([own.get().value() if own is not None and own.isDefined() else 0, *[_joined(x) for x in below]])


def test_divided_quarters_without_pairs(spark):
    """Areas of one name meet a row once, not each."""
    a = spark.range(2000).select(F.col("id").alias("ix"), F.concat(F.lit("a"), "id").alias("code"), F.lit("경기도 구1 동네동").alias("name"))
    p = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("code"), F.format_string("경기도 구2 동네%d동", "id").alias("name"), F.lit(1.0).alias("total"), F.lit(0.0).alias("senior"))
    got = matching.match_regions(a, p)
    rows = {r.ix: (r.tier, r.rows) for r in got.collect()}
    assert rows[0] == ("split", 2000) and all(rows[i] == ("none", 0) for i in range(1, 2000))
    assert _joined(got._jdf.queryExecution().executedPlan()) < 100_000


def test_carbon_inputs(spark):
    sheet = spark.createDataFrame([("전국", "0.5", "1,000", "2000"), ("서울특별시", "", "300", "900"), ("경기도", "", "500", "800"), ("전남광주통합특별시", "", "", "")], "a string, b string, c string, d string")
    fuel = spark.createDataFrame([("현대", "휘발유", "승용차", "내연기관", "120"), ("기아", "휘발유", "승용차", "내연기관", "100"), ("Other", "휘발유", "승용차", "내연기관", "200"), ("현대", "경유", "승용차", "내연기관", "999"), ("현대", "휘발유", "화물차", "내연기관", "999")], "`업체명` string, `연료` string, `자동차 종류` string, `차량형식` string, `CO2배출량(g/km)` string")
    usage = spark.createDataFrame([("전체", "20", "20", "20", "20", "20"), ("서울", "0", "0", "0", "0", "100"), ("note", "x", "", "", "", "")], "`구분` string, s string, t string, u string, v string, w string")
    cars, models, use = tables.carbon_tables(sheet, fuel, usage)
    c = {r.sido: r.cars for r in carbon.cars_per_person(cars).collect()}
    assert c == pytest.approx({"서울": 300 / 900, "경기": 500 / 800, "전남광주": 200 / 300, "": 0.5})
    kg = carbon.emissions(models)
    assert tuple(kg.first()) == (pytest.approx(0.11), pytest.approx(0.14), 2, 3)
    rel = carbon.relative_usage(use, ["s0", "s1", "s2", "s3", "s4"])
    assert {r.name: r.relative for r in rel.collect()} == {"서울": pytest.approx(23 / 13.3)}
    lines = spark.createDataFrame([(1, "서울"), (2, "부산"), (3, "제주")], "line bigint, sido string")
    x = {r.line: r for r in carbon.line_inputs(lines, carbon.cars_per_person(cars), kg, rel).collect()}
    assert x[1].transit == pytest.approx(0.788 / 0.414 * 0.393 * 23 / 13.3) and x[2].transit == pytest.approx(0.788 / 0.414 * 0.181) and x[3].cars == 0.5


def test_areas_and_the_nearest_of_those_outside(spark, tmp_path):
    square = lambda x: [[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]]
    feat = lambda name, kind, c: {"type": "Feature", "properties": {"name": name}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feat("창원시성산구", "Polygon", [square(0)]), feat("b", "MultiPolygon", [[square(6)], [square(20)]])]}))
    areas = tables.geojson(spark, str(tmp_path / "g.json"))
    assert {r.name for r in areas.collect()} == {"창원시 성산구", "b"}
    pts = spark.createDataFrame([(1, 1.0, 0.5), (2, 7.0, 1.0), (3, 3.5, 1.0), (4, 21.0, 1.0), (5, 60.0, 60.0), (1, 1.0, 0.5)], "id int, lon double, lat double")
    assert sorted((r.id, r.area) for r in spatial.locate(pts, areas).collect() if r.area is not None) == [(1, 0), (1, 0), (2, 1), (4, 1)]
    got = sorted((r.id, r.area) for r in spatial.locate(pts, areas, nearest=True).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1)]


def test_nearest_other_of_crowds_and_hermits(spark):
    import math
    import random

    r = random.Random(4)
    pts = [(i, 127 + r.random() * 0.01, 36 + r.random() * 0.01) for i in range(120)] + [(200, 127.9, 36.0), (201, 130.5, 38.0), (202, 130.5, 38.0)]
    flat = {i: (x * 111_320 * math.cos(math.radians(36.2)), y * 111_320) for i, x, y in pts}
    want = {i: min(math.dist(flat[i], flat[j]) for j in flat if j != i) for i in flat}
    got = {x.g: x.dist for x in spatial.nearest_other(spark.createDataFrame(pts, "g bigint, lon double, lat double"), start=50.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
    assert spatial.nearest_other(spark.createDataFrame(pts[:1], "g bigint, lon double, lat double")).count() == 0


def test_links_cut_at_stops(spark):
    links = spark.createDataFrame([(1, 10, 11, 100.0), (2, 11, 12, 50.0)], "link bigint, a bigint, b bigint, m double")
    snapped = spark.createDataFrame([(0, 1, 0.25, 3.0), (1, 1, 0.75, 0.0), (2, 2, 1.0, 1.0)], "id bigint, link bigint, at double, dist double")
    cut = roads.split_links(links, snapped)
    assert sorted((r.a, r.b, r.m) for r in cut.collect() if r.m > 0) == [(-2, 11, 25.0), (-1, -2, 50.0), (10, -1, 25.0), (11, -3, 50.0)]
    pairs = spark.createDataFrame([(-1, -2, 40.0), (-1, -3, 120.0), (-1, 99, 5.0), (10, 12, 1.0)], "f bigint, t bigint, straight double")
    places = spark.createDataFrame([(-1, 25.0, 0.0), (-2, 75.0, 0.0), (11, 100.0, 0.0), (-3, 150.0, 0.0), (99, 0.0, 5.0), (10, 0.0, 0.0), (12, 150.0, 0.0)], "node bigint, x double, y double")
    got = {(r.f, r.t): r for r in roads.road_paths(cut.where("m > 0"), pairs, places).collect()}
    assert got[-1, -2].m == 50.0 and got[-1, -2].xs == [25.0, 75.0] and got[-1, -3].xs == [25.0, 75.0, 100.0, 150.0]
    assert got[-1, 99].status == 0 and got[-1, 99].xs == [25.0, 0.0] and {r.status: r.n for r in roads.status_summary(spark.createDataFrame(list(got.values()))).collect()}[1] >= 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, "한")], "id bigint, name string")
    sinks.write_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    (part,) = (tmp_path / "csv").glob("*.csv")
    raw = part.read_bytes().decode("utf-8")
    assert raw.startswith('﻿"id","name"\r\n') or raw.startswith('"﻿id","name"\r\n')
    assert raw.count("\r\n") == 3
    page = "x\n<!-- t:start -->\nold\n<!-- t:end -->\ny"
    assert sinks.report_block(page, "t", sinks.markdown(df)) == 'x\n<!-- t:start -->\n| id | name |\n| --- | --- |\n| 1 | a "b" |\n| 2 | 한 |\n<!-- t:end -->\ny'
    with pytest.raises(ValueError):
        sinks.report_block(page, "u", "")
    assert sinks.fingerprint(df) == sinks.fingerprint(df.orderBy(F.desc("id"))) != sinks.fingerprint(df, 1)


def test_packed_columns_come_back(spark, tmp_path):
    rows = [(i, i / 7, [i, i + 1][: i % 3]) for i in range(50)]
    at = f"file://{tmp_path}/pack"
    sinks.pack(spark.createDataFrame(rows, "id bigint, x double, l array<bigint>").repartition(3), at, {"x": (100.0, 1000)}, "id")
    got = sorted(map(tuple, sinks.unpack(spark, at, "id bigint, x double, l array<bigint>").collect()))
    assert [g[0] for g in got] == list(range(50)) and all(abs(g[1] - r[1]) <= 0.005 and list(g[2]) == r[2] for g, r in zip(got, rows, strict=True))


def test_chunks_go_on(spark, tmp_path):
    made = []

    def make(df):
        made.append(1)
        return df

    work = spark.range(100)
    at = f"file://{tmp_path}/chunks"
    assert sinks.in_chunks(work, make, at, "id", 4).select("id").distinct().count() == 100 and len(made) == 4
    assert sinks.in_chunks(work, make, at, "id", 4).count() == 100 and len(made) == 4


def test_old_pages_and_config(spark, tmp_path):
    stops = {"id": ["a", "b", "c"], "name": ["A", None, "C"], "lon": [1, 2, 3], "lat": [4, 5, 6]}
    routes = {"id": [7, 8], "name": ["r", "s"], "mode": [0, 1], "trips": [3.5, 1], "stops": [[0, 2], [1]]}
    page = f'<script id="S">{json.dumps(stops)}</script><script type="x" id="R">{base64.b64encode(gzip.compress(json.dumps(routes).encode())).decode()}</script>'
    net = tables.network_tables(spark, page, "S", "R")
    assert [tuple(r) for r in net["patterns"].collect()] == [("7#0", "7", "r", "0", 3.5, ["a", "c"], None)] and net["stops"].count() == 3
    (tmp_path / "p.json").write_text('{"WALK_M": 500.0, "BUDGETS": [1, 2]}')
    c = tables.config(str(tmp_path / "p.json"))
    assert c["WALK_M"] == 500.0 and c["BUDGETS"] == (1, 2) and c["WAIT_CAP"] == 30.0
    (tmp_path / "q.json").write_text('{"WALK": 1}')
    with pytest.raises(ValueError):
        tables.config(str(tmp_path / "q.json"))
