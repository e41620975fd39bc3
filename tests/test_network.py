"""A feed of our own, from its files to scores and portfolios."""

import pytest
from pyspark.sql import functions as F

from stopgrid.operators.ranks import greedy_budget
from stopgrid.plans import network as N
from stopgrid.plans import policies as Q
from stopgrid.plans import scores as K
from stopgrid.plans import simulation as M
from stopgrid.sources import gtfs

STEP = 0.006


def feed(tmp_path):
    """Two towns joined by a bus in variants, a village line, a tram, and a ferry to an island with a bus of its own."""
    stops = {f"T{i}": (127.0 + STEP * i, 36.0, f"Town {i}") for i in range(6)}
    stops |= {f"T{i}o": (127.0 + STEP * i, 36.0004, f"town-{i}") for i in range(6)}  # across the road
    stops |= {f"V{i}": (127.0 + STEP * 5, 36.0 - 0.02 * (i + 1), f"Village {i}") for i in range(3)}
    stops |= {"P": (127.0 - STEP, 36.0, "Port"), "I0": (126.9, 36.0, "Island 0"), "I1": (126.9, 36.01, "Island 1"), "X": (127.0 + STEP * 2, 36.0012, "")}
    routes = [("bus", "7 East-West", 3), ("bus2", "7 West-East", 3), ("village", "V", 3), ("tram", "M1", 0), ("ferry", "F", 4), ("island", "I", 3)]
    trips, times = [], []

    def run(route, ids, n, at=7, minutes=3, service="D"):
        for k in range(n):
            t = f"{route}-{len(trips)}"
            trips.append((route, service, t))
            for i, s in enumerate(ids):
                m = at * 60 + k * 5 + i * minutes
                times.append((t, f"{m // 60}:{m % 60:02d}:00", s, i))

    town = [f"T{i}" for i in range(6)]
    run("bus", ["P", *town], 30)
    run("bus", town[:4], 10)  # a short working
    run("bus2", [f"T{i}o" for i in range(5, -1, -1)] + ["P"], 30)
    run("village", ["T5", "V0", "V1", "V2"], 6)
    run("village", ["V2", "V1", "V0", "T5o"], 6)
    run("tram", town[:4], 60, minutes=2)
    run("tram", town[3::-1], 60, minutes=2)
    run("ferry", ["P", "I0"], 3, minutes=40)
    run("ferry", ["I0", "P"], 3, minutes=40)
    run("island", ["I0", "I1"], 8)
    run("island", ["I1", "I0"], 8, at=26, service="W")
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{k},{n},{y},{x}\n" for k, (x, y, n) in stops.items()),
        "routes": "route_id,route_short_name,route_type\n" + "".join(f"{a},{b},{c}\n" for a, b, c in routes),
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nD,1,1,1,1,1,1,1\nW,1,1,1,1,1,0,0\n",
        "trips": "route_id,service_id,trip_id\n" + "".join(f"{a},{b},{c}\n" for a, b, c in trips),
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"{t},{x},{x},{s},{i}\n" for t, x, s, i in times),
    }
    for k, v in files.items():
        (tmp_path / f"{k}.txt").write_text(v, encoding="utf-8")
    return str(tmp_path)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    net = gtfs.import_network(gtfs.open_feed(spark, feed(tmp_path_factory.mktemp("feed"))))
    grid = spark.createDataFrame([(127.0 + STEP * i, 36.0, 100.0 * (i + 1)) for i in range(6)] + [(126.9, 36.0, 800.0), (127.03, 35.95, 60.0), (126.5, 36.0, 40.0)], "lon double, lat double, value double")
    hospitals = spark.createDataFrame([(127.0 + STEP * 3, 36.001)], "lon double, lat double")
    regions = spark.createDataFrame([(0, [(126.95, 35.99), (127.1, 35.99), (127.1, 36.1), (126.95, 36.1)]), (1, [(126.85, 35.9), (126.95, 35.9), (126.95, 36.1), (126.85, 36.1)])], "area bigint, ring array<struct<x:double,y:double>>")
    return N.build(net["stops"], net["patterns"], regions, hospitals, grid)


def test_groups_and_lines(built):
    group = {r.stop_id: r.g for r in built.stop_group.collect()}
    assert all(group[f"T{i}"] == group[f"T{i}o"] for i in range(6)) and len(set(group.values())) == 13
    names = {r.line: r for r in built.lines.collect()}
    assert sorted((r["name"], r["mode"], r.n_patterns) for r in names.values()) == [("7 East-West", 0, 3), ("F", 2, 2), ("I", 0, 2), ("M1", 1, 2), ("V", 0, 2)]
    by = {r["name"]: r for r in names.values()}
    assert by["7 East-West"].trips == 70 and by["7 East-West"].n_groups == 7 and by["I"].trips == pytest.approx(8 + 8 * 5 / 7, abs=0.01)
    assert by["I"].region == 1 and by["M1"].region == 0 and by["F"].spans == 2


def test_waits_follow_the_lines_frequency(built):
    pats = {r.pattern_id: r for r in built.patterns.collect()}
    short = next(r for r in pats.values() if r.route_id == "bus" and r.trips == 10)
    assert short.eff_trips == 40  # the short working's edges are ridden by the long one's trips as well
    assert short.wait == pytest.approx(17 * 60 / 40 / 2, abs=0.01)
    ferry = next(r for r in pats.values() if r.route_id == "ferry")
    assert ferry.wait == 30.0 and {r.time_source for r in pats.values()} == {"timetable"}


def test_people_destinations_and_status(spark, built):
    g = {r.g: r for r in built.net.groups.collect()}
    of = {r.stop_id: g[r.g] for r in built.stop_group.collect()}
    assert of["T0"].pop == 100.0 and of["I0"].pop == 800.0 and of["V2"].pop == 0.0
    assert of["T3"].dest == 2.0 and of["T3"].hosp_near == 1 and of["T5"].dest == 0.0 and of["P"].dest == of["I0"].dest == 1.0
    assert of["X"].n_lines == 0
    assert sorted(r.people for r in built.unserved.collect()) == [40.0, 60.0]
    s = N.data_status(built).first()
    assert (s.population, s.destinations, s.time, s.lines, s.stops) == ("grid", "stations+facilities", "timetable", 5, 19)


def test_scores_are_sane(spark, built):
    net, by = built.net, {r["name"]: r.line for r in built.lines.collect()}
    removal = M.line_removal(net)
    r = {x.line: x for x in removal.lines.collect()}
    ferry, village, tram, bus = (r[by[k]] for k in ("F", "V", "M1", "7 East-West"))
    assert ferry.disconnected == ferry.n_pairs and village.no_alternative == 0.0 or village.disconnected == village.n_pairs
    assert tram.no_alternative == 0.0 and tram.time_increase < village.time_increase
    lines = K.score_lines(net, removal).cache()
    s = {x.line: x for x in lines.collect()}
    assert s[by["F"]].affected >= 800.0 and s[by["F"]].score > s[by["M1"]].score
    stops = K.score_stops(net, M.stop_closure(net), built.lines).cache()
    assert {x.grade for x in stops.collect()} <= {0, 1, 2, 3} and all(0 <= x.score <= 100 for x in stops.collect())
    regions = {x.region: x for x in K.score_regions(net, stops, lines).collect()}
    assert set(regions) == {0, 1} and regions[1].people == 800.0
    cells = K.score_grid(net, stops, spark.createDataFrame([(0, 0)], "cx bigint, cy bigint"), built.unserved).collect()
    assert next(x for x in cells if (x.cx, x.cy) == (0, 0)).grade == 4 and sum(x.unserved for x in cells) <= 100.0
    # A network's measures hang together.
    assert all(x.access_loss == 0.0 or x.time_increase >= 0.05 or x.no_alternative > 0 or x.disconnected > 0 for x in removal.lines.collect())


def test_policies_and_portfolios(spark, built):
    net = built.net
    before = M.line_removal(net)
    scores = K.score_lines(net, before)
    got = Q.evaluate(net, Q.candidates(scores.select("line")), before)
    cost = Q.costs(got, Q.line_vehicles(net, built.lines))
    carbon = Q.sample_trip_km(net).select("line", F.col("km").alias("trip_km"), F.lit(0.5).alias("transit"), F.lit(0.4).alias("cars"), F.lit(0.15).alias("kg"), F.lit(0.2).alias("kg_all"))
    g = Q.gains(got, cost, scores, carbon).cache()
    rows = g.collect()
    assert len(rows) == 5 * 35 and any(x.benefit > 0 for x in rows)
    assert all(x.cost >= 0.01 and x.benefit >= 0 and x.score_after <= x.score_before + 1e-6 for x in rows if x.feasible)
    assert all(x.cost == 0 and x.benefit == 0 and x.co2_mid == 0 for x in rows if not x.feasible)
    assert all(x.co2_high == pytest.approx(x.co2_mid * 0.2 / 0.15) for x in rows) and any(x.co2_low > 0 for x in rows)
    items = g.withColumnRenamed("scn", "item")
    p = sorted(Q.portfolio(greedy_budget(items, (0.5, 2, 20))).collect(), key=lambda x: x.budget)
    assert all(a.benefit <= b.benefit for a, b in zip(p, p[1:])) and all(x.spent <= x.budget for x in p)
    own = items.where("line % 2 = 0").select("item")
    for x in Q.capture(items, own, own.limit(3), (1, 5)).collect():
        assert 0 <= x.random_share <= x.share <= 1


def test_features(built):
    f = {r.line: r for r in N.line_features(built.net, built.lines).collect()}
    by = {r["name"]: r.line for r in built.lines.collect()}
    assert f[by["F"]].is_ferry == f[by["F"]].is_long == 1.0 and f[by["M1"]].is_metro == 1.0 and f[by["V"]].single_line_share == pytest.approx(0.75)
    assert f[by["M1"]].mean_other_lines == 1.0 and set(N.LINE_FEATURES) < set(f[by["V"]].asDict())
    s = N.stop_features(built.net, built.lines).collect()
    assert len(s) == 12 and all(set(N.STOP_FEATURES) < set(r.asDict()) for r in s)
