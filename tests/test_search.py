"""Searches within tasks and by rounds against Dijkstra, on random networks with every option."""

import heapq
import random

import pytest

from stopgrid.plans import routing as R
from stopgrid.plans import search

LONG = 3


def random_net(seed, groups=18):
    r = random.Random(seed)
    pats = []
    for p in range(12):
        line = p % 6
        cum, stops = 0.0, []
        for g in r.choices(range(groups), k=r.randint(2, 8)):
            stops.append((g, cum))
            cum += r.randint(1, 5)
        pats.append((line, LONG if line == 5 else 0, float(r.randint(1, 9)), stops))
    walks = {}
    for _ in range(9):
        a, b = r.sample(range(groups), 2)
        walks[a, b] = walks[b, a] = float(r.randint(1, 9))
    return pats, walks


def frames(spark, pats, walks):
    rows = [(line, p, i, g, cum, wait, mode) for p, (line, mode, wait, stops) in enumerate(pats) for i, (g, cum) in enumerate(stops)]
    stops = spark.createDataFrame(rows, "line bigint, pat bigint, pos bigint, g bigint, cum double, wait double, mode int")
    return stops, spark.createDataFrame([(a, b, m) for (a, b), m in walks.items()], "a bigint, b bigint, minutes double")


def dijkstra(pats, walks, starts, limit, disabled=(), closed=(), blocked=(), scale=None, links=(), allowed=None, scope=0):
    far = {g for _, mode, _, s in pats if mode == LONG for g, _ in s}
    ok = lambda g: g not in closed and (allowed is None or g in allowed) and (scope != 2 or g in far)
    edges = {}
    for line, mode, wait, s in pats:
        if line in disabled or (scope == 1 and mode == LONG):
            continue
        for i, (a, c) in enumerate(s):
            for j in range(i + 1, len(s)):
                if {s[j - 1][0], s[j][0]} in [set(x) for x in blocked]:
                    break
                edges.setdefault(a, []).append((s[j][0], wait * (scale or {}).get(line, 1.0) + s[j][1] - c))
    for (a, b), m in walks.items():
        edges.setdefault(a, []).append((b, m))
    for a, b, m in links:
        edges.setdefault(a, []).append((b, m))
    best, heap = {}, [(t, g) for g, t in starts if ok(g)]
    heapq.heapify(heap)
    while heap:
        t, g = heapq.heappop(heap)
        if g in best or t > limit + 1e-9:
            continue
        best[g] = t
        for h, m in edges.get(g, ()):
            if ok(h):
                heapq.heappush(heap, (t + m, h))
    return best


OPTIONS = {
    0: {}, 1: {"disabled": (2, 3)}, 2: {"closed": (3, 4)}, 3: {"scale": {1: 0.5, 4: 0.25}}, 4: {"links": ((0, 40, 1.0), (40, 7, 1.5), (2, 9, 0.5))}, 5: {"allowed": tuple(range(12))},
    6: {"scope": 1}, 7: {"scope": 2}, 8: {"disabled": (0,), "closed": (1,), "scope": 1, "scale": {2: 0.5}, "links": ((0, 17, 2.0),)},
}


def scenarios(spark, pats, origins, limits):
    opts = dict(OPTIONS)
    a, b = pats[0][3][0][0], pats[0][3][1][0]
    opts[9] = {"blocked": ((b, a), (pats[1][3][0][0], pats[1][3][1][0]))}
    f = spark.createDataFrame
    pick = lambda k: [(s, x) for s, v in opts.items() for x in v.get(k, ())]
    rows = [(s, o, g, t, lim) for s in opts for o, starts in origins.items() for g, t in starts for lim in [limits[o]]]
    s = R.Scenarios(
        f(rows, "scn bigint, origin bigint, g bigint, t0 double, lim double"), f(pick("disabled"), "scn bigint, line bigint"), f(pick("closed"), "scn bigint, g bigint"),
        f([(s, *x) for s, v in opts.items() for x in v.get("blocked", ())], "scn bigint, a bigint, b bigint"),
        f([(s, k, x) for s, v in opts.items() for k, x in v.get("scale", {}).items()], "scn bigint, line bigint, scale double"),
        f([(s, *x) for s, v in opts.items() for x in v.get("links", ())], "scn bigint, f bigint, t bigint, minutes double"),
        f([(s, g) for s, v in opts.items() for g in v.get("allowed", range(50))], "scn bigint, g bigint"),
        f([(s, v["scope"]) for s, v in opts.items() if "scope" in v], "scn bigint, scope int"),
    )
    return opts, s


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("how", ["tasks", "parts", "rounds"])
def test_times_equal_dijkstra(spark, monkeypatch, seed, how):
    if how == "rounds" and seed > 1:
        pytest.skip("slow")
    pats, walks = random_net(seed)
    stops, w = frames(spark, pats, walks)
    origins = {0: [(0, 0.0)], 7: [(7, 1.0), (2, 0.5)], 30: [(30, 0.0)], 5: [(5, 0.0)]}
    limits = {0: 25.0, 7: 14.0, 30: 9.0, 5: 40.0}
    opts, s = scenarios(spark, pats, origins, limits)
    monkeypatch.setattr(search, "LABELS", 4_000_000 if how == "tasks" else 40)
    monkeypatch.setattr(search, "NETWORK_ROWS", 0 if how == "rounds" else 10_000)
    got = {(x.scn, x.origin, x.g): round(x.t, 6) for x in R.shortest_times(stops, w, s).collect()}
    want = {(k, o, g): round(t, 6) for k, v in opts.items() for o, st in origins.items() for g, t in dijkstra(pats, walks, st, limits[o], **v).items()}
    assert got == want


@pytest.mark.parametrize("rows", [10_000, 0])
def test_targets_and_reach(spark, monkeypatch, rows):
    monkeypatch.setattr(search, "NETWORK_ROWS", rows)
    pats, walks = random_net(9)
    stops, w = frames(spark, pats, walks)
    o = spark.createDataFrame([(s, g, g, 0.0, 30.0) for s in (0, 1) for g in range(6)], "scn bigint, origin bigint, g bigint, t0 double, lim double")
    t = spark.createDataFrame([(s, g, h, float(4 + (g * h) % 23)) for s in (0, 1) for g in range(6) for h in range(18)], "scn bigint, origin bigint, g bigint, lim double")
    off = spark.createDataFrame([(1, 1)], "scn bigint, line bigint")
    router = R.Router.of(stops, w)
    got = {(x.scn, x.origin, x.g): round(x.t, 6) for x in router.times(R.Scenarios(o, disabled=off, targets=t)).collect()}
    best = {(s, g): dijkstra(pats, walks, [(g, 0.0)], 30.0, disabled=(1,) if s else ()) for s in (0, 1) for g in range(6)}
    assert got == {(s, g, h): round(m, 6) for (s, g), v in best.items() for h, m in v.items() if m <= 4 + (g * h) % 23 + 1e-9}
    weights = spark.createDataFrame([(h, float(h % 4)) for h in range(18)], "g bigint, dest double")
    sums = {(x.scn, x.origin): x.reached for x in router.reached(R.Scenarios(o, disabled=off), weights).collect()}
    assert sums == {k: float(sum(h % 4 for h in v)) for k, v in best.items()}
