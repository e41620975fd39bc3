"""From a timetable feed to a network: stop groups, patterns, lines, waits, walks, destinations and people."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopgrid import params as P
from stopgrid.functions import geo, text, time
from stopgrid.operators import matching as M
from stopgrid.operators import ranks as R
from stopgrid.operators import sequences as S
from stopgrid.operators import spatial as X
from stopgrid.operators.components import connected_components
from stopgrid.plans.simulation import Net
from stopgrid.plans.storage import written


@dataclass
class Built:
    """``net``; ``lines``: (line, name, mode, trips, n_groups, length_km, region, n_patterns); ``patterns``: (pat, line, pattern_id, route_id, trips, eff_trips, wait, time_source); ``stop_group``: (stop_id, g); ``unserved``: (lon, lat, people); ``sources``: what each input was."""

    net: Net
    lines: DataFrame
    patterns: DataFrame
    stop_group: DataFrame
    unserved: DataFrame | None
    sources: dict[str, str]


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with a number from 0 in the order of ``key``."""
    return written(R.numbered_all(df, [], [key], out), out)


def group_links(stops: DataFrame, metres: float = P.GROUP_M) -> DataFrame:
    """(a, b): stops (ix, name, lon, lat) of one name, without marks, at most ``metres`` apart."""
    named = stops.select("ix", "lon", "lat", text.normalize_name(F.col("name")).alias("key")).where("key <> ''")
    return X.within(named, named, metres, extra=("key",)).where("a_ix < b_ix").select(F.col("a_ix").alias("a"), F.col("b_ix").alias("b"))


def stop_groups(stops: DataFrame, metres: float = P.GROUP_M) -> tuple[DataFrame, DataFrame]:
    """(ix, g) and (g, lon, lat, name, stops_in_group): stops joined by ``group_links``; the most frequent name, the first stop's among equals."""
    cc = connected_components(group_links(stops, metres)).select(F.col("node").alias("ix"), F.col("component").alias("g"))
    of = written(stops.join(cc, "ix", "left").withColumn("g", F.coalesce("g", "ix")).select("ix", "g", "lon", "lat", "name"), "grouped")
    mean = of.groupBy("g").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("stops_in_group"))
    names = of.groupBy("g", "name").agg(F.count("*").alias("n"), F.min("ix").alias("first"))
    modal = R.top_per(names, ["g"], [F.desc("n"), "first"], 1).select("g", "name")
    return of.select("ix", "g"), mean.join(modal, "g")


def patterns_on_groups(patterns: DataFrame, stop_group: DataFrame, groups: DataFrame) -> DataFrame:
    """(pat, pos, g, cum, time_source): patterns (pat, mode, stops, minutes) as sequences of groups.

    Of stops of one group in a row the first counts; patterns of fewer than two
    groups are dropped. Minutes are the timetable's, else from distance and mode.
    """
    x = patterns.select("pat", "mode", "minutes", F.posexplode("stops").alias("i", "stop_id")).join(stop_group, "stop_id")
    x = x.withColumn("own", F.when(F.size("minutes") > 0, F.get("minutes", F.col("i")))).withColumn("given", F.col("minutes").isNotNull()).drop("minutes", "stop_id")
    seq = S.collapse(x, "pat", "i").withColumnRenamed("i", "pos").join(groups.select("g", "lon", "lat"), "g")
    w = Window.partitionBy("pat").orderBy("pos")
    m = geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("mode").cast("int") + 1)
    step = F.coalesce(m * of(P.DETOUR) / (of(P.SPEED_KMH) * 1000 / 60) + of(P.DWELL_MIN), F.lit(0.0))
    out = seq.withColumn("step", step).withColumn("cum", F.round(F.when(F.col("given"), F.col("own")).otherwise(F.sum("step").over(w)), 2))
    return out.select("pat", F.col("pos").cast("long").alias("pos"), "g", "cum", F.when(F.col("given"), "timetable").otherwise("estimated").alias("time_source"))


def pattern_links(patterns: DataFrame, seq: DataFrame) -> DataFrame:
    """(a, b): patterns (pat, name, mode, route_id) of one line.

    They are of one mode and name in either direction and share half of the
    shorter one's edges; or of one mode with the same ends and nearly all edges
    in common; or of one route.
    """
    e = S.edges(seq.select("pat", "pos", "g"), "pat")
    named = patterns.select("pat", F.concat_ws("/", "mode", text.direction_free_key(F.col("name"))).alias("block")).where(~F.col("block").endswith("/"))
    same = M.overlaps(S.undirected(e.join(named, "pat"), ["pat", "block"]), "pat", "block", P.SAME_NAME_OVERLAP)
    ends = S.ends(seq, "pat").join(patterns.select("pat", "mode"), "pat")
    ends = ends.select("pat", F.concat_ws("/", "mode", F.least("x", "y").cast("string"), F.greatest("x", "y").cast("string")).alias("block"))
    near = M.overlaps(S.undirected(e.join(ends, "pat"), ["pat", "block"]), "pat", "block", 0.0).where(F.col("jaccard") >= P.ANY_NAME_JACCARD)
    route = patterns.select("pat", "route_id").join(patterns.groupBy("route_id").agg(F.min("pat").alias("first")), "route_id").where("pat <> first")
    pairs = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return pairs(same, "t1", "t2").unionByName(pairs(near, "t1", "t2")).unionByName(pairs(route, "first", "pat"))


def line_of_patterns(patterns: DataFrame, seq: DataFrame) -> DataFrame:
    """(pat, line): the line is the least of its patterns."""
    cc = connected_components(pattern_links(patterns, seq)).select(F.col("node").alias("pat"), F.col("component").alias("line"))
    return patterns.select("pat").join(cc, "pat", "left").select("pat", F.coalesce("line", "pat").alias("line"))


def edge_frequency(seq: DataFrame) -> DataFrame:
    """(line, a, b, freq): of stops of patterns (line, pat, pos, g, trips), the trips along each directed edge, as often as they ride it."""
    return S.edges(seq.select("line", "pat", "pos", "g", "trips"), "pat").groupBy("line", "a", "b").agg(F.sum("trips").alias("freq"))


def waits(seq: DataFrame) -> DataFrame:
    """(pat, eff_trips, wait): a pattern runs as often as the median of its distinct edges is ridden by its line, or itself if that is more."""
    e = S.edges(seq.select("line", "pat", "pos", "g", "trips"), "pat").select("line", "pat", "a", "b", "trips").distinct()
    eff = e.join(edge_frequency(seq), ["line", "a", "b"]).groupBy("pat").agg(F.greatest(F.median("freq"), F.max("trips")).alias("eff_trips"))
    return eff.withColumn("wait", F.round(time.headway_wait(F.col("eff_trips")), 2))


def line_table(patterns: DataFrame, seq: DataFrame, groups: DataFrame) -> DataFrame:
    """(line, name, mode, trips, n_patterns, n_groups, length_km, region, spans).

    The name is the most frequent one, then the first in order; the length that
    of the pattern of most groups; region that of most groups, spans the number of
    those known; an unknown one comes last among equals.
    """
    of = seq.select("line", "pat").distinct().join(patterns.select("pat", "name", "mode", "trips"), "pat")
    sums = of.groupBy("line").agg(F.round(F.sum("trips"), 2).alias("trips"), F.count("*").alias("n_patterns"), F.min_by("mode", "pat").alias("mode"))
    names = of.where("name <> ''").groupBy("line", "name").agg(F.count("*").alias("n"))
    names = R.top_per(names, ["line"], [F.desc("n"), "name"], 1).select("line", "name")
    lg = seq.select("line", "g").distinct()
    n = seq.groupBy("line", "pat").agg(F.count("*").alias("n"))
    main = R.top_per(n, ["line"], [F.desc("n"), "pat"], 1).select("pat")
    # Hops are taken before places are joined, which may give a group twice.
    hops = S.edges(seq.join(main, "pat", "left_semi").select("line", "pat", "pos", "g"), "pat")
    at = lambda g, n: groups.select(F.col("g").alias(g), F.col("lon").alias(f"lon{n}"), F.col("lat").alias(f"lat{n}"))
    m = geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    km = hops.join(at("a", 1), "a").join(at("b", 2), "b").groupBy("line").agg(F.round(F.sum(m) / 1000, 2).alias("length_km"))
    out = sums.join(names, "line", "left").fillna("", ["name"]).join(lg.groupBy("line").agg(F.count("*").alias("n_groups")), "line").join(km, "line", "left").fillna(0.0, ["length_km"])
    if "region" not in groups.columns:
        return out.withColumn("region", F.lit(None).cast("long")).withColumn("spans", F.lit(0).cast("long"))
    there = lg.join(groups.select("g", "region"), "g").groupBy("line", "region").agg(F.count("*").alias("n"))
    best = R.top_per(there, ["line"], [F.desc("n"), F.asc_nulls_last("region")], 1).select("line", "region")
    return out.join(best, "line", "left").join(there.groupBy("line").agg(F.count("region").alias("spans")), "line", "left")


def group_service(seq: DataFrame) -> DataFrame:
    """(g, n_lines, modes): lines at a group, and their modes as bits; ``seq`` has line, g, mode."""
    return seq.groupBy("g").agg(F.count_distinct("line").alias("n_lines"), F.bit_or(F.expr("shiftleft(1L, cast(mode as int))")).alias("modes"))


def destinations(service: DataFrame, groups: DataFrame, facilities: DataFrame | None = None) -> DataFrame:
    """(g, dest, hosp_near): one for a station or terminal, and one for each facility (lon, lat) whose nearest group, within FACILITY_M, it is."""
    station = groups.select("g").join(service.select("g", "modes"), "g", "left").select("g", (F.coalesce("modes", F.lit(0)).bitwiseAND(F.lit(254)) != 0).cast("double").alias("station"))
    if facilities is None:
        return station.select("g", F.col("station").alias("dest"), F.lit(0).cast("long").alias("hosp_near"))
    near = X.nearest(facilities.select("lon", "lat").withColumn("id", F.monotonically_increasing_id()), groups.select("g", "lon", "lat"), "id", P.FACILITY_M)
    n = near.groupBy(F.col("b_g").alias("g")).agg(F.count("*").alias("hosp_near"))
    return station.join(n, "g", "left").fillna(0, ["hosp_near"]).select("g", (F.col("station") + F.col("hosp_near")).alias("dest"), "hosp_near")


def population_by_area(groups: DataFrame, areas: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, pop, senior) and (area, people): an area's people shared by its groups; people of areas without a group.

    ``areas`` are rings (area, ring) of areas (area, code, name) with ``people``
    (code, name, total, senior) as ``match_regions`` joins them; groups outside
    all rings belong to the nearest. ``senior`` is a share, -1 where unknown.
    """
    known = M.match_regions(areas.select(F.col("area").alias("ix"), "code", "name").distinct(), people).withColumnRenamed("ix", "area")
    at = X.locate(groups.select("g", "lon", "lat"), areas.select("area", "ring"), nearest=True)
    n = at.groupBy("area").agg(F.count("*").alias("n"))
    share = known.join(n, "area", "left")
    own = at.join(share, "area", "left").select("g", F.coalesce(F.col("people") / F.col("n"), F.lit(0.0)).alias("pop"), F.when(F.col("people") > 0, F.round(100 * F.col("senior") / F.col("people"), 1)).otherwise(-1.0).alias("senior"))
    return own, share.where("n is null and people > 0").select("area", "people")


def population_by_grid(groups: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, pop) and (lon, lat, people): points (lon, lat, value) go to the nearest group within STRANDED_M; the others are without service."""
    p = points.select("lon", "lat", "value").withColumn("id", F.monotonically_increasing_id())
    p = written(p, "points")
    near = written(X.nearest(p, groups.select("g", "lon", "lat"), "id", P.STRANDED_M).select(F.col("a_id").alias("id"), F.col("b_g").alias("g")), "served")
    pop = p.join(near, "id").groupBy("g").agg(F.sum("value").alias("pop"))
    lost = p.join(near, "id", "left_anti").where("value > 0").select(F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.col("value").alias("people"))
    return groups.select("g").join(pop, "g", "left").fillna(0.0, ["pop"]), lost


def walks_of(groups: DataFrame, metres: float = P.WALK_M) -> DataFrame:
    """(a, b, minutes), both ways, of groups at most ``metres`` apart."""
    xy = groups.select("g", "lon", "lat")
    return X.within(xy, xy, metres).where("a_g <> b_g").select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), F.round(geo.walk_minutes(F.col("dist")), 2).alias("minutes"))


def build(stops: DataFrame, patterns: DataFrame, regions: DataFrame | None = None, facilities: DataFrame | None = None, grid: DataFrame | None = None, areas: DataFrame | None = None, people: DataFrame | None = None) -> Built:
    """A network of stops (stop_id, name, lon, lat) and patterns (pattern_id, route_id, name, mode, trips, stops, minutes), as ``import_network`` gives them.

    Optional: ``regions`` (area, ring), ``facilities`` (lon, lat), and people:
    ``areas`` with ``people``, else ``grid`` (lon, lat, value), else one a group.
    """
    ix = numbered(stops.select("stop_id", "name", "lon", "lat"), "stop_id", "ix")
    of, groups = stop_groups(ix)
    stop_group = written(ix.join(of, "ix").select("stop_id", "g"), "stop_group")
    if regions is not None:
        groups = X.locate(groups, regions, nearest=True).withColumnRenamed("area", "region")
    groups = written(groups, "groups")
    pats = numbered(patterns.withColumn("mode", F.col("mode").cast("int")), "pattern_id", "pat")
    seq = written(patterns_on_groups(pats, stop_group, groups), "sequences")
    live = written(pats.join(seq.select("pat").distinct(), "pat", "left_semi").select("pat", "pattern_id", "route_id", "name", "mode", "trips"), "patterns")
    lines = written(line_of_patterns(live, seq), "line_of_patterns")
    run = written(seq.join(lines, "pat").join(live.select("pat", "mode", "trips"), "pat"), "runs")
    wait = written(waits(run), "waits")
    service = written(group_service(run), "service")
    table = written(line_table(live, run, groups), "lines")
    # A line's mode is that of its first pattern.
    line_mode = table.select("line", F.col("mode").alias("line_mode"))
    net_stops = run.join(wait, "pat").join(line_mode, "line").select("line", "pat", "pos", "g", "cum", "wait", "trips", F.col("line_mode").alias("mode"))
    sources = {"population": "none", "senior": "none", "destinations": "stations" if facilities is None else "stations+facilities", "time": _most(seq, "time_source")}
    unserved = None
    if areas is not None and people is not None:
        pop, lost = population_by_area(groups, areas, people)
        middle = areas.select("area", F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["x"]).alias("sx"), F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["y"]).alias("sy"), F.size("ring").alias("n"))
        middle = middle.groupBy("area").agg(F.round(F.sum("sx") / F.sum("n"), 5).alias("lon"), F.round(F.sum("sy") / F.sum("n"), 5).alias("lat"))
        unserved = lost.join(middle, "area").select("lon", "lat", "people")
        sources |= {"population": "areas", "senior": "areas"}
    elif grid is not None:
        pop, unserved = population_by_grid(groups, grid)
        pop, sources["population"] = pop.withColumn("senior", F.lit(-1.0)), "grid"
    else:
        pop = groups.select("g", F.lit(1.0).alias("pop"), F.lit(-1.0).alias("senior"))
    nearest = X.nearest_other(groups.select("g", "lon", "lat")).select("g", F.round("dist", 1).alias("nearest_other_m"))
    out = groups.join(service, "g", "left").fillna(0, ["n_lines", "modes"]).join(destinations(service, groups, facilities), "g").join(pop, "g").join(nearest, "g", "left")
    out = out.withColumn("pop", F.round("pop", 2))
    net = Net(written(net_stops, "net_stops"), written(walks_of(groups), "walks"), written(out, "net_groups"))
    return Built(net, table, written(live.join(lines, "pat").join(wait, "pat").join(seq.select("pat", "time_source").distinct(), "pat"), "pattern_table"), stop_group, unserved, sources)


def _most(df: DataFrame, col: str) -> str:
    r = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).first()
    return r[0] if r else "none"


def data_status(built: Built) -> DataFrame:
    """One row: what each input was, and the sizes of the network."""
    sizes = built.net.groups.agg(F.count("*").alias("groups"), F.sum("stops_in_group").alias("stops"))
    n = built.lines.agg(F.count("*").alias("lines"), F.sum("n_patterns").alias("patterns"))
    out = sizes.crossJoin(F.broadcast(n))  # one row each
    for k, v in built.sources.items():
        out = out.withColumn(k, F.lit(v))
    return out


# ---------------------------------------------------------------- features


def line_features(net: Net, lines: DataFrame) -> DataFrame:
    """(line, ten features) of lines (line, mode, trips, n_groups, length_km)."""
    g = net.groups.select("g", F.col("nearest_other_m").alias("m"))
    degree = net.walks.groupBy(F.col("a").alias("g")).agg(F.count("*").alias("walks"))
    service = net.served().groupBy("g").agg((F.count("*") - 1).alias("others"))
    at = net.served().join(g, "g").join(degree, "g", "left").join(service, "g").fillna(0, ["walks"])
    means = at.groupBy("line").agg(
        F.avg(F.log1p(F.coalesce("m", F.lit(0.0)))).alias("mean_nearest"), F.avg("others").alias("mean_other_lines"), F.avg((F.col("others") == 0).cast("double")).alias("single_line_share"), F.avg("walks").alias("mean_walks"),
    )
    flag = lambda c: c.cast("double")
    return lines.join(means, "line").select(
        "line", F.log1p("trips").alias("log_trips"), F.col("n_groups").cast("double").alias("n_groups"), "length_km", "mean_nearest", "mean_other_lines", "single_line_share", "mean_walks",
        flag(F.col("mode") == P.FERRY).alias("is_ferry"), flag(F.col("mode").isin(*P.LONG_DISTANCE)).alias("is_long"), flag(F.col("mode") == 1).alias("is_metro"),
    )


LINE_FEATURES = ["log_trips", "n_groups", "length_km", "mean_nearest", "mean_other_lines", "single_line_share", "mean_walks", "is_ferry", "is_long", "is_metro"]
STOP_FEATURES = ["log_nearest", "walks", "n_lines", "log_trips", "n_modes", "is_hub", "stops_in_group"]


def stop_features(net: Net, lines: DataFrame) -> DataFrame:
    """(g, seven features) of groups with service; ``lines`` has line and trips."""
    degree = net.walks.groupBy(F.col("a").alias("g")).agg(F.count("*").alias("walks"))
    service = group_service(net.stops)
    trips = net.served().join(lines.select("line", "trips"), "line").groupBy("g").agg(F.sum("trips").alias("trips"))
    own = [c for c in ("nearest_other_m", "dest", "stops_in_group") if c in net.groups.columns]
    g = net.groups.select("g", *own)
    x = service.join(trips, "g").join(g, "g").join(degree, "g", "left").fillna(0, ["walks"])
    return x.select(
        "g", F.log1p(F.coalesce("nearest_other_m", F.lit(0.0))).alias("log_nearest"), F.col("walks").cast("double").alias("walks"), F.col("n_lines").cast("double").alias("n_lines"), F.log1p("trips").alias("log_trips"),
        F.bit_count("modes").cast("double").alias("n_modes"), (F.col("dest") > 0).cast("double").alias("is_hub"), F.col("stops_in_group").cast("double").alias("stops_in_group"),
    )
