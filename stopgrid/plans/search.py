"""Shortest times of many scenarios by searches within tasks, over a network that every worker holds.

Scenarios don't meet, so no label needs a shuffle: the scenarios are dealt over
the tasks, and each task relaxes its own to a fixed point with array operations.
A unit of work is up to BLOCK origins of one scenario, so a scenario with very
many origins is many units.

The network is broadcast only if its tables have at most NETWORK_ROWS rows
(counted first; a row is about forty bytes). Beyond that ``routing`` relaxes by
rounds of joins, with the same results.

A round takes the labels that the last one improved. Each boards every pattern
at its group; of the boardings of one origin on one stretch of a pattern only
those count that leave earlier than any before them, and each is ridden up to
the next such boarding; labels are walked on and carried along scenario links.
What is later than the limit is dropped at once, and, where only certain groups
are asked for, what is later than all of these need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopgrid.params import LONG_DISTANCE

EPS = 1e-9
#: Rows of stops and walks up to which a network is broadcast.
NETWORK_ROWS = 8_000_000
#: Origins of a unit of work, and labels (origins by groups) that a task holds at once.
BLOCK, LABELS = 64, 4_000_000
#: Scopes of a scenario: all lines; none for long distances; groups with such lines only.
FULL, LOCAL, LONG = 0, 1, 2


def fits(stops: DataFrame, walks: DataFrame | None) -> bool:
    """Whether the network is small enough to be broadcast."""
    n = stops.limit(NETWORK_ROWS + 1).count()
    return n + (0 if walks is None or n > NETWORK_ROWS else walks.limit(NETWORK_ROWS + 1).count()) <= NETWORK_ROWS


@dataclass
class Network:
    """Stops of patterns and walks as arrays; groups and lines by their place among the sorted ids."""

    groups: np.ndarray
    lines: np.ndarray
    long_line: np.ndarray
    long_group: np.ndarray
    g: np.ndarray
    cum: np.ndarray
    pat: np.ndarray
    pat_end: np.ndarray
    pat_wait: np.ndarray
    pat_line: np.ndarray
    at_ptr: np.ndarray
    at: np.ndarray
    walk_ptr: np.ndarray
    walk_to: np.ndarray
    walk_min: np.ndarray

    @classmethod
    def of(cls, stops: DataFrame, walks: DataFrame | None) -> Network:
        mode = F.col("mode").cast("int") if "mode" in stops.columns else F.lit(0)
        t = stops.select(*[F.col(c).cast("long").alias(c) for c in ("pat", "pos", "line", "g")], F.col("cum").cast("double").alias("cum"), F.col("wait").cast("double").alias("wait"), mode.alias("mode")).toArrow()
        pat, pos, line, g, cum, wait, mode = (t.column(i).to_numpy() for i in range(7))
        o = np.lexsort((pos, pat))
        pat, line, g, cum, wait, mode = (x[o] for x in (pat, line, g, cum, wait, mode))
        a = b = np.zeros(0, np.int64)
        minutes = np.zeros(0)
        if walks is not None:
            w = walks.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("minutes").cast("double").alias("minutes")).toArrow()
            a, b, minutes = (w.column(i).to_numpy() for i in range(3))
        groups = np.unique(np.concatenate([g, a, b]))
        lines, line_at = np.unique(line, return_inverse=True)
        g, a, b = (np.searchsorted(groups, x) for x in (g, a, b))
        first = np.flatnonzero(np.concatenate([[True], pat[1:] != pat[:-1]])) if len(pat) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(pat)]]))
        is_long = np.isin(mode, LONG_DISTANCE)
        long_line, long_group = np.zeros(len(lines), bool), np.zeros(len(groups), bool)
        long_line[line_at[is_long]] = True
        long_group[g[is_long]] = True
        at = np.argsort(g, kind="stable")
        walk = np.argsort(a, kind="stable")
        count = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(groups)))])
        return cls(
            groups, lines, long_line, long_group, g, cum, np.repeat(np.arange(len(first)), size), first + size, wait[first], line_at[first],
            count(g), at, count(a), b[walk], minutes[walk],
        )


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to its stop, and which pair each is of."""
    n = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), owner


def _in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which x are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


class Chunk:
    """Units of work that are solved together."""

    def __init__(self, net: Network, units: list[dict]):
        self.net, self.units = net, units
        ids = [o["g"] for u in units for o in u["origins"]] + [x for u in units for link in u["links"] or () for x in (link["f"], link["t"])] + [t["g"] for u in units for t in u["targets"] or ()]
        extra = np.setdiff1d(np.array(ids, np.int64), net.groups)
        self.groups = np.concatenate([net.groups, extra])
        self.order = np.argsort(self.groups, kind="stable")
        self.n = n = len(self.groups)
        pad = lambda p: np.concatenate([p, np.full(len(extra), p[-1])])
        self.at_ptr, self.walk_ptr = pad(net.at_ptr), pad(net.walk_ptr)
        self.long_group = np.concatenate([net.long_group, np.zeros(len(extra), bool)])
        # Origins: a row for each (unit, origin id); several groups may start it.
        names, start = {}, []
        for s, u in enumerate(units):
            for o in u["origins"]:
                start.append((names.setdefault((s, o["origin"]), len(names)), o["g"], o["t0"], o["lim"]))
        self.names = list(names)
        self.scn = np.array([s for s, _ in names], np.int64)
        self.start_o = np.array([x[0] for x in start], np.int64)
        self.start_g = self.place([x[1] for x in start])
        self.start_t = np.array([x[2] for x in start], float)
        self.lim = np.full(len(names), -np.inf)
        np.maximum.at(self.lim, self.start_o, np.array([x[3] for x in start], float))
        scope = np.array([u["scope"] or FULL for u in units])
        self.local, self.long = scope == LOCAL, scope == LONG
        line = lambda x: np.searchsorted(net.lines, x)
        known = lambda x: _in(net.lines, np.array(x, np.int64)) if len(net.lines) else np.zeros(len(x), bool)
        each = lambda k: [(s, x) for s, u in enumerate(units) for x in u[k] or ()]

        def keys(pairs, of):
            s, x = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
            if of == "line":
                ok = known(x)
                return s[ok] * len(net.lines) + line(x[ok]), ok
            ok = np.isin(x, self.groups)
            return s[ok] * n + self.place(x[ok]), ok

        self.disabled = np.unique(keys(each("disabled"), "line")[0])
        self.closed = np.unique(keys(each("closed"), "group")[0])
        self.allowed = np.unique(keys(each("allowed"), "group")[0])
        self.only = np.array([u["allowed"] is not None for u in units])
        scale = each("scale")
        k, ok = keys([(s, x["line"]) for s, x in scale], "line")
        o = np.argsort(k, kind="stable")
        self.scale, self.scale_by = k[o], np.array([x["scale"] for _, x in scale], float)[ok][o]
        links = each("links")
        f = np.array([s for s, _ in links], np.int64) * n + self.place([x["f"] for _, x in links])
        o = np.argsort(f, kind="stable")
        self.link_from, self.link_to, self.link_min = f[o], self.place([x["t"] for _, x in links])[o], np.array([x["minutes"] for _, x in links], float)[o]
        self.blocked = self._cuts(each("blocked"))
        targets = [(names[s, t["origin"]], t["g"], t["lim"]) for s, u in enumerate(units) for t in u["targets"] or ()]
        self.target_o = np.array([t[0] for t in targets], np.int64)
        self.target_g = self.place([t[1] for t in targets])
        self.target_lim = np.array([t[2] for t in targets], float)
        self.goal = np.zeros(len(names), bool)
        self.goal[self.target_o] = True

    def place(self, ids) -> np.ndarray:
        """Places of known group ids."""
        return self.order[np.searchsorted(self.groups, np.asarray(ids, np.int64), sorter=self.order)]

    def _cuts(self, pairs) -> np.ndarray:
        """Keys (scenario, place in the stops) of stops that can't be reached from the one before them."""
        net = self.net
        out = [np.zeros(0, np.int64)]
        for s, x in pairs:
            if not np.isin([x["a"], x["b"]], net.groups).all():
                continue
            a, b = (int(np.searchsorted(net.groups, x[k])) for k in "ab")
            for u, v in ((a, b), (b, a)):
                p = net.at[net.at_ptr[u] : net.at_ptr[u + 1]]
                p = p[p + 1 < net.pat_end[net.pat[p]]] + 1
                out.append(s * len(net.g) + p[net.g[p] == v])
        return np.unique(np.concatenate(out))

    def _ride(self, o, g, t, limit):
        net = self.net
        k, owner = _spread(self.at_ptr[g], self.at_ptr[g + 1])
        stop, o = net.at[k], o[owner]
        p = net.pat[stop]
        line, s = net.pat_line[p], self.scn[o]
        ok = ~(self.local[s] & net.long_line[line])
        key = s * len(net.lines) + line
        if len(self.disabled):
            ok &= ~_in(self.disabled, key)
        wait = net.pat_wait[p]
        if len(self.scale):
            i = np.minimum(np.searchsorted(self.scale, key), len(self.scale) - 1)
            wait = wait * np.where(self.scale[i] == key, self.scale_by[i], 1.0)
        off = t[owner] + wait - net.cum[stop]
        o, stop, p, off, s = o[ok], stop[ok], p[ok], off[ok], s[ok]
        end, run = net.pat_end[p], np.zeros(len(p), np.int64)
        if len(self.blocked):
            base = s * len(net.g)
            run = np.searchsorted(self.blocked, base + stop, "right")
            ahead = np.concatenate([self.blocked, [np.iinfo(np.int64).max]])[run] - base
            end = np.minimum(end, ahead)
        order = np.argsort(o * len(net.g) + stop, kind="stable")
        o, stop, p, off, end, run = (x[order] for x in (o, stop, p, off, end, run))
        if not len(o):
            return o, stop, off
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1]) | (run[1:] != run[:-1])])
        # The least so far within each stretch: ranks, lower from stretch to stretch, so that one running minimum serves all.
        rank = np.empty(len(off), np.int64)
        rank[np.argsort(off, kind="stable")] = np.arange(len(off))
        low = rank - (np.cumsum(new) - 1) * len(off)
        least = np.minimum.accumulate(low)
        use = new.copy()
        use[1:] |= low[1:] < least[:-1]
        o, stop, off, end, new = o[use], stop[use], off[use], end[use], new[use]
        until = np.concatenate([np.where(new[1:], np.iinfo(np.int64).max, stop[1:] + 1), [np.iinfo(np.int64).max]])
        k, owner = _spread(stop + 1, np.minimum(end, until))
        t = off[owner] + net.cum[k]
        o = o[owner]
        ok = t <= limit[o] + EPS
        return o[ok], net.g[k[ok]], t[ok]

    def _walk(self, o, g, t):
        k, owner = _spread(self.walk_ptr[g], self.walk_ptr[g + 1])
        return o[owner], self.net.walk_to[k], t[owner] + self.net.walk_min[k]

    def _link(self, o, g, t):
        key = self.scn[o] * self.n + g
        k, owner = _spread(np.searchsorted(self.link_from, key), np.searchsorted(self.link_from, key, "right"))
        return o[owner], self.link_to[k], t[owner] + self.link_min[k]

    def _may_be(self, o, g):
        """Where one may be: not at closed groups, nor outside those allowed."""
        s = self.scn[o]
        ok = ~(self.long[s] & ~self.long_group[g])
        if len(self.closed):
            ok &= ~_in(self.closed, s * self.n + g)
        if self.only.any():
            ok &= ~self.only[s] | _in(self.allowed, s * self.n + g)
        return ok

    def solve(self) -> np.ndarray:
        """Labels, a row for each origin; infinite where there is no way within the limit."""
        labels = np.full((len(self.names), self.n), np.inf)
        flat = labels.ravel()
        o, g, t = self.start_o, self.start_g, self.start_t
        limit = self.lim
        while True:
            ok = self._may_be(o, g) & (t <= limit[o] + EPS)
            key, t = o[ok] * self.n + g[ok], t[ok]
            better = t < flat[key] - EPS
            key, t = key[better], t[better]
            if not len(key):
                return labels
            np.minimum.at(flat, key, t)
            key = np.unique(key)
            if len(self.target_o):
                need = np.full(len(self.names), -np.inf)
                np.maximum.at(need, self.target_o, np.minimum(self.target_lim, labels[self.target_o, self.target_g]))
                limit = np.where(self.goal, np.minimum(self.lim, need), self.lim)
            o, g, t = key // self.n, key % self.n, flat[key]
            ok = t <= limit[o] + EPS
            o, g, t = o[ok], g[ok], t[ok]
            parts = [self._ride(o, g, t, limit), self._walk(o, g, t)]
            if len(self.link_from):
                parts.append(self._link(o, g, t))
            o, g, t = (np.concatenate([p[i] for p in parts]) for i in range(3))


UNIT = "scn bigint, origins array<struct<origin:bigint,g:bigint,t0:double,lim:double>>"


def units(s) -> DataFrame:
    """A row for each block of origins of a scenario, with the scenario's options and, if there are any, what is asked for."""
    o = s.origins.select(F.col("scn").cast("long").alias("scn"), F.col("origin").cast("long").alias("origin"), F.col("g").cast("long").alias("g"), F.col("t0").cast("double").alias("t0"), F.col("lim").cast("double").alias("lim"))
    sizes = o.groupBy("scn").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("origin"), F.col("blocks")).cast("int").alias("block")
    dealt = o.join(sizes, "scn").select("scn", block, F.struct("origin", "g", "t0", "lim").alias("o")).groupBy("scn", "block").agg(F.collect_list("o").alias("origins"))

    def with_list(df, table, name, kind, item):
        if table is None:
            return df.withColumn(name, F.lit(None).cast(f"array<{kind}>"))
        own = table.select(F.col("scn").cast("long").alias("scn"), item.cast(kind).alias("x")).distinct().groupBy("scn").agg(F.collect_list("x").alias(name))
        return df.join(own, "scn", "left")

    dealt = with_list(dealt, s.disabled, "disabled", "bigint", F.col("line"))
    dealt = with_list(dealt, s.closed, "closed", "bigint", F.col("g"))
    dealt = with_list(dealt, s.blocked, "blocked", "struct<a:bigint,b:bigint>", F.struct("a", "b"))
    dealt = with_list(dealt, s.scale, "scale", "struct<line:bigint,scale:double>", F.struct("line", "scale"))
    dealt = with_list(dealt, s.links, "links", "struct<f:bigint,t:bigint,minutes:double>", F.struct("f", "t", "minutes"))
    dealt = with_list(dealt, s.allowed, "allowed", "bigint", F.col("g"))
    if s.allowed is not None:  # with a table of allowed groups, a scenario without any allows none
        dealt = dealt.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<bigint>")))
    if s.scope is None:
        dealt = dealt.withColumn("scope", F.lit(FULL))
    else:
        dealt = dealt.join(s.scope.select(F.col("scn").cast("long").alias("scn"), F.col("scope").cast("int").alias("scope")).distinct(), "scn", "left")
    if s.targets is None:
        return dealt.withColumn("targets", F.lit(None).cast("array<struct<origin:bigint,g:bigint,lim:double>>"))
    t = s.targets.select(F.col("scn").cast("long").alias("scn"), F.col("origin").cast("long").alias("origin"), F.col("g").cast("long").alias("g"), F.col("lim").cast("double").alias("lim"))
    t = t.join(sizes, "scn").select("scn", block, F.struct("origin", "g", "lim").alias("t")).groupBy("scn", "block").agg(F.collect_list("t").alias("targets"))
    return dealt.join(t, ["scn", "block"], "left")


def parts(u: dict, room: int):
    """A unit in parts of at most ``room`` origins each, with what is asked of them."""
    names = sorted({o["origin"] for o in u["origins"]})
    if len(names) <= room:
        yield u
        return
    for i in range(0, len(names), room):
        some = set(names[i : i + room])
        yield u | {k: None if u[k] is None else [x for x in u[k] if x["origin"] in some] for k in ("origins", "targets")}


def _run(net: Network, s, schema: str, result) -> DataFrame:
    """``result(chunk, labels)`` gives the columns of rows out of each chunk."""
    spark = s.origins.sparkSession
    shared = spark.sparkContext.broadcast(net)
    # Long and short searches are dealt by chance over several times as many tasks as there are cores.
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = units(s).repartition(tasks, F.xxhash64("scn", "block", F.lit(3)))

    def rows(batches):
        import pyarrow as pa

        own = shared.value
        room = max(1, LABELS // max(1, len(own.groups)))
        names = [x.split()[0] for x in schema.split(", ")]

        def done(held):
            chunk = Chunk(own, held)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in result(chunk, chunk.solve())], names)

        held, n = [], 0
        for b in batches:
            for u in b.to_pylist():
                for part in parts(u, room):
                    if held and n + len(part["origins"]) > min(room, 1024):
                        yield done(held)
                        held, n = [], 0
                    held.append(part)
                    n += len(part["origins"])
        if held:
            yield done(held)

    return work.mapInArrow(rows, schema)


def all_times(net: Network, s) -> DataFrame:
    """(scn, origin, g, t): every group reached within the limit."""

    def result(c: Chunk, labels: np.ndarray):
        o, g = np.nonzero(np.isfinite(labels))
        scn, origin = (np.array([f(n) for n in c.names], np.int64) for f in (lambda n: c.units[n[0]]["scn"], lambda n: n[1]))
        return scn[o], origin[o], c.groups[g], labels[o, g]

    return _run(net, s, "scn bigint, origin bigint, g bigint, t double", result)


def target_times(net: Network, s) -> DataFrame:
    """(scn, origin, g, t): the targets that are reached within their limits."""

    def result(c: Chunk, labels: np.ndarray):
        t = labels[c.target_o, c.target_g]
        ok = t <= c.target_lim + EPS
        o = c.target_o[ok]
        scn, origin = (np.array([f(n) for n in c.names], np.int64) for f in (lambda n: c.units[n[0]]["scn"], lambda n: n[1]))
        return scn[o], origin[o], c.groups[c.target_g[ok]], t[ok]

    return _run(net, s, "scn bigint, origin bigint, g bigint, t double", result)


def reached(net: Network, s, weights: DataFrame) -> DataFrame:
    """(scn, origin, reached): the sum of the weights (g, dest) of the groups reached within the limit; ``weights`` has a row for each group at most."""
    w = weights.select(F.col("g").cast("long").alias("g"), F.col("dest").cast("double").alias("dest")).where("dest <> 0").limit(NETWORK_ROWS + 1).toArrow()
    if w.num_rows > NETWORK_ROWS:
        raise ValueError(f"more than {NETWORK_ROWS} groups")
    g, dest = w.column(0).to_numpy(), w.column(1).to_numpy()
    o = np.argsort(g)
    g, dest = g[o], dest[o]

    def result(c: Chunk, labels: np.ndarray):
        own = np.zeros(c.n)
        if len(g):
            i = np.minimum(np.searchsorted(g, c.groups), len(g) - 1)
            own = np.where(g[i] == c.groups, dest[i], 0.0)
        return np.array([c.units[s]["scn"] for s, _ in c.names], np.int64), np.array([x for _, x in c.names], np.int64), np.isfinite(labels) @ own

    return _run(net, s, "scn bigint, origin bigint, reached double", result)
