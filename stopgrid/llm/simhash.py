"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; the bit counts of its
segments are a point whose Manhattan distance to another point is at most the
Hamming distance of the fingerprints. The points are cut into bits + a parts:
at a distance of ``bits`` or less at most ``bits`` parts differ, so two near
points agree on a parts and meet in that cell of the grid; a grows with the
logarithm of the number of points (see AGREE). So the range join under the
Manhattan distance is an equality on parts of the grid, exact by the pigeonhole,
and no task scans a range. Within a cell the Manhattan distance filters, then
the Hamming distance decides. The result is exact: no link is lost.

By chance points meet in a cell as often as the square of their number. Where a
document has several fingerprints, each meets on its own; cells are then split
by the bits of their parts, not the counts alone. That is as exact, since near
fingerprints also have a parts with equal bits, and chance meetings are some
hundred times fewer.

Equal fingerprints are one node from the start. A task gives a spanning forest
of the links of a batch of cells, not all pairs: the components are the same. Cells with
more than CELL nodes are cut into blocks and each pair of blocks is a task's
work, so no task holds more than two blocks; a cell of n different fingerprints
deals n * n / CELL rows. Links, components and fingerprints stay distributed.

Defined results: a null or wordless text has fingerprint zero and links like any
other; a bit that is set in exactly half the hashes is 0; component_id is the
least non-null doc_id reachable, null if there is none; repeated rows fall into
one component; a text of megabytes is hashed whole, in blocks of shingles; an
empty table gives an empty one; only the id and the text are read, whatever
other columns there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopgrid.operators.components import connected_components

from .common import BROADCAST_ROWS, join_by_count, own_name, parallel, small_batches, written

SEED = 42
CELL = 4096
#: Nodes up to which near points must agree on 3, 4, 5 parts of the grid; on 6 beyond. More parts
#: make cells smaller, so that points seldom meet by chance, for more cells a point (20, 35, 56, ...).
AGREE = ((1 << 20, 3), (1 << 23, 4), (1 << 26, 5))
#: So many times as many nodes where cells are split by bits, with fewer meetings by chance.
AGREE_SPLIT = 128
#: Of the sets of shingles: least hashes a band, bands, and documents of a cell that a task compares with as many others.
BAND_ROWS, BANDS, SET_CELL = 5, 20, 512
_R = np.random.default_rng(SEED)
_XOR, _ODD = (_R.integers(0, 1 << 63, BAND_ROWS * BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
ODD = 0x5555555555555555
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash of a shingle; the 0th is the hash itself."""
    if j == 0:
        return h
    x = h ^ np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(text: str | None, shingle: int = 3, number: int = 1, block: int = 1 << 15) -> list[int]:
    """Fingerprints of a text as signed 64-bit integers."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return [0] * number
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    n = max(1, len(words) - shingle + 1)
    ends = [x - 1 for x in starts[shingle:]] + [len(joined)] if len(words) > shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((number, 64), np.int64)
    for i in range(0, n, block):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(i + block, n)], ends[i : i + block], strict=True)], np.uint64)
        for j in range(number):
            ones[j] += np.unpackbits(_mixed(h, j).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int(x) for x in np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.int64)[:, 0]]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, each once and in order."""
    words = (text or "").encode().translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))] if words else [], np.uint64))


def band_keys(s: np.ndarray) -> list[int]:
    """A key for each band of the set's least hashes: sets with a similarity of 0.8 share none of 20 in 4 of 10,000 cases."""
    if not len(s):
        return []
    least = np.full(len(_XOR), (1 << 64) - 1, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, i : i + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    return np.array([xxhash.xxh64_intdigest(least[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def fingerprint_table(docs: DataFrame, doc_id: str, text: str, shingle: int, number: int, similar: bool = False) -> DataFrame:
    """(doc_id, th, fps) for each row; th is a hash of the text, fps an array of ``number`` fingerprints.

    With ``similar`` also sh, a hash of the set of shingles, and its bands.
    """
    small_batches(docs.sparkSession)

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            th = np.array([xxhash.xxh64_intdigest(t or "", SEED) for t in texts], np.uint64).view(np.int64)
            cols = {"doc_id": b.column(0), "th": pa.array(th), "fps": pa.array([fingerprints(t, shingle, number) for t in texts], pa.list_(pa.int64()))}
            if similar:
                sets = [shingle_set(t, shingle) for t in texts]
                cols["sh"] = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
                cols["bands"] = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = "doc_id bigint, th bigint, fps array<bigint>" + (", sh bigint, bands array<bigint>" if similar else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def grid(nodes: DataFrame, bits: int, agree: int = 3, split: bool = False) -> DataFrame:
    """(cell, fp, node): each node in the cells where its near ones must meet it; with ``split`` those of equal bits only."""
    parts = bits + agree
    size = [32 // parts + (k < 32 % parts) for k in range(parts)]
    masks = [((1 << 2 * n) - 1) << 2 * sum(size[:k]) & ODD for k, n in enumerate(size)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    # Of a segment's two bits: is any set, are both set. Together they tell the count.
    out = nodes.select("node", F.posexplode("fps").alias("j", "fp")).withColumn("any", low.bitwiseOR(high)).withColumn("both", low.bitwiseAND(high))
    chosen = [sum(masks[i] for i in c) for c in combinations(range(parts), agree)]
    if split:  # equal bits have equal counts
        cells = [F.xxhash64("j", F.lit(k), fp.bitwiseAND(F.lit(signed(m | m << 1)))) for k, m in enumerate(chosen)]
    else:
        cells = [F.xxhash64("j", F.lit(k), F.col("any").bitwiseAND(F.lit(signed(m))), F.col("both").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(chosen)]
    return out.select("node", "fp", F.explode(F.array(*cells)).alias("cell"))


def _near(fp: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether fp[a] and fp[b] are near: the Manhattan distance of their counts first, then the Hamming distance."""
    x, y = fp[a], fp[b]
    odd = np.uint64(ODD)
    lx, hx, ly, hy = x & odd, x >> np.uint64(1) & odd, y & odd, y >> np.uint64(1) & odd
    ok = np.bitwise_count((lx | hx) ^ (ly | hy)) + np.bitwise_count((lx & hx) ^ (ly & hy)) <= bits
    ok[ok] = np.bitwise_count(x[ok] ^ y[ok]) <= bits
    return ok


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one large group: a breadth-first search over its fingerprints."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            ok = _near(fp, np.full(len(left), i), left, bits)
            if ok.any():
                got = left[ok]
                a += [i] * len(got)
                b += got.tolist()
                queue += got.tolist()
                left = left[~ok]
    return np.array(a, int), np.array(b, int)


def links_in_cells(key: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes with equal keys; the rows come sorted by key."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    out_a, out_b = [], []
    small = np.repeat(size <= 64, size)
    for k in range(1, min(64, int(size.max(initial=0)))):
        a = np.flatnonzero((key[:-k] == key[k:]) & small[:-k])
        if not len(a):
            continue
        ok = _near(fp, a, a + k, bits)
        out_a.append(node[a[ok]])
        out_b.append(node[a[ok] + k])
    for s, n in zip(edge[size > 64], size[size > 64], strict=True):
        a, b = _forest(fp[s : s + n], bits)
        out_a.append(node[s + a])
        out_b.append(node[s + b])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
    return a[a != b], b[a != b]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a, b) a forest that spans the same components."""
    if not len(a):
        return a, b
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    x, y = np.divmod(np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y)), len(names))
    root, kept = list(range(len(names))), []
    for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append(i)
    return names[x[kept]], names[y[kept]]


def links(nodes: DataFrame, bits: int, split: bool = False) -> DataFrame:
    """(a, b): near nodes, enough of them to span every component; ``split`` as in ``grid``."""
    spark = nodes.sparkSession
    n = nodes.count() // (AGREE_SPLIT if split else 1)
    cells = grid(nodes, bits, next((a for most, a in AGREE if n <= most), 6), split)
    sizes = written(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    total, met = sizes.agg(F.sum("n"), F.count("*")).first()
    # Most cells hold one node: where the others are few, nothing of these is shuffled.
    shared = cells.join(F.broadcast(sizes), "cell") if met <= BROADCAST_ROWS else join_by_count(cells, sizes, ["cell"], "n", total)
    k = F.ceil(F.col("n") / CELL).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(7)), k).cast("int")
    others = F.sequence(F.lit(0), k - 1)
    pair = F.explode(F.when(F.col("n") <= CELL, F.array(F.lit(0))).otherwise(F.transform(others, lambda o: F.least(o, F.col("block")) * k + F.greatest(o, F.col("block")))))
    dealt = shared.withColumn("block", block).select("cell", "fp", "node", pair.alias("pair")).select(F.xxhash64("cell", "pair").alias("key"), "fp", "node")
    # A key of two cells or pairs of blocks by chance only costs comparisons: every link is checked.
    sorted_ = dealt.repartition(parallel(spark), "key").sortWithinPartitions("key")

    def rows(batches):
        import pyarrow as pa

        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

        def made(key, fp, node):
            a, b = spanning(*links_in_cells(key, fp, node, bits))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            new = [x.column(0).to_numpy(), x.column(1).to_numpy().view(np.uint64), x.column(2).to_numpy()]
            held = [np.concatenate(p) for p in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut:
                yield made(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield made(*held)

    return sorted_.mapInArrow(rows, "a bigint, b bigint")


def links_of_sets(sets: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with a Jaccard similarity of 0.8 or more, enough of them to join every component that such a pair joins."""
    size = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    group, out = component.copy(), []
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & (5 * np.minimum(size[i + 1 :], size[i]) >= 4 * np.maximum(size[i + 1 :], size[i])))
        if not len(j):
            continue
        values = np.concatenate([flat[start[k] : start[k + 1]] for k in j])
        at = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
        both = np.add.reduceat((sets[i][at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]]))
        for k in j[5 * both >= 4 * (size[i] + size[j] - both)].tolist():
            if group[k] != group[i]:
                out.append((i, k))
                group[group == group[k]] = group[i]
    return out


def similar_links(docs: DataFrame, text: str, shingle: int, table: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b): nodes of documents whose sets of shingles have a similarity of 0.8 or more.

    Candidates share a band; the sets decide. Enough links to join the components
    ``of`` that they join: a cell within one component is left out, and of cells
    with the same documents one is taken.
    """
    spark = docs.sparkSession
    sets = written(table.groupBy("sh").agg(F.first("bands").alias("bands"), F.min("th").alias("th"), F.min("node").alias("node"), F.count("*").alias("c")), "sets")
    equal = table.select("sh", F.col("node").alias("b")).distinct().join(sets.select("sh", F.col("node").alias("a")), "sh").where("a <> b").select("a", "b")
    placed = sets.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = placed.select("sh", "node", "component", F.explode("bands").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("sh")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sh")).alias("y"))
    sizes = written(sizes.where("n > 1 and lo < hi").groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "n"), "set_cells")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return equal
    # Of a large cell the members of its largest component are compared with the others only, not with each other.
    own = join_by_count(cells, sizes.where(F.col("n") > SET_CELL), ["cell"], "n", total).groupBy("cell", "component").agg(F.count("*").alias("c"))
    major = own.groupBy("cell").agg(F.max(F.struct("c", "component")).alias("m")).select("cell", F.col("m.component").alias("major"), F.col("m.c").alias("nm"))
    sizes = written(sizes.join(major, "cell", "left"), "cell_majors")
    shared = join_by_count(cells, sizes, ["cell"], "n", total)
    km, kr = F.ceil(F.col("nm") / SET_CELL).cast("int"), F.ceil((F.col("n") - F.col("nm")) / SET_CELL).cast("int")
    is_major = F.col("component") == F.col("major")
    block = F.coalesce(F.pmod(F.xxhash64("sh", F.lit(7)), F.when(is_major, km).otherwise(kr)).cast("int"), F.lit(0))
    b = F.col("block")
    beside = F.transform(F.sequence(F.lit(0), kr - 1), lambda o: b * kr + o)
    others = F.concat(F.transform(F.sequence(F.lit(0), km - 1), lambda o: o * kr + b), F.transform(F.sequence(F.lit(0), kr - 1), lambda o: km * kr + F.least(o, b) * kr + F.greatest(o, b)))
    pair = F.explode(F.when(F.col("major").isNull(), F.array(F.lit(0))).when(is_major, beside).otherwise(others))
    shared = written(shared.withColumn("block", block), "set_members")
    dealt = shared.select("cell", "sh", "node", "component", pair.alias("pair")).select(F.xxhash64("cell", "pair").alias("key"), "sh", "node", "component")
    wanted = written(sets.join(shared.select("sh").distinct(), "sh").select("th", "c"), "wanted")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # texts stay where they are
        once = texts.join(F.broadcast(wanted.select("th")), "th", "left_semi")
    else:
        once = join_by_count(texts, wanted, ["th"], "c", table.count()).groupBy("th").agg(F.first("t").alias("t"))
    small_batches(spark)

    def arrays(batches):
        import pyarrow as pa

        for b in batches:
            found = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            sh = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sh), pa.array([s.tobytes() for s in found], pa.binary())], ["sh", "s"])

    found = once.select("t").mapInArrow(arrays, "sh bigint, s binary")
    held_sets = written(found.groupBy("sh").agg(F.first("s").alias("s")), "shingle_sets")
    # Dealt by number: the sizes that the engine goes by are of the rows before they get their sets.
    with_sets = dealt.repartition(parallel(spark), "sh").join(held_sets.repartition(parallel(spark), "sh"), "sh")
    sorted_ = with_sets.select("key", "node", "component", "s").repartition(parallel(spark), "key").sortWithinPartitions("key")

    def rows(batches):
        import pyarrow as pa

        def made(rows):
            got = links_of_sets([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] for r in rows], np.int64)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in got], pa.int64()), pa.array([rows[j][1] for _, j in got], pa.int64())], ["a", "b"])

        group = []
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if group and group[0][0] != r[0]:
                    yield made(group)
                    group = []
                group.append(r)
        if group:
            yield made(group)

    return sorted_.mapInArrow(rows, "a bigint, b bigint").unionByName(equal)


def _labelled(docs: DataFrame, doc_id: str, text: str, shingle: int, bits: int, number: int, similar: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table of fingerprints with a node for each row, and (node, component, component_id, n)."""
    node = F.element_at("fps", 1) if number == 1 else F.xxhash64("fps")
    table = written(fingerprint_table(docs, doc_id, text, shingle, number, similar).withColumn("node", node), "fingerprints")
    nodes = written(table.groupBy("node").agg(F.first("fps").alias("fps"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = written(links(nodes, bits, number > 1).distinct(), "links")
    of = connected_components(found, local=BROADCAST_ROWS)
    if similar:
        of = written(of, "components")
        found = found.unionByName(written(similar_links(docs, text, shingle, table, of).where("a <> b").distinct(), "similar"))
        of = connected_components(found, local=BROADCAST_ROWS)
    named = nodes.select("node", "least", "n").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("__nodes"))
    # A component may hold a large part of all nodes.
    labels = join_by_count(named, best, ["component"], "__nodes", nodes.count())
    return table, written(labels.select("node", "component", "component_id", "n"), "labels")


def _rows(table: DataFrame, labels: DataFrame) -> DataFrame:
    return join_by_count(table, labels, ["node"], "n", labels.agg(F.sum("n")).first()[0] or 0)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3, number: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``number`` independent fingerprints may be asked for; documents then link if
    any of them is near, and ``fingerprint`` is the first.
    """
    out = _rows(*_labelled(docs, doc_id, text, shingle, bits, number))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fps", 1)), 16, "0")).alias("fingerprint"), "component_id")


def text_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = 3, number: int = 8) -> DataFrame:
    """(th, component) for each distinct text: its hash and the group of copies that ``keep_one`` would put it in."""
    table, labels = _labelled(docs, doc_id, text, shingle, bits, number, True)
    texts = table.select("th", "node").distinct()
    each = texts.groupBy("node").agg(F.count("*").alias("c"))
    of = labels.select("node", "component").join(each, "node")
    return written(join_by_count(texts, of, ["node"], "c", of.agg(F.sum("c")).first()[0] or 0).select("th", "component"), "groups")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = 3, number: int = 8) -> DataFrame:
    """The row of ``docs`` with the least doc_id of each component (null last; then by a hash of the text).

    Documents link by a near fingerprint, or by sets of shingles with a Jaccard similarity of 0.8 or more.
    """
    rows = _rows(*_labelled(docs, doc_id, text, shingle, bits, number, True))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("__d"), F.col("x.th").alias("__t"))
    h = own_name("__h", docs)
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    on = keyed[doc_id].cast("long").eqNullSafe(kept["__d"]) & (keyed[h] == kept["__t"])
    # The join deals rows by id and hash, so rows that are repeats meet and one of them stays.
    return keyed.join(kept, on, "left_semi").dropDuplicates([doc_id, h]).drop(h)
