"""Removal of repeated byte strings by a sorted array of sampled suffixes.

A string of LENGTH bytes that starts earlier elsewhere (a smaller doc_id, or the
same document, further left) is removed; see ``remove_repeats``.

All suffixes of 100 TB can't be dealt out: each would ship LENGTH bytes. Suffixes
are sampled by content instead. Every string of LENGTH bytes holds one least
GRAM-byte gram, by a hash, leftmost among equals. Equal strings have it at the
same offset, so the strings of a text fall into runs that share one anchor, and
equal strings are only ever in runs whose anchors have equal grams. One suffix
for each run (about one in 35 bytes), as long as its strings reach, stands for
all of them; nothing is lost. Steps:

1. Count the grams at anchors (partial sums before the shuffle). A bitmap of
   those found twice or more, at most BITMAP_BITS bits, is broadcast; runs whose
   gram is not in it hold no repeated string and are dropped where they are read.
2. Splitters sampled from the counted grams range-partition the other runs by
   their leading bytes, those of the anchor's gram.
3. Each bucket sorts the strings of its runs locally by multikey quicksort, eight
   bytes a level, going on with ties only; in a tie of LENGTH bytes all but the
   first string are repeats.
4. Spans are joined with the texts and cut out.

Skew: a gram with more than HEAVY_SHARE-th of all anchors (at most HEAVY_SHARE
such) would fill its bucket. Its strings are dealt by a hash of all their bytes
instead, which crosses bucket boundaries, after each task has kept only its
first copy of equal runs and equal strings and given out the spans of the rest.

Defined results: a null text is empty; rows with a null doc_id come first; rows
with one doc_id are ordered by a hash of the text, and rows with both the same
are one document; equal strings keep the first by that order and place; a text
of megabytes is cut into pieces of CHUNK bytes that overlap by LENGTH - 1; an
empty table gives an empty table; n_bytes, n_removed, n_spans and kept replace
columns of their name and all others pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, own_name, parallel, schema_of, small_batches, written

LENGTH = 100
GRAM = 32
CHUNK = 2 << 20
BITMAP_BITS = 1 << 28
#: The bitmap is built in parts of so many bits (a power of two), each by one task.
PART_BITS = 18
HOT_LEAST = 2_000
#: Runs or strings of hot grams that a task holds before it deals them out.
HELD = 20_000
NO_ID = -(1 << 63)

MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _windows(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive values, by doubling; f(a, b, k) joins windows of which a spans k values."""
    have, k, done, size = x, 1, None, 0
    while True:
        if n & k:
            if done is None:
                done, size = have, k
            else:
                m = len(x) - size - k + 1
                done = f(done[:m], have[size : size + m], k)
                size += k
        if size == n:
            return done
        m = len(have) - k
        have = f(have[:m], have[k : k + m], k)
        k *= 2


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n bytes."""
    powers = {}
    k = 1
    while k <= n:
        powers[k] = np.uint64(pow(int(MUL), k, 1 << 64))
        k *= 2
    return _mix(_windows(raw.astype(np.uint64) + np.uint64(1), n, lambda a, b, k: a * powers[k] + b))


def runs(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of strings with one anchor, over texts joined in ``raw`` that start at ``starts`` (its end last).

    Returns first and last string start, anchor place and the anchor's gram hash.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = _grams(raw, gram)
    # High half: hash, low half: place, so that the least is leftmost among equals.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = length - gram + 1
    k, least = 1, key
    while 2 * k <= span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    m = len(key) - span + 1
    least = np.minimum(least[:m], least[span - k : span - k + m])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.zeros(m, bool)  # a text starts here
    inner = starts[:-1]
    text[inner[inner < m]] = True
    new = np.concatenate([[True], (at[1:] != at[:-1])]) | text
    first = np.flatnonzero(new)
    # A run is cut where a text's last string ends; what is left of it there crosses into the next text.
    last = np.concatenate([first[1:] - 1, [m - 1]])
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(last, starts[owner + 1] - length)
    good = last >= first
    first, last = first[good], last[good]
    place = at[first]
    return first, last, place, h[place]


def _units(texts: list, length: int, most: int = CHUNK):
    """Lists of (row, offset, bytes) of about ``most`` bytes; a longer text is cut, with overlaps of length - 1."""
    units, size = [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for at in range(0, max(1, len(b) - length + 1), most):
            piece = b[at : at + most + length - 1]
            if units and size + len(piece) > most:
                yield units
                units, size = [], 0
            units.append((i, at, piece))
            size += len(piece)
    if units:
        yield units


def _cut(units: list, length: int, gram: int):
    raw = np.frombuffer(b"".join([u[2] for u in units]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(u[2]) for u in units])])
    return raw, starts, *runs(raw, starts, length, gram)


def _lead(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | raw[at + k]
    return out


def repeats(group: np.ndarray, raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which strings raw[at:at+length] equal an earlier one (by position in ``at``) of their group.

    Multikey quicksort: all strings are ordered by eight bytes, then each tie by
    eight others, from both ends inwards, as runs of one gram agree in the middle.
    """
    places = [*range(0, length - 7, 8)]
    if places[-1] != length - 8:
        places.append(length - 8)
    order = [p for pair in zip(places, reversed(places), strict=True) for p in pair][: len(places)]
    live, tie = np.arange(len(at)), group
    for p in order:
        if not len(live):
            break
        word = _lead(raw, at[live] + p)
        o = np.lexsort((word, tie))
        live, tie, word = live[o], tie[o], word[o]
        new = np.concatenate([[True], (tie[1:] != tie[:-1]) | (word[1:] != word[:-1])])
        tie = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])
        live, tie = live[~alone], tie[~alone]
    out = np.zeros(len(at), bool)
    if len(live):
        o = np.lexsort((live, tie))
        live, tie = live[o], tie[o]
        out[live[1:][tie[1:] == tie[:-1]]] = True
    return out


def _joined(start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, ascending, of strings of ``length``, joined where they touch."""
    if not len(start):
        return start, start
    new = np.flatnonzero(np.concatenate([[True], np.diff(start) > length]))
    return start[new], np.concatenate([start[new[1:] - 1], start[-1:]]) + length


def _docs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _gram_counts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def grams(batches):
        import pyarrow as pa

        for b in batches:
            for units in _units(b.column(0).to_pylist(), length):
                raw, _, _, _, place, h = _cut(units, length, gram)
                kind, some, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), pa.array(n), pa.array(_lead(raw, place[some]).view(np.int64))], ["h", "n", "lead"])

    return rows.select("text").mapInArrow(grams, "h bigint, n bigint, lead bigint").groupBy("h").agg(F.sum("n").alias("n"), F.first("lead").alias("lead"))


def _bitmap(found: DataFrame, n: int) -> np.ndarray:
    """A bitmap of at most BITMAP_BITS bits in which the grams' hashes are set."""
    bits = 16
    while 1 << bits < min(BITMAP_BITS, 16 * n):
        bits += 1
    # By the low half: anchors are grams whose high half is small.
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    part_bits = min(bits, PART_BITS)

    def part(table):
        """The bits of one part of the map, set in the task that counts the part's grams."""
        import pyarrow as pa

        own = np.zeros(1 << (part_bits - 6), np.uint64)
        x = table.column("at").to_numpy().astype(np.uint64) & np.uint64((1 << part_bits) - 1)
        np.bitwise_or.at(own, (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([own.tobytes()], pa.binary())})

    parts = found.select(F.shiftright(at, part_bits).alias("part"), at.alias("at")).groupBy("part").applyInArrow(part, "part bigint, bits binary")
    out = np.zeros(1 << (bits - 6), np.uint64)
    step = 1 << (part_bits - 6)
    for r in parts.toLocalIterator():
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(r.bits, np.uint64)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() - 1 + 6
    at = h & np.uint64((1 << bits) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


ROW = "bucket int, k bigint, d bigint, t bigint, lo int, rel int, seg binary"


def _dealt(rows: DataFrame, bitmap: np.ndarray, hot: np.ndarray, splitters: np.ndarray, length: int, gram: int) -> DataFrame:
    """Runs that may repeat, with the bucket of each; rows with a null seg are spans that are known already (lo to rel)."""
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, hot, splitters))
    n_buckets = len(splitters) + 1

    def deal(batches):
        import pyarrow as pa

        bitmap, hot, splitters = shared.value
        held: dict[tuple, tuple] = {}  # of hot grams: a run's bytes -> its first place so far

        def table(cols):
            bucket, k, d, t, lo, rel, seg = cols
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(bucket, np.int32)), pa.array(np.asarray(k, np.int64)), pa.array(np.asarray(d, np.int64)), pa.array(np.asarray(t, np.int64)), pa.array(np.asarray(lo, np.int32)), pa.array(np.asarray(rel, np.int32)), pa.array(seg, pa.binary())], ["bucket", "k", "d", "t", "lo", "rel", "seg"])

        def spans(x):
            return table([[hash(s[:2]) % n_buckets for s in x], [0] * len(x), [s[0] for s in x], [s[1] for s in x], [s[2] for s in x], [s[3] for s in x], [None] * len(x)])

        def flush():
            """Of the runs held: each string once, under a hash of all its bytes, and the spans of the others."""
            first: dict[bytes, tuple] = {}
            known = []
            for (_, seg), (d, t, lo) in sorted(held.items(), key=lambda x: x[1]):
                for i in range(len(seg) - length + 1):
                    s = seg[i : i + length]
                    if s in first:
                        known.append((d, t, lo + i, lo + i + length))
                    else:
                        first[s] = (d, t, lo + i)
            held.clear()
            own = list(first.items())
            h = [xxhash.xxh64_intdigest(s) for s, _ in own]
            k = np.array(h, np.uint64).view(np.int64)
            yield table([[x % n_buckets for x in h], k, [p[0] for _, p in own], [p[1] for _, p in own], [p[2] for _, p in own], [0] * len(own), [s for s, _ in own]])
            if known:
                yield spans(known)

        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(x or "", 42) for x in texts], np.uint64).view(np.int64)
            for units in _units(texts, length):
                raw, starts, first, last, place, h = _cut(units, length, gram)
                ok = _in(bitmap, h)
                first, last, place, h = first[ok], last[ok], place[ok], h[ok]
                owner = np.searchsorted(starts, first, "right") - 1
                row = np.array([u[0] for u in units])[owner]
                base = starts[owner] - np.array([u[1] for u in units])[owner]
                d, th = ids[row], hashes[row]
                joined = raw.tobytes()
                seg = [joined[i:j] for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)]
                bucket = np.searchsorted(splitters, _lead(raw, place), "right")
                warm = np.isin(h, hot)
                cold = np.flatnonzero(~warm)
                if len(cold):
                    yield table([bucket[cold], h[cold].view(np.int64), d[cold], th[cold], (first - base)[cold], (place - first)[cold], [seg[i] for i in cold.tolist()]])
                known = []
                for i in np.flatnonzero(warm).tolist():
                    me = (int(d[i]), int(th[i]), int(first[i] - base[i]))
                    key = (int(place[i] - first[i]), seg[i])
                    was = held.get(key)
                    if was is None or me < was:
                        held[key] = me
                    if was is not None and was != me:
                        x = max(was, me)
                        known.append((*x, x[2] + len(seg[i])))
                if known:
                    yield spans(known)
                if len(held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(deal, ROW)


def _find(dealt: DataFrame, length: int) -> DataFrame:
    """(d, t, a, b): spans to remove, from runs dealt out and sorted by k."""

    def find(batches):
        import pyarrow as pa

        kept: list[list] = [[] for _ in range(6)]

        def spans(d, t, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (d, t, a, b)], ["d", "t", "a", "b"])

        def solve(k, d, t, lo, rel, seg):
            k = np.asarray(k)
            new = np.concatenate([[True], k[1:] != k[:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(new), [len(k)]]))
            group = np.cumsum(new) - 1
            many = np.flatnonzero(size[group] > 1).tolist()
            out = [[], [], [], []]
            seen: dict[tuple, tuple] = {}
            reps = []
            for i in many:
                me = (d[i], t[i], lo[i])
                was = seen.setdefault((int(group[i]), rel[i], seg[i]), me)
                if was is me:
                    reps.append(i)
                elif was != me:  # an equal run stands earlier: all of this one repeats
                    for o, x in zip(out, (d[i], t[i], lo[i], lo[i] + len(seg[i])), strict=True):
                        o.append(x)
            if reps:
                g = group[reps]
                n = np.bincount(g, minlength=len(size))
                reps = [i for i, x in zip(reps, (n[g] > 1).tolist(), strict=True) if x]
            if reps:
                raw = np.frombuffer(b"".join([seg[i] for i in reps]), np.uint8)
                sizes = np.array([len(seg[i]) for i in reps])
                base = np.cumsum(sizes) - sizes
                count = sizes - length + 1
                owner = np.repeat(np.arange(len(reps)), count)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                # Equal strings have their anchor at the same offset.
                offset = np.array([rel[i] for i in reps])[owner] - inner
                bad = repeats(group[reps][owner] * 256 + offset, raw, base[owner] + inner, length)
                at = np.flatnonzero(bad)
                if len(at):
                    o, s = owner[at], inner[at]
                    cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)]))
                    stop = np.concatenate([cut[1:] - 1, [len(at) - 1]])
                    pick = lambda col: np.array([col[i] for i in reps], np.int64)[o[cut]]
                    for x, y in zip(out, (pick(d), pick(t), pick(lo) + s[cut], pick(lo) + s[stop] + length), strict=True):
                        x += y.tolist()
            return spans(*out)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(1, 7)]
            known = [i for i, s in enumerate(cols[5]) if s is None]
            if known:
                yield spans(*[[cols[c][i] for i in known] for c in (1, 2, 3, 4)])
                cols = [[x for x, s in zip(c, cols[5], strict=True) if s is not None] for c in cols]
            for have, new in zip(kept, cols, strict=True):
                have += new
            if len(kept[0]) >= 20_000:
                end = len(kept[0]) - 1
                while end and kept[0][end - 1] == kept[0][-1]:
                    end -= 1
                if end:
                    yield solve(*[c[:end] for c in kept])
                    kept = [c[end:] for c in kept]
        if kept[0]:
            yield solve(*kept)

    n = parallel(dealt.sparkSession)
    # Within one k, the order of rows is that of the strings.
    return dealt.repartition(n, "bucket").sortWithinPartitions("k", "d", "t", "lo").mapInArrow(find, "d bigint, t bigint, a bigint, b bigint")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, t, spans): for each document, by id and text hash, the byte spans to remove, ascending and disjoint."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _docs(docs, doc_id, text)
    counts = written(_gram_counts(rows, length, gram).where("n > 1"), "grams")
    n, total = counts.agg(F.count("*"), F.sum("n")).first()
    hot_from = max(HOT_LEAST, (total or 0) // HEAVY_SHARE)
    hot = np.array([r.h for r in counts.where(F.col("n") > hot_from).select("h").collect()], np.int64).view(np.uint64)
    buckets = 8 * parallel(spark)
    # Splitters at even ranks of the sampled leading bytes; the sign bit is turned, as the numbers are unsigned.
    lead = counts.select(F.col("lead").bitwiseXOR(F.lit(NO_ID)).alias("x")).sample(min(1.0, 200_000 / max(1, n)), 7)
    cuts = lead.agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    splitters = np.unique(np.array(cuts, np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    found = _find(_dealt(rows, _bitmap(counts, n), hot, splitters, length, gram), length)
    return found.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary: the bytes that are left, which may end within a character).

    A byte is removed if a string of ``length`` bytes that covers it also starts
    earlier. Strings are judged on the input.
    """
    spark = docs.sparkSession
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    own = docs.select(*[c for c in docs.columns if c not in made])
    keep = own.columns
    spans = repeated_spans(docs, doc_id, text, length, gram)
    d, t, cuts = (own_name(x, own) for x in ("__d", "__t", "__spans"))
    keyed = own.withColumn(d, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).withColumn(t, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(spans, (keyed[d] == spans["d"]) & (keyed[t] == spans["t"]), "left").select(*[keyed[c] for c in keep], spans["spans"].alias(cuts))
    schema = schema_of(own, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    small_batches(spark)

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, s in zip(b.column(text).to_pylist(), b.column(cuts).to_pylist(), strict=True):
                raw = (t or "").encode()
                left, at, n, removed = [], 0, 0, 0
                end = -1
                for x in s or ():
                    if x["a"] > end:
                        left.append(raw[at : x["a"]])
                        n += 1
                        end = x["a"]
                    if x["b"] > end:
                        removed += x["b"] - end
                        end = x["b"]
                    at = end
                left.append(raw[at:])
                out.append((len(raw), removed, n, b"".join(left)))
            cols = [b.column(c) for c in keep] + [pa.array([o[i] for o in out], pa.int64()) for i in range(3)] + [pa.array([o[3] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *made])

    return joined.mapInArrow(cut, schema)
