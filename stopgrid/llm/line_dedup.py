"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

The state is a table of line keys (128-bit hashes) with the number of documents
that hold each, and, for each shard of the keys, a cuckoo filter of those held
by ``min_docs`` documents or more. Documents are added and removed by their
counts; a key that crosses the limit is put into or taken out of its shard's
filter, so any sequence of additions and removals leaves what a fresh build
over the remaining documents would give.

A document's lines are looked up in the filters first, and only what they let
through is checked against the counts; the filters' false hits change nothing.
If at most LOCAL_KEYS keys are over the limit, they and their filters are
broadcast (some megabytes) and documents are cleaned where they are read. Beyond
that, line keys are dealt by shard, each task loads the filters of its shards,
and what remains is joined with the counts; a key in very many documents is
broadcast (see ``join_by_count``), so it fills no task.

Defined results: a null or empty text is one empty line; keys without code
points never count; repeated rows are documents of their own; a line that is in
exactly ``min_docs`` documents goes (no ties: a key is over the limit or not);
an empty table has no keys; a text of megabytes is cut into lines whole;
``n_lines``, ``n_dropped`` and the text replace columns of their name, all
others pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, own_name, parallel, schema_of, scratch, small_batches, written

MIN_DOCS = 10
SHARD_KEYS = 1 << 20
LOCAL_KEYS = 250_000
SPACE = b" \t\r\x0b\x0c"
#: Of the hash that names a text in a table of groups.
TEXT_SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; keys are pairs of 64-bit integers."""

    SLOTS = 4

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1
            while n * self.SLOTS * 0.85 < keys + 1:
                n *= 2
            table = np.zeros((n, self.SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def _mark(b: np.ndarray) -> np.ndarray:
        return ((b >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)

    def _places(self, a: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.uint64(len(self.table) - 1)
        first = a & n
        return first, self._other(first, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        n = np.uint64(len(self.table) - 1)
        step = mark.astype(np.uint64) * np.uint64(0x5BD1E995) & n
        return place ^ step

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mark = self._mark(b)
        i, j = self._places(a, mark)
        return (self.table[i] == mark[:, None]).any(1) | (self.table[j] == mark[:, None]).any(1)

    def _put(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets, as far as there are; which found none."""
        order = np.argsort(place, kind="stable")
        p = place[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        nth = np.arange(len(p)) - np.repeat(first, np.diff(np.concatenate([first, [len(p)]])))
        free = self.table[p] == 0
        fits = nth < free.sum(1)
        slot = np.argmax(free.cumsum(1) > nth[:, None], axis=1)
        self.table[p[fits], slot[fits]] = mark[order][fits]
        return order[~fits]

    def insert(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Put each key in once; False if the table is too full, which leaves it unusable."""
        mark = self._mark(b)
        first, second = (x.astype(np.int64) for x in self._places(a, mark))
        left = self._put(first, mark)
        left = left[self._put(second[left], mark[left])]
        # What is left displaces others: few keys, as buckets are seldom full.
        t, r = self.table, 1
        for m, place in zip(mark[left].tolist(), second[left].tolist(), strict=True):
            for _ in range(500):
                free = np.flatnonzero(t[place] == 0)
                if len(free):
                    t[place, free[0]] = m
                    break
                r = (r * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (r >> 8) % self.SLOTS
                m, t[place, slot] = int(t[place, slot]), m
                place = int(self._other(np.array([place], np.uint64), np.array([m], np.uint16))[0])
            else:
                return False
        return True

    def _take(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Take marks out of their buckets, one slot for each; which weren't there."""
        order = np.lexsort((mark, place))
        p, m = place[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (m[1:] != m[:-1])])) if len(p) else np.zeros(0, np.int64)
        nth = np.arange(len(p)) - np.repeat(first, np.diff(np.concatenate([first, [len(p)]])))
        own = self.table[p] == m[:, None]
        found = nth < own.sum(1)
        slot = np.argmax(own.cumsum(1) > nth[:, None], axis=1)
        self.table[p[found], slot[found]] = 0
        return order[~found]

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take each key out once; it must be in."""
        mark = self._mark(b)
        first, second = (x.astype(np.int64) for x in self._places(a, mark))
        left = self._take(first, mark)
        self._take(second[left], mark[left])

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, "<u2").reshape(-1, cls.SLOTS).copy())

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> CuckooFilter:
        room = len(a)
        while True:
            f = cls(room)
            if f.insert(a, b):
                return f
            room = room * 2 + 8


@dataclass
class LineState:
    """counts: (a, b, n); filters: (shard, path) of files in the shared folder; over: keys at the limit or above."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    over: int
    min_docs: int


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text as bytes, and a 16-byte hash for each (none for keys without code points)."""
    raw = (text or "").encode()
    digest = xxhash.xxh3_128_digest
    keys = [x.strip(SPACE) for x in raw.translate(_LOWER).split(b"\n")]
    return raw.split(b"\n"), [digest(k) if k else b"" for k in keys]


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _counted(docs: DataFrame, text: str, groups: DataFrame | None = None, least: int = MIN_DOCS) -> DataFrame:
    """(a, b, n): the number of documents with each key.

    With ``groups``, a table (th, component) of each text's hash and its group of
    copies, keys of ``least`` documents or more are left out if these are fewer
    than ``least`` groups.
    """
    small_batches(docs.sparkSession)
    hashed = groups is not None

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found, th = [], []
            for t in batch.column(0).to_pylist():
                own = {d for d in line_keys(t)[1] if d}
                found += own
                th += [xxhash.xxh64_intdigest(t or "", TEXT_SEED) if hashed else 0] * len(own)
            a, b = _pairs(found)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.array(th, np.uint64).view(np.int64))], ["a", "b", "th"])

    keys = docs.select(text).mapInArrow(rows, "a bigint, b bigint, th bigint")
    if groups is None:
        return keys.groupBy("a", "b").agg(F.count("*").alias("n"))
    n = written(keys.groupBy("a", "b").agg(F.count("*").alias("n")), "line_rows")
    over = n.where(F.col("n") >= least)
    total = over.agg(F.sum("n")).first()[0] or 0
    # Each text once for a key, so a text with many copies is in no more rows than it has lines.
    texts = join_by_count(keys, over, ["a", "b"], "n", total).select("a", "b", "th").distinct()
    of = texts.join(groups, "th").select("a", "b", "component").distinct().groupBy("a", "b").agg(F.count("*").alias("groups"))
    few = of.where(F.col("groups") < least).select("a", "b")
    return n.join(few, ["a", "b"], "left_anti")


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("a", 32), F.lit(shards)).cast("int")


def _save(root: str, shard: int, f: CuckooFilter) -> str:
    fs, at = pafs.FileSystem.from_uri(root)
    fs.create_dir(at, recursive=True)
    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.cuckoo"
    with fs.open_output_stream(f"{at}/{name}") as out:
        out.write(f.dump())
    return f"{root}/{name}"


def _read(path: str) -> CuckooFilter:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return CuckooFilter.load(f.read())


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    """A filter file for each shard that has keys, which number about SHARD_KEYS at most."""
    root = scratch(keys.sparkSession, "filters")

    def build(key, pdf):
        import pandas as pd

        k = int(key[0])
        f = CuckooFilter.of(pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [k], "path": [_save(root, k, f)]})

    return written(keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, path string"), "filter_files")


def build_state(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, groups: DataFrame | None = None) -> LineState:
    """The state of ``docs``. One built with ``groups`` lacks keys and can't be updated."""
    counts = written(_counted(docs, text, groups, min_docs), "line_counts")
    over = counts.where(F.col("n") >= min_docs)
    n = over.count()
    shards = max(1, -(-n // SHARD_KEYS))
    return LineState(counts, _filters(over.select("a", "b"), shards), shards, n, min_docs)


def update_state(state: LineState, docs: DataFrame, sign: int = 1, text: str = "text") -> LineState:
    """The state after documents were added (sign 1) or removed (sign -1)."""
    delta = _counted(docs, text).select("a", "b", (F.col("n") * sign).alias("d"))
    both = written(state.counts.join(delta, ["a", "b"], "full").select("a", "b", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")), "line_counts")
    m = state.min_docs
    over = both.where(F.col("n") >= m).count()
    counts = both.where("n > 0").select("a", "b", "n")
    if -(-over // SHARD_KEYS) > state.shards:  # more shards: all filters anew, from the exact counts
        shards = -(-over // SHARD_KEYS)
        return LineState(counts, _filters(counts.where(F.col("n") >= m).select("a", "b"), shards), shards, over, m)
    crossed = both.where((F.col("was") >= m) != (F.col("n") >= m)).select("a", "b", (F.col("n") >= m).alias("up")).withColumn("shard", _shard(state.shards))
    root = scratch(docs.sparkSession, "filters")

    def merge(key, files, keys):
        import pandas as pd

        k = int(key[0])
        f = _read(files["path"].iloc[0]) if len(files) else CuckooFilter(len(keys))
        if len(keys):
            a, b, up = keys["a"].to_numpy().view(np.uint64), keys["b"].to_numpy().view(np.uint64), keys["up"].to_numpy(bool)
            f.delete(a[~up], b[~up])
            if not f.insert(a[up], b[up]):
                return pd.DataFrame({"shard": [k], "path": [""]})
        elif len(files):
            return files[["shard", "path"]]
        return pd.DataFrame({"shard": [k], "path": [_save(root, k, f)]})

    files = written(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(merge, "shard int, path string"), "filter_files")
    full = files.where("path = ''").select("shard")
    if full.count():  # too full to take more: those shards anew, from the exact counts
        keys = counts.where(F.col("n") >= m).withColumn("shard", _shard(state.shards)).join(full, "shard", "left_semi").select("a", "b")
        files = files.where("path <> ''").unionByName(_filters(keys, state.shards))
    return LineState(counts, files, state.shards, over, m)


def _clean(batch, column: str, keep: list[str], dropped_of):
    """The batch with its text cleaned; dropped_of gives the digests to drop for a row."""
    import pyarrow as pa

    texts = batch.column(column).to_pylist()
    out, n_lines, n_dropped = [], [], []
    cut = [line_keys(t) for t in texts]
    drops = dropped_of([d for _, d in cut])
    for (lines, digests), drop in zip(cut, drops, strict=True):
        kept = [x for x, d in zip(lines, digests, strict=True) if d not in drop] if drop else lines
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
        out.append(b"\n".join(kept).decode())
    cols = [pa.array(out, pa.string()) if c == column else batch.column(c) for c in keep]
    return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*keep, "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, state: LineState, text: str = "text") -> DataFrame:
    """``docs`` without the lines over the limit, with n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")])
    keep = kept.columns
    schema = schema_of(kept, "n_lines bigint, n_dropped bigint")
    over = state.counts.where(F.col("n") >= state.min_docs)
    if state.over <= LOCAL_KEYS:
        keys = over.select("a", "b").toArrow()
        exact = {x.tobytes() for x in np.stack([keys.column(c).to_numpy().astype(np.int64) for c in ("a", "b")], axis=1)}
        files = {r.shard: _read(r.path).dump() for r in state.filters.collect()}
        shared, shards = spark.sparkContext.broadcast((exact, files)), state.shards

        def local(batches):
            known, raw = shared.value
            filters = {k: CuckooFilter.load(f) for k, f in raw.items()}

            def drops(rows):
                flat = [d for r in rows for d in r if d]
                a, b = _pairs(flat)
                shard = (a >> np.uint64(32)) % np.uint64(shards)
                may = np.zeros(len(flat), bool)
                for k, f in filters.items():
                    own = shard == k
                    may[own] = f.contains(a[own], b[own])
                some = {flat[i] for i in np.flatnonzero(may).tolist()} & known
                return [some.intersection(r) for r in rows] if some else [()] * len(rows)

            for b in batches:
                yield _clean(b, text, keep, drops)

        return kept.mapInArrow(local, schema)

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(r, d) for r, t in enumerate(batch.column(text).to_pylist()) for d in set(line_keys(t)[1]) if d]
            th = [xxhash.xxh3_128_digest(t or "") for t in batch.column(text).to_pylist()]
            a, b = _pairs([d for _, d in rows])
            t1, t2 = _pairs([th[r] for r, _ in rows])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, t1, t2)], ["a", "b", "t1", "t2"])

    # Texts that are equal lose equal lines, so a text's hash names it here.
    lines = kept.select(text).mapInArrow(explode, "a bigint, b bigint, t1 bigint, t2 bigint").withColumn("shard", _shard(state.shards))
    paths = spark.sparkContext.broadcast({r.shard: r.path for r in state.filters.collect()})

    def probe(batches):
        import pyarrow as pa

        at, f = None, None
        for batch in batches:
            a, b, shard = (batch.column(i).to_numpy() for i in (0, 1, 4))
            ok = np.zeros(len(a), bool)
            for k in np.unique(shard):
                if k != at:
                    at, f = k, _read(paths.value[int(k)]) if int(k) in paths.value else None
                if f is not None:
                    own = shard == k
                    ok[own] = f.contains(a[own].view(np.uint64), b[own].view(np.uint64))
            yield batch.filter(pa.array(ok))

    spread = lines.repartition(parallel(spark), "shard", F.pmod("t1", F.lit(max(1, parallel(spark) // state.shards)))).sortWithinPartitions("shard")
    may = written(spread.mapInArrow(probe, lines.schema).drop("shard"), "may_drop")
    total = over.agg(F.sum("n")).first()[0] or 0
    hits = join_by_count(may, over, ["a", "b"], "n", total).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("__drop"))

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            t1, t2 = _pairs([xxhash.xxh3_128_digest(t or "") for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64))], [*keep, h1, h2])

    h1, h2, drop = (own_name(x, kept) for x in ("__t1", "__t2", "__drop"))
    named = kept.mapInArrow(hashed, schema_of(kept, f"`{h1}` bigint, `{h2}` bigint"))
    joined = named.join(hits, (named[h1] == hits["t1"]) & (named[h2] == hits["t2"]), "left").select(*[named[c] for c in keep], hits["__drop"].alias(drop))

    def apply(batches):
        for b in batches:
            lists = b.column(drop).to_pylist()
            sets = [{np.array([x["a"], x["b"]], "<i8").tobytes() for x in d or ()} for d in lists]
            yield _clean(b, text, keep, lambda rows, sets=sets: sets)

    return joined.mapInArrow(apply, schema)


def grown_state(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> LineState:
    """The state of ``docs``, built from some of them, with others added and some that came twice taken out again.

    It is what ``build_state`` gives, reached as a corpus that grows and shrinks would: the filters take insertions and
    deletions. Quarters are by a hash of the text, so any table, ids or none, can be dealt so.
    """
    quarter = F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col(text), F.lit(""))), F.lit(4))
    of = lambda *k: docs.where(quarter.isin(*k))
    state = build_state(of(0, 1, 2), text, min_docs)
    state = update_state(state, of(3).unionByName(of(0)), 1, text)
    return update_state(state, of(0), -1, text)


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, groups: DataFrame | None = None) -> DataFrame:
    """``drop_lines`` by the state of the documents themselves; ``groups`` as in ``_counted``."""
    return drop_lines(docs, build_state(docs, text, min_docs, groups), text)
