"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards of about SHARD_BYTES and builds, for
each, a word suffix array by prefix doubling, sorted to DEPTH words. Every
suffix of every benchmark item is located in it by binary search, one word
deeper at a time. A window that occurs is checked byte for byte; windows on one
diagonal join to the longest verbatim matches, with their places.

No document is shuffled. A match never crosses documents (a sentinel word stands
between them); a document longer than a shard is cut, and each piece starts with
the last WINDOW - 1 words of the one before, so memory is bounded by a shard and
the longest word. Arrays last for one shard of one batch: they are used once.

The benchmark's size is summed first. If its text has at most BLOCK_BYTES it is
broadcast. A larger one is cut into pieces by the executors, written to the
shared folder in blocks of about half of BLOCK_BYTES, and the documents go
through one pass for each block, with what they have found so far; the driver
and a worker hold one block at a time.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
A window has WINDOW words; an item with fewer (not none) is one window.

Defined results: a null text has no words and no hits; items without words
occur nowhere; a null item_id is written ``null``; items with one id count
once; matches that tie are all given, in order; repeated documents give repeated
results; an empty table on either side gives no hits; n_words, n_hit, items and
matches replace columns of their name and all others pass through, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, schema_of, small_batches, written

WINDOW = 13
DEPTH = 16
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.zeros(256, np.uint8)
LOWER[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    LOWER[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    LOWER[_c] = _c + 32

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, wrapping at 64 bits."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


class Words:
    """The words of a byte string: where they start and end, and a 64-bit hash of each."""

    def __init__(self, raw: bytes):
        self.low = low = LOWER[np.frombuffer(raw, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (low != 0).view(np.int8), [0]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        if len(low):
            up, down = _powers(len(low) + 1)
            sums = np.empty(len(low) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(low * up[: len(low)], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.hash = h ^ (self.end - self.start).astype(np.uint64)
        else:
            self.hash = np.zeros(0, np.uint64)
        self.raw = low.tobytes()

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int, n: int) -> bytes:
        raw, start, end = self.raw, self.start, self.end
        return b" ".join([raw[start[k] : end[k]] for k in range(i, i + n)])


class Items:
    """A block of benchmark items: their windows, each once, and which items have them where."""

    def __init__(self, items: list[tuple[str, int, bool, bytes]]):
        """``items``: (item, words of the item before these bytes, whether they are all of it, bytes)."""
        seen: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.length: list[int] = []
        self.uses: list[list[tuple[str, int]]] = []
        hashes = []
        for item, before, whole, raw in items:
            w = Words(raw)
            n = min(WINDOW, len(w)) if whole else WINDOW
            for i in range(len(w) - n + 1 if n else 0):
                key = w.text(i, n)
                if key not in seen:
                    seen[key] = len(self.text)
                    self.text.append(key)
                    self.length.append(n)
                    self.uses.append([])
                    hashes.append(np.concatenate([w.hash[i : i + n], np.zeros(WINDOW - n, np.uint64)]))
                self.uses[seen[key]].append((item, before + i))
        self.hash = np.array(hashes, np.uint64).reshape(-1, WINDOW)
        self.size = np.array(self.length, np.int64)


class SuffixArray:
    """Suffixes of a sequence of word hashes (0: a sentinel), sorted by their first DEPTH words."""

    def __init__(self, hashes: np.ndarray):
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        self.rank = rank = rank.astype(np.int64) + 1
        n, step = len(rank), 1
        key, order = rank, None
        while step < DEPTH and n:
            high = int(key.max()) + 1
            after = np.zeros(n, np.int64)
            after[: n - step] = key[step:]
            pair = key * high + after
            order = np.argsort(pair, kind="quicksort")
            got = pair[order]
            new = np.concatenate([[1], (got[1:] != got[:-1]).astype(np.int64)])
            key = np.empty(n, np.int64)
            key[order] = np.cumsum(new)
            step *= 2
            if int(key.max()) == n:
                break
        self.order = np.zeros(0, np.int64) if order is None else order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(self.vocabulary) + 1))]) if n else np.zeros(2, np.int64)

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of hashes, the range of suffixes that start with its first ``sizes`` words."""
        m = len(hashes)
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if not m or not len(self.order):
            return lo, hi
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        rank = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        depth = np.arange(hashes.shape[1])
        live = np.flatnonzero(((rank > 0) | (depth >= sizes[:, None])).all(1) & (sizes > 0))
        lo[live], hi[live] = self.first[rank[live, 0]], self.first[rank[live, 0] + 1]
        n = len(self.order)
        for d in range(1, hashes.shape[1]):
            live = live[(sizes[live] > d) & (hi[live] > lo[live])]
            if not len(live):
                break
            want = rank[live, d]

            def word(i, d=d):
                p = self.order[i] + d
                return np.where(p < n, self.rank[np.minimum(p, n - 1)], 0)

            new = []
            for right in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    x = word(np.minimum(mid, n - 1))
                    down = (x <= want) if right else (x < want)
                    a = np.where(open_ & down, mid + 1, a)
                    b = np.where(open_ & ~down, mid, b)
                new.append(a)
            lo[live], hi[live] = new
        return lo, hi


_BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _pieces(raw: bytes, most: int):
    """(bytes, words before them): a long text cut between words; each piece but the first starts with the last WINDOW - 1 words before it."""
    at = done = 0
    carry, carried = b"", 0
    while True:
        cut = _BETWEEN.search(raw, min(at + most, len(raw)))
        end = cut.start() if cut else len(raw)
        piece = carry + b" " + raw[at:end] if carried else raw[at:end]
        yield piece, done - carried
        if end == len(raw):
            return
        w = Words(piece)
        done += len(w) - carried
        carried = min(WINDOW - 1, len(w))
        carry, at = w.text(len(w) - carried, carried), end


def _search(units: list[tuple[int, int, bytes]], items: Items, found: list[dict]) -> None:
    """Build one shard's suffix array over ``units`` (document, word offset, bytes) and add to ``found`` what occurs."""
    words = [Words(raw) for _, _, raw in units]
    lengths = np.array([len(w) + 1 for w in words])
    at = np.concatenate([[0], np.cumsum(lengths)])
    hashes = np.zeros(int(at[-1]), np.uint64)
    for w, a in zip(words, at, strict=False):
        hashes[a : a + len(w)] = w.hash
    for (doc, offset, _), w in zip(units, words, strict=True):
        found[doc]["n"] = max(found[doc]["n"], offset + len(w))
    sa = SuffixArray(hashes)
    lo, hi = sa.find(items.hash, items.size)
    for k in np.flatnonzero(hi > lo):
        places = sa.order[lo[k] : hi[k]]
        unit = np.searchsorted(at, places, "right") - 1
        want, n = items.text[k], items.length[k]
        for p, u in zip(places.tolist(), unit.tolist(), strict=True):
            i = p - int(at[u])
            if i + n <= len(words[u]) and words[u].text(i, n) == want:
                doc, offset, _ = units[u]
                found[doc]["hits"].append((offset + i, int(k)))


def _result(f: dict, items: Items) -> dict:
    mask = np.zeros(f["n"] + 1, np.int64)
    diagonals: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for i, k in set(f["hits"]):
        mask[i] += 1
        mask[i + items.length[k]] -= 1
        for item, j in items.uses[k]:
            diagonals.setdefault((item, i - j), []).append((i, items.length[k]))
    matches = []
    for (item, shift), runs in diagonals.items():
        runs.sort()
        start, end = runs[0][0], sum(runs[0])
        for i, n in runs[1:]:
            if i > end - n + 1:
                matches.append((item, start, start - shift, end - start))
                start = i
            end = i + n
        matches.append((item, start, start - shift, end - start))
    return {"n_words": f["n"], "hit": np.flatnonzero(np.cumsum(mask)[:-1] > 0), "items": sorted({m[0] for m in matches}), "matches": sorted(matches)}


NAMES = ("n_words", "n_hit", "items", "matches")
MADE = "n_words bigint, n_hit bigint, items array<string>, matches array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


def item_pieces(benchmark: DataFrame, item_id: str, text: str, most: int) -> DataFrame:
    """(item, before, whole, raw): the items' texts, long ones in pieces of about ``most`` bytes."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(text, F.lit("")).alias("t"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for item, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                cuts = list(_pieces(t.encode(), most))
                if len(cuts) == 1 or cuts[-1][1] + len(Words(cuts[-1][0])) < WINDOW:
                    out.append((item, 0, True, t.encode()))
                else:
                    out += [(item, before, False, raw) for raw, before in cuts]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["item", "before", "whole", "raw"])

    return rows.mapInArrow(cut, "item string, before bigint, whole boolean, raw binary")


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int):
    """Lists of (item, before, whole, raw), each of about ``most`` bytes at most, one after the other."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pieces = item_pieces(benchmark, item_id, text, max(1 << 10, most // 4))
    take = lambda df: [(r.item, r.before, r.whole, bytes(r.raw)) for r in df.collect()]
    if total <= most:
        yield take(pieces)
        return
    n = -(-2 * total // most)
    table = written(pieces.withColumn("block", F.pmod(F.xxhash64("item", "before"), F.lit(n))).repartition("block"), "benchmark")
    for k in range(n):
        yield take(table.where(F.col("block") == k).drop("block"))


def _pass(docs: DataFrame, block: list, text: str, shard_bytes: int, first: bool, hit: str) -> DataFrame:
    """``docs`` with what one block of the benchmark finds, added to what others found."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)
    own = docs.select(*[c for c in docs.columns if c not in (*NAMES, hit) or c == text]) if first else docs
    keep = [c for c in own.columns if c not in NAMES and c != hit]
    schema = schema_of(own.select(*keep), f"{MADE}, `{hit}` array<bigint>")

    def rows(batches):
        import pyarrow as pa

        items = Items(shared.value)
        kind = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
        for b in batches:
            texts = [(x or "").encode() for x in b.column(text).to_pylist()]
            found = [{"n": 0, "hits": []} for _ in texts]
            units, size = [], 0
            for d, raw in enumerate(texts):
                for piece, offset in _pieces(raw, shard_bytes):
                    if units and size + len(piece) > shard_bytes:
                        _search(units, items, found)
                        units, size = [], 0
                    units.append((d, offset, piece))
                    size += len(piece) + 1
            if units:
                _search(units, items, found)
            done = [_result(f, items) for f in found]
            if not first:
                was = [b.column(c).to_pylist() for c in ("items", "matches", hit)]
                for r, i, m, h in zip(done, *was, strict=True):
                    r["items"] = sorted({*r["items"], *i})
                    r["matches"] = _joined([*r["matches"], *[tuple(x.values()) for x in m]])
                    r["hit"] = np.union1d(r["hit"], np.array(h, np.int64))
            cols = [b.column(c) for c in keep]
            cols += [pa.array([r["n_words"] for r in done], pa.int64()), pa.array([len(r["hit"]) for r in done], pa.int64()), pa.array([r["items"] for r in done], pa.list_(pa.string()))]
            cols += [pa.array([[dict(zip(("item_id", "doc_word", "item_word", "n_words"), m, strict=True)) for m in r["matches"]] for r in done], pa.list_(kind)), pa.array([r["hit"] for r in done], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *NAMES, hit])

    return own.mapInArrow(rows, schema)


def _joined(matches: list[tuple]) -> list[tuple]:
    """Matches of which those that meet on one diagonal, as pieces of an item may give, are one."""
    out: list[tuple] = []
    for item, _, start, i, n in sorted((m[0], m[1] - m[2], m[1], m[2], m[3]) for m in matches):
        if out and out[-1][0] == item and out[-1][1] - out[-1][2] == start - i and start <= out[-1][1] + out[-1][3] - WINDOW + 1:
            last = out.pop()
            out.append((*last[:3], max(last[3], start + n - last[1])))
        else:
            out.append((item, start, i, n))
    return sorted(out)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids with occurring windows), and matches (maximal verbatim runs)."""
    small_batches(docs.sparkSession)
    hit = own_name("__hit", docs)
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        # Beyond the first block, what has been found is kept in the shared folder.
        out = _pass(docs, block, text, shard_bytes, True, hit) if out is None else _pass(written(out, "decontaminated"), block, text, shard_bytes, False, hit)
    return out.drop(hit)


def contaminated():
    """The rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
