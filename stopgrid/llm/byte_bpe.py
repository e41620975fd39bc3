"""Byte-level BPE in two tiers.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash over the vocabulary: one hash, one displacement, one comparison of bytes.
The others are merged with a heap of pairs over doubly linked bytes, lowest
rank first, leftmost first among equals, as rank files ask for.

The vocabulary is a file of at most some megabytes, which each Python worker
loads from its path once. What a worker keeps of pre-tokens it has resolved is
bounded by CACHE_WORDS.

Defined results: a null text is empty and has no ids; repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import small_batches

CACHE_WORDS = 200_000


MASK = (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ d * 0x9E3779B97F4A7C15 & MASK) * 0xBF58476D1CE4E5B9 & MASK
    return (x ^ x >> 31) % n


class PerfectHash:
    """A minimal perfect hash by displacement: n keys, n slots.

    Keys fall into buckets; from the largest bucket down, each gets the first
    displacement that sends all its keys to free slots.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        self.slot_key: list[bytes] = [b""] * n
        self.slot_at = [-1] * n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        for b in sorted(groups, key=lambda x: (-len(groups[x]), x)):
            own, d = groups[b], 0
            while True:
                spots = [_slot(h, d, n) for h, _ in own]
                if len(set(spots)) == len(spots) and all(self.slot_at[s] < 0 for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(spots, own, strict=True):
                self.slot_key[s], self.slot_at[s] = keys[i], i

    def get(self, key: bytes) -> int:
        """The key's position, or -1."""
        h = xxhash.xxh64_intdigest(key)
        s = _slot(h, self.shift[h % self.buckets], self.n)
        return self.slot_at[s] if self.slot_key[s] == key else -1


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.bytes_of = {i: t for t, i in pairs}
        self.ids = [i for _, i in pairs]
        self.hash = PerfectHash([t for t, _ in pairs])
        ranks = dict(pairs)
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        # The rank file ranks concatenations: a pair merges if its bytes together are a token.
        self.merge = {}
        for t, i in pairs:
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.merge[a << 32 | b] = i
        self.find = regex.compile(pattern).findall
        self.young, self.old = {}, {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merges: a heap of (rank, place) over linked bytes."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merge = self.merge.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank = [-1] * n  # of the pair that starts here, as it is now
        heap = []
        for i in range(n - 1):
            r = merge(ids[i] << 32 | ids[i + 1])
            if r is not None:
                rank[i] = r
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if rank[i] != r:
                continue  # one of its two was merged meanwhile
            j = after[i]
            k = after[j]
            ids[i], rank[j], after[i] = r, -1, k
            ids[j] = -1
            rank[i] = -1
            if k < n:
                before[k] = i
                q = merge(r << 32 | ids[k])
                if q is not None:
                    rank[i] = q
                    heapq.heappush(heap, q << 32 | i)
            p = before[i]
            if p >= 0:
                q = merge(ids[p] << 32 | r)
                rank[p] = -1 if q is None else q
                if q is not None:
                    heapq.heappush(heap, q << 32 | p)
        return [x for x in ids if x >= 0]

    def resolve(self, word: str) -> bytes:
        raw = word.encode()
        at = self.hash.get(raw)
        return np.array([self.ids[at]] if at >= 0 else self.merged(raw), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        parts = self.find(text)
        long = {}
        for w in [w for w in set(parts) if w not in young]:
            ids = old.get(w) or self.resolve(w)
            if len(w) > 64:
                long[w] = ids
            else:
                young[w] = ids
        return b"".join([young[w] if w in young else long[w] for w in parts] if long else [young[w] for w in parts])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids (binary, little-endian unsigned 32-bit) and n_tokens."""
    return _mapped(docs, path, pattern, text, "token_ids binary, n_tokens bigint", lambda tok, t: (ids := tok.encode(t), len(ids) // 4))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for."""
    return _mapped(docs, path, pattern, ids, f"{out} binary", lambda tok, b: (tok.decode(b),), empty=b"")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: an encoding and its decoding in one pass, without the ids."""

    def both(tok: ByteBpe, t: str):
        ids = tok.encode(t)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids)).hexdigest()

    return _mapped(docs, path, pattern, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", both)


def _mapped(docs: DataFrame, path: str, pattern: str, col: str, made: str, f, empty: str | bytes = "") -> DataFrame:
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in made.split(", ")]
    kept = docs.select(*[c for c in docs.columns if c not in names or c == col])
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema if x.name not in names] + made.split(", "))
    keep = [c for c in kept.columns if c not in names]

    def rows(batches):
        import pyarrow as pa

        tok = tokenizer(path, pattern)
        for b in batches:
            got = [f(tok, empty if x is None else x) for x in b.column(col).to_pylist()]
            cols = [b.column(c) for c in keep]
            kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
            cols += [pa.array([g[i] for g in got], kinds[m.split()[1]]) for i, m in enumerate(made.split(", "))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *names])

    return kept.mapInArrow(rows, schema)
