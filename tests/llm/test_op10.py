import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_fixtures import documents, saved, table

from stopgrid.llm import suffix_dedup as S
from stopgrid.llm.queries import op10_suffix_dedup


def brute(rows, length):
    """By a table of all strings: the first place of each, in order of id (null first), text hash, start."""
    docs = {(r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1] or "", 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1] or "", 42) >> 63)): (r[1] or "").encode() for r in rows}
    first, bad = {}, {}
    for key in sorted(docs):
        b = docs[key]
        mask = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i : i + length], (key, i)) != (key, i):
                mask[i] += 1
                mask[i + length] -= 1
        bad[key] = np.cumsum(mask)[:-1] > 0
    out = Counter()
    for r in rows:
        h = xxhash.xxh64_intdigest(r[1] or "", 42)
        key = (r[0] is not None, r[0] or 0, h - (1 << 64) * (h >> 63))
        b, m = docs[key], bad[key]
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out[(r[0], len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


def rows_():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(10, 80))) for _ in range(6)]
    rows = [x for x in documents(25) if x[0] not in (1006, 1007)]
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        rows.append((6000 + r.randint(0, 50), " ".join(parts), "en", "s", 0))
    rows += [(6100, "z" * 700, "en", "s", 0), (6101, "z" * 350 + "q" + "ab" * 200, "en", "s", 0), (6102, passages[0] * 3, "en", "s", 0), (None, passages[1] * 2, "en", "s", 0)]
    rows += [(-(1 << 62), passages[0], "en", "s", 0), *rows[-5:-3]]
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_op10_equals_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_LEAST", hot)
    monkeypatch.setattr(S, "HELD", 2000 if hot > 100 else 20)
    rows = rows_()
    assert Counter(tuple(r) for r in op10_suffix_dedup(spark, saved(spark, tmp_path, rows)).collect()) == brute(rows, 100)


@pytest.mark.parametrize("chunk", [1 << 21, 150])
def test_short_lengths(spark, monkeypatch, chunk):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S._units, "__defaults__", (chunk,))
    rows = rows_()
    out = S.remove_repeats(table(spark, rows, n_bytes=1, kept="x", d=5, t="t", spans="s", __d=1, __spans=2), length=21, gram=9)
    assert {(x.d, x.t, x.spans, x["__d"], x["__spans"]) for x in out.collect()} == {(5, "t", "s", 1, 2)}
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 21)


def test_runs_cover_each_string_once():
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(n)).encode() for n in (0, 50, 99, 100, 101, 400, 0, 1000, 3)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, last, place, _ = S.runs(raw, starts)
    got = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    assert got == [i for a, b in zip(starts[:-1], starts[1:], strict=True) for i in range(a, b - 99)]
    assert all(a <= p and p + S.GRAM <= a + S.LENGTH and b <= p for a, b, p in zip(first, last, place, strict=True))


def test_bitmap_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BITS", 7)
    h = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 500)
    got = S._bitmap(spark.createDataFrame([(int(x),) for x in h], "h bigint"), len(h))
    assert S._in(got, h.view(np.uint64)).all() and np.bitwise_count(got).sum() <= len(h)


def test_op10_empty(spark, tmp_path):
    assert op10_suffix_dedup(spark, saved(spark, tmp_path, [])).count() == 0
