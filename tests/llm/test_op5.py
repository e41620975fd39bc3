import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents, saved, table

from stopgrid.llm import line_dedup as L
from stopgrid.llm.queries import op5_line_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keys(t):
    return [x.strip(" \t\n\r\x0b\x0c").translate(LOW) for x in (t or "").split("\n")]


def brute(rows, least, counted=None):
    n = Counter(k for r in (counted or rows) for k in set(keys(r[1])) if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(r[1]), strict=True) if not k or n[k] < least]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def rows_(n=60):
    r = random.Random(8)
    common = ["All rights reserved", "  ALL rights reserved\r", "ä Zeile", "Ä Zeile", "x", "", "  ", "tab\tbed"]
    return documents(20) + [(9000 + i, "\n".join(r.choice([*common, f"own {i}", f"few {i % 7}"]) for _ in range(r.randint(1, 12))), "en", "s", 0) for i in range(n)]


@pytest.mark.parametrize("local", [250_000, 0])
@pytest.mark.parametrize("shard", [1 << 20, 3])
def test_op5_equals_brute_force(spark, tmp_path, monkeypatch, local, shard):
    monkeypatch.setattr(L, "LOCAL_KEYS", local)
    monkeypatch.setattr(L, "SHARD_KEYS", shard)
    rows = rows_()
    assert Counter(tuple(r) for r in op5_line_dedup(spark, saved(spark, tmp_path, rows)).collect()) == brute(rows, 10)


def test_state_is_reversible(spark):
    from pyspark.sql import functions as F

    a, b = rows_(60), [(r[0], r[1], r[2], r[3], r[4]) for r in rows_(90)[40:]]
    first = L.build_state(table(spark, a), min_docs=8)
    both = L.update_state(first, table(spark, b))
    digest = lambda s, rows: Counter(tuple(r) for r in L.drop_lines(table(spark, rows, n_lines=1), s).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())
    assert digest(both, a) == brute(a, 8, a + b)
    back = L.update_state(both, table(spark, b), -1)
    assert digest(back, a) == brute(a, 8, a)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, first.counts.collect()))
    over = lambda s: {r.shard: sorted(x for x in L._read(r.path).table.ravel().tolist() if x) for r in s.filters.collect()}
    assert over(back) == over(first)


def test_clashing_columns_and_long_texts(spark, monkeypatch):
    rows = [*rows_(30), (7000, "All rights reserved\nown line " * 80_000, "en", "s", 0)]
    for local in (250_000, 0):
        monkeypatch.setattr(L, "LOCAL_KEYS", local)
        out = L.dedup_lines(table(spark, rows, t1=1, t2="b", __t1=3, __drop="c", n_dropped=9)).collect()
        assert {(r.t1, r.t2, r["__t1"], r["__drop"]) for r in out} == {(1, "b", 3, "c")}
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out) == brute(rows, 10)


def test_grown_state_is_a_fresh_one(spark):
    rows = rows_(90)
    fresh, grown = L.build_state(table(spark, rows), min_docs=8), L.grown_state(table(spark, rows), min_docs=8)
    assert sorted(map(tuple, grown.counts.collect())) == sorted(map(tuple, fresh.counts.collect())) and grown.over == fresh.over


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    k = r.integers(0, 1 << 63, (4000, 2), dtype=np.uint64)
    f = L.CuckooFilter.of(k[:2000, 0], k[:2000, 1])
    assert f.contains(k[:2000, 0], k[:2000, 1]).all()
    assert f.contains(k[2000:, 0], k[2000:, 1]).mean() < 0.01
    f.delete(k[:1000, 0], k[:1000, 1])
    assert f.contains(k[1000:2000, 0], k[1000:2000, 1]).all() and f.contains(k[:1000, 0], k[:1000, 1]).mean() < 0.01
    g = L.CuckooFilter.load(f.dump())
    assert (g.table == f.table).all()


def test_op5_empty(spark, tmp_path):
    assert op5_line_dedup(spark, saved(spark, tmp_path, [])).count() == 0
