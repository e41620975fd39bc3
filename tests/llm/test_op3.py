import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_fixtures import documents, saved, table

from stopgrid.llm import simhash
from stopgrid.llm.queries import op3_simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(rows, fps):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [least.get(find(i)) for i in range(len(rows))]


def test_op3_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = documents(60)
    long = " ".join(f"w{r.randint(0, 900)}" for _ in range(600)).split()
    for k in range(60):
        w = list(long)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"c{r.randint(0, 99)}"
        rows.append((7000 + k, " ".join(w), "en", "s", 0))
    rows += [(8000 + i, f"two w{i}" if i % 2 else "", "en", "s", 0) for i in range(20)]
    fps = [fingerprint(r[1]) for r in rows]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, components(rows, fps), strict=True))
    assert Counter(tuple(x) for x in op3_simhash(spark, saved(spark, tmp_path, rows)).collect()) == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [4096, 10])
@pytest.mark.parametrize("most", [1 << 20, 1])
def test_links_span_the_components(spark, monkeypatch, cell, most):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "AGREE", ((most, 3),))
    r = random.Random(1)
    fps = {0, (1 << 64) - 1}
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(sign(f), [sign(f)]) for f in fps], "node bigint, fps array<bigint>")
    got = [(e.a & (1 << 64) - 1, e.b & (1 << 64) - 1) for e in simhash.links(nodes, 3).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)

    def parts(edges):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {f: find(f) for f in fps}

    assert parts(got) == parts([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])


def test_large_groups_give_forests():
    key = np.zeros(300, np.int64)
    fp = np.arange(300, dtype=np.uint64)
    a, b = simhash.links_in_cells(key, fp, fp.view(np.int64), 3)
    assert len(a) <= 299 and np.all(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 3)


def test_many_fingerprints(spark):
    rows = [(i, " ".join(f"w{(k * 7919) % 1000 if k != i * 3 else i}" for k in range(400)), "en", "s", 0) for i in range(10)] + [(99, "quite another text here", "en", "s", 0)]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), shingle=5, number=8).collect()}
    assert out[99] == 99 and Counter(out.values())[0] == 10


def test_cells_split_by_bits_lose_no_link_and_meet_seldom_by_chance(spark, monkeypatch):
    r = random.Random(8)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for i in range(60):
        fps = [r.getrandbits(64) for _ in range(4)]
        rows += [fps, [r.getrandbits(64) if j != i % 4 else x ^ (1 << r.randrange(64) | 1 << r.randrange(64) | 1 << r.randrange(64)) for j, x in enumerate(fps)]]
    want = {(2 * i, 2 * i + 1) for i in range(60)}
    rows += [[r.getrandbits(64) for _ in range(4)] for _ in range(4000)]
    nodes = spark.createDataFrame([(i, [sign(x) for x in f]) for i, f in enumerate(rows)], "node bigint, fps array<bigint>").cache()
    for most in (1 << 20, 0):
        monkeypatch.setattr(simhash, "AGREE", ((most, 3),))
        assert {tuple(sorted((e.a, e.b))) for e in simhash.links(nodes, 3, True).collect()} == want
    met = [simhash.grid(nodes, 3, 3, split).groupBy("cell").count().where("count > 1").agg({"count": "sum"}).first()[0] for split in (False, True)]
    assert met[0] > 200 and met[1] < 1200 and met[1] < met[0] - 100


def test_links_of_a_batch_are_a_forest():
    r = np.random.default_rng(3)
    fp = r.integers(0, 8, 40).astype(np.uint64)
    node = np.arange(40)
    # The same forty nodes in three cells: all pairs are near.
    key = np.repeat(np.arange(3), 40)
    a, b = simhash.spanning(*simhash.links_in_cells(key, np.tile(fp, 3), np.tile(node, 3), 3))
    assert len(a) == 39 and {*a.tolist(), *b.tolist()} == set(range(40))
    assert [len(x) for x in simhash.spanning(a[:0], b[:0])] == [0, 0]
