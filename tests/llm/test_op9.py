import hashlib
import random
import re
from collections import Counter

import pytest
from llm_fixtures import documents, saved, table

from stopgrid.llm import decontaminate
from stopgrid.llm.queries import op9_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                ids.add("null" if i is None else str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    r = random.Random(2)
    some = lambda n: " ".join(r.choice(["a", "b", "é", "x1", "Ünï", "stop", "NET"]) for _ in range(n))
    items = [(i, some(r.choice([1, 2, 5, 13, 14, 40]))) for i in range(2, 25)] + [(1, None), (30, ""), (31, "!!"), (None, some(20)), (2, some(15)), (32, "never occurring words " * 6)]
    rows = documents()
    for k in range(60):
        t = some(r.randint(0, 40)) + " " + (r.choice(items)[1] or "").replace(" ", r.choice([" ", "\n", "...", "--"])) + " " + some(r.randint(0, 200))
        rows.append((5000 + k, t if k % 2 else t.upper().replace("É", "é"), "en", "s", 0))
    return rows, items


@pytest.mark.parametrize("shard", [4 << 20, 300])
def test_op9_equals_brute_force(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter((d, *brute(t, items)) for d, t, *_ in rows)
    found = decontaminate.find_contamination(table(spark, rows, n_hit=1, items="x"), bench, shard_bytes=shard, block_bytes=1 << 23 if shard > 1000 else 1500)
    from pyspark.sql import functions as F

    got = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.contaminated())
    assert Counter(tuple(r) for r in got.collect()) == want
    out = op9_decontamination(spark, saved(spark, tmp_path, rows, benchmark=bench)).drop("longest_match")
    assert Counter(tuple(r) for r in out.collect()) == want


def test_matches_are_verbatim_and_maximal(spark):
    rows, items = cases()
    by = {}
    for i, t in items:
        by.setdefault("null" if i is None else str(i), []).append(words(t))
    for r in decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect():
        w = words(r.text)
        for m in r.matches:
            part = w[m.doc_word : m.doc_word + m.n_words]
            assert any(v[m.item_word : m.item_word + m.n_words] == part for v in by[m.item_id])


def test_op9_empty(spark, tmp_path):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in op9_decontamination(spark, saved(spark, tmp_path, documents(5), benchmark=none)).collect()] == [0] * len(documents(5))
    assert decontaminate.find_contamination(table(spark, []), none).count() == 0


def test_long_texts_keep_their_words_across_cuts():
    r = random.Random(4)
    parts = ["!" * 900, " ".join(f"w{i}" for i in range(8)), "." * 700, "x" * 800, " ".join(f"v{r.randint(0, 9)}" for _ in range(300)), "-" * 2000, "tail"]
    raw = " ".join(parts).encode()
    want = words(raw.decode())
    for most in (100, 333, 5000):
        seen = {}
        for piece, before in decontaminate._pieces(raw, most):
            w = decontaminate.Words(piece)
            for i in range(len(w)):
                assert seen.setdefault(before + i, w.text(i, 1).decode()) == w.text(i, 1).decode()
        assert [seen[i] for i in range(len(want))] == want and len(seen) == len(want)


def test_clashing_columns_pass(spark):
    rows, items = cases()
    out = decontaminate.find_contamination(table(spark, rows[:5], hit=7, __hit="x", n_hit="gone"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x.hit, x["__hit"]) for x in out.collect()} == {(7, "x")} and dict(out.dtypes)["n_hit"] == "bigint"
