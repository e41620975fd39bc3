import random
from collections import Counter

import corpus_pipeline as C
from llm_fixtures import documents, saved, table
from test_op2_op6 import brute_verdicts
from test_op5 import keys
from test_op9 import brute as contaminated

from stopgrid.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(r, n):
    return " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 4000)}" for _ in range(n))


def corpus():
    r = random.Random(12)
    rows = [(100 + i, "\n".join(prose(r, 30) for _ in range(r.randint(3, 8))), "en", f"src{i % 3}", 0) for i in range(60)]
    rows = [(d, t + ("\nAll rights reserved" if d % 2 else ""), a, b, c) for d, t, a, b, c in rows]
    base = rows[0][1]
    for i in range(30):  # a group of near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = "edited"
        rows.append((1000 + i, " ".join(w), "en", f"mirror{i % 5}", 0))
    rows += [(2000 + i, rows[5][1], "en", "src1", 0) for i in range(15)]  # and of exact ones
    items = [(i, prose(r, 40)) for i in range(4)]
    rows += [(3000 + i, prose(r, 100) + "\n" + items[i][1], "en", "src2", 0) for i in range(4)]
    rows += [(3100, prose(r, 2000) + " " + " ".join(items[0][1].split()[:15]), "en", "src2", 0)]  # too little to matter
    return rows + documents(10), items


def groups_of(texts):
    """A number for each text: those linked by a fingerprint or by sets of shingles, through any others, have the same."""
    fps = [simhash.fingerprints(t, 5, 8) for t in texts]
    split = [(t or "").translate(LOW).split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            near = any(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True))
            if near or sets[i] == sets[j] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def brute(rows, items):
    rows = [(r[0], v[3], *r[2:]) for r, v in zip(rows, brute_verdicts(rows, 0.05, 10, 0.2), strict=True) if v[4]]
    of = groups_of([r[1] for r in rows])
    n, held = Counter(), {}
    for r, g in zip(rows, of, strict=True):
        for k in {k for k in keys(r[1]) if k}:
            n[k] += 1
            held.setdefault(k, set()).add(g)
    drop = {k for k in n if n[k] >= 10 and len(held[k]) >= 10}
    rows = [(r[0], "\n".join(x for x, k in zip((r[1] or "").split("\n"), keys(r[1]), strict=True) if k not in drop), *r[2:]) for r in rows]
    best = {}
    import xxhash

    for i, (r, g) in enumerate(zip(rows, groups_of([r[1] for r in rows]), strict=True)):
        h = xxhash.xxh64_intdigest(r[1], 42)
        key = (r[0] is None, r[0] or 0, h - (1 << 64) * (h >> 63), i)
        best[g] = min(best.get(g, key), key)
    rows = [rows[k[3]] for k in best.values()]
    return [r for r in rows if not contaminated(r[1], items)[4]]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    d = saved(spark, tmp_path, rows, benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    out = C.run(spark, d)
    got = out.collect()
    want = brute(rows, items)
    assert out.columns == [*COLUMNS, "token_ids", "n_tokens"]
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in want)
    ids = {r.doc_id for r in got}
    assert 3100 in ids and not ids & set(range(3000, 3004)) and not ids & set(range(2000, 2015))
    assert len(ids & {100, *range(1000, 1030)}) == 1
    assert not any("All rights reserved" in r.text for r in got)
    from public_tokenizers import PATTERN, path

    from stopgrid.llm.byte_bpe import tokenizer

    tok = tokenizer(path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    for r in got:
        assert r.n_tokens == len(r.token_ids) // 4 and tok.decode(bytes(r.token_ids)).decode() == r.text


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    d = saved(spark, tmp_path, [], benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, f in C.STAGES:
        out = f(spark, docs, d)
        assert out.count() == 0 and (out.columns == COLUMNS or name == "byte_bpe")
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]


def test_stages_keep_clashing_columns_nulls_and_long_texts(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, prose(r, 80), "en", None if i % 2 else "s", 0) for i in range(6)] + [(None, prose(r, 90), None, None, None), (50, None, "en", "s", 0), (51, "", "en", "s", 0), (60, prose(r, 200_000), "en", "s", 0)]
    d = saved(spark, tmp_path, [], benchmark=spark.createDataFrame([(1, prose(r, 20)), (None, None)], "item_id bigint, text string"))
    clash = {c: f"my {c}" for c in ("kept", "n_words", "kept_text", "n_lines", "items", "matches", "hit", "__h", "th", "component", "token_ids")}
    docs = table(spark, rows + rows[:1], **clash)
    for _, f in C.STAGES[:-1]:
        docs = C.written(f(spark, docs, d), "stage")
        assert docs.columns == [*COLUMNS, *clash]
    out = docs.collect()
    assert Counter(x.doc_id for x in out) == Counter([*range(6), None, 60])
    assert all(x[c] == v for x in out for c, v in clash.items()) and max(len(x.text) for x in out) > 900_000
    assert C.byte_bpe(spark, docs, d).columns == [c for c in docs.columns if c != "token_ids"] + ["token_ids", "n_tokens"]
