import random

from llm_fixtures import table
from test_pipeline_stages import prose

from stopgrid.llm import simhash


def near_bits(a, b, number):
    return [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(simhash.fingerprints(a, 5, number), simhash.fingerprints(b, 5, number), strict=True)]


def test_copies_that_only_the_later_of_eight_fingerprints_link(spark):
    w = prose(random.Random(46), 120).split(" ")
    v = list(w)
    v[30] = v[80] = "edited"
    a, b = " ".join(w), " ".join(v)
    bits = near_bits(a, b, 8)
    assert min(bits[:5]) > 3 >= min(bits)
    assert [r.doc_id for r in simhash.keep_one(table(spark, [(1, a, "en", "s", 0), (2, b, "en", "s", 0)])).collect()] == [1]


def edited(r, w, n):
    v = list(w)
    for i in r.sample(range(len(v)), n):
        v[i] = f"edit{r.randint(0, 9999)}"
    return " ".join(v)


def test_keep_one_links_at_a_similarity_of_four_fifths(spark, monkeypatch):
    sets = lambda t: {tuple(t.split(" ")[i : i + 5]) for i in range(len(t.split(" ")) - 4)}
    alike = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    r = random.Random(3)
    texts, far = [], 0
    for i in range(60):
        w = prose(r, 200).split(" ")
        a, b = " ".join(w), edited(r, w, 2 + i % 5)
        texts += [a, b]
        far += alike(a, b) >= 0.8 and min(near_bits(a, b, 8)) > 3
    assert far >= 5
    w = prose(r, 200).split(" ")
    texts += [edited(r, w, 2) for _ in range(30)]  # one cell of many, some by way of others
    want = {i for i, t in enumerate(texts[:120]) if i % 2 == 0 or (alike(texts[i - 1], t) < 0.8 and min(near_bits(texts[i - 1], t, 8)) > 3)} | {120}
    for most in (512, 7):
        monkeypatch.setattr(simhash, "SET_CELL", most)
        got = {x.doc_id for x in simhash.keep_one(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
        assert got == want
