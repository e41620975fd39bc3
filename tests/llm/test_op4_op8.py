import random
import zlib

import numpy as np
import public_tokenizers as P
from llm_fixtures import documents, saved, table

from stopgrid.llm import language_id as L
from stopgrid.llm import site_quality as Q
from stopgrid.llm.queries import op4_site_quality, op8_language_id

ALPHABETS = {"en": "the and of ing tion with er".split(), "fr": "les des que eau oux pour é".split(), "de": "der und ung schaft ß ein über".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def lang_rows(n=400):
    r = random.Random(3)
    out = [(i, prose(r, x := r.choice(list(ALPHABETS)), r.randint(4, 60)), x, "s", 0) for i in range(n)]
    return out + [(9000, None, "en", "s", 0), (9001, "123 !!", "en", "s", 0), (9002, "", None, None, 0), (None, "the and", None, "s", 0), (9004, "q" * 500 + " 日本", None, "s", 0)]


def test_op8_held_out_accuracy(spark, tmp_path):
    rows = lang_rows()
    got = op8_language_id(spark, saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    right = []
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (9000, 9001, 9002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out:
            right.append(r.lang_pred == lang[r.doc_id])
    assert np.mean(right) > 0.97 and len(right) > 50


def brute_language(rows, names):
    """(lang, score) of each row: expectation-maximisation and scores by listing every segmentation of every word."""
    import regex
    from functools import lru_cache

    find = lambda t: [w[i : i + L.MAX_WORD] for w in regex.findall(r"\p{L}+", (t or "").lower()) for i in range(0, len(w), L.MAX_WORD)]
    own = sorted({n for n in names if (x := n.removeprefix(L.START)) == x.lower() and (x.isalpha() or n == L.START)})
    ids, m = {n: i for i, n in enumerate(own)}, len(own) + 1

    @lru_cache(None)
    def cuts(s):
        if not s:
            return [[]]
        out = []
        for n in range(1, len(s) + 1):
            i = ids.get(s[:n], m - 1 if n == 1 else None)
            if i is not None:
                out += [[i, *rest] for rest in cuts(s[n:])]
        return out

    train = [(r[2], w) for r in rows if r[0] is not None and None not in (r[1], r[2]) and zlib.crc32(str(r[0]).encode()) % 4 != 2 for w in find(r[1])]
    langs = sorted({x for x, _ in train})
    length = np.array([max(1, len(n)) for n in [*own, ""]], float)
    theta = np.repeat((0.05**length / (0.05**length).sum())[:, None], len(langs), axis=1)
    for _ in range(L.ROUNDS):
        total = np.zeros_like(theta)
        for lang, w in train:
            k = langs.index(lang)
            ways = cuts(L.START + w)
            p = np.array([np.prod(theta[c, k]) for c in ways])
            for c, x in zip(ways, p / p.sum(), strict=True):
                for i in c:
                    total[i, k] += x
        pooled = total.sum(1, keepdims=True) + 0.01
        total += 20 * pooled / pooled.sum() + 1e-4
        theta = total / total.sum(0)
    out = []
    for r in rows:
        ws = find(r[1])
        s = np.array([sum(np.log(sum(np.prod(theta[c, k]) for c in cuts(L.START + w))) for w in ws) for k in range(len(langs))])
        p = np.exp(s - s.max())
        out.append((r[0], langs[int(s.argmax())], 1 / p.sum()) if ws else (r[0], "und", 0.0))
    return out


def test_op8_equals_brute_force(spark, tmp_path):
    r = random.Random(21)
    short = {"en": "the and of to in is".split(), "fr": "les des que la ou é".split(), "de": "der und ein ß zu in".split()}
    rows = [(i, " ".join(r.choice(short[x]) for _ in range(r.randint(1, 9))), x, "s", 0) for i in range(60) for x in [r.choice(list(short))]]
    rows += [(100, "½ ² Ⅷ 42 _", "en", "s", 0), (101, None, "de", "s", 0), (102, "", None, "s", 0), (103, "日本 Ab", None, "s", 0), (None, "der und", "de", "s", 0), (5, rows[5][1], "fr", "s", 0)]
    got = sorted(((x.doc_id is not None, x.doc_id or 0, x.lang_pred, x.score) for x in op8_language_id(spark, saved(spark, tmp_path, rows)).collect()), key=str)
    want = sorted(((d is not None, d or 0, lang, score) for d, lang, score in brute_language(rows, L.vocabulary(P.path("piece_bpe_32k.model")))), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)
    assert [g[2] for g in got if g[1] == 100] == ["und"]


def test_op8_learns_languages_of_long_documents_only(spark):
    r = random.Random(5)
    rows = [(i, prose(r, "en", 30), "en", "s", 0) for i in range(20)] + [(50 + i, prose(r, "de", 9000), "de", "s", 0) for i in range(3)]
    model = L.train_model(table(spark, rows), L.vocabulary(P.path("piece_bpe_32k.model")))
    assert model[0] == ["de", "en"]
    assert {x.doc_id: x.lang_pred for x in L.predict(table(spark, rows[-1:], lang_pred=1), model).collect()} == {52: "de"}


def test_op8_empty(spark, tmp_path):
    assert op8_language_id(spark, saved(spark, tmp_path, [])).count() == 0
    none = table(spark, [(1, "some text", None, "s", 0)], score="clash")
    assert [r.lang_pred for r in L.predict(none, L.train_model(none, ["a", "▁some"])).collect()] == ["und"]


def test_forward_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "▁aba", "bab", "Zed"]
    p = L.Pieces(names)
    assert "Zed" not in p.names
    theta = np.random.default_rng(1).random((len(p.names), 2))
    ids = {n: i for i, n in enumerate(p.names)}

    def total(s, k):
        if not s:
            return 1.0
        out = 0.0
        for n in range(1, len(s) + 1):
            i = ids.get(s[:n], len(p.names) - 1 if n == 1 else None)
            if i is not None and s[:n]:
                out += theta[i, k] * total(s[n:], k)
        return out

    words = ["a", "abab", "babab", "xaybab", "b"]
    got = np.exp(p.word_scores(words, theta))
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [total(L.START + w, k) for k in (0, 1)])


def test_expectation_maximisation_raises_likelihood():
    names = L.vocabulary(P.path("piece_bpe_32k.model"))
    p = L.Pieces(names)
    words, n = ["theand", "und", "ofing"], np.array([[5.0, 0], [1, 9], [3, 0]])
    score = [float((p.word_scores(words, p.fit(words, n, k)) * n).sum()) for k in (0, 1, 3)]
    assert score[0] < score[1] < score[2]


def quality_rows(n=600):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        t, bad, toxic = prose(r, "en", 60), 0, 0
        x = r.random()
        if x < 0.15:
            t, bad = t.upper().replace(" ", "!! "), 1
        elif x < 0.3:
            toxic = 1
            w = t.split()
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["blockhead", "nitwit", "dolt"])
            t = " ".join(w)
        rows.append((i, t, "en", r.choice(["https://a.org/x/1", "a.org/y", "b", "b", None]), 0))
        if i % 2:
            labels.append((i, 1 - bad, toxic))
    return rows, labels


def test_op4_finds_toxic_and_junk(spark, tmp_path):
    rows, labels = quality_rows()
    odd = [(x[0] if x[0] is None else 10_000 + x[0], *x[1:]) for x in documents(5)]
    lab = spark.createDataFrame(labels + [(None, 1, 0), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    d = saved(spark, tmp_path, rows + odd, labels=lab)
    got = op4_site_quality(spark, d).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    toxic = {r[0] for r in rows if any(w in r[1] for w in ("blockhead", "nitwit", "dolt"))}
    bad = {r[0] for r in rows if "!!" in r[1]}
    ids = [r[0] for r in rows]
    assert np.mean([by[i].toxic == (i in toxic) for i in ids]) > 0.99
    assert np.mean([by[i].kept == (i not in toxic | bad) for i in ids]) > 0.97
    assert all(0 <= r.p_bad <= 1 and 0 < r.host_bad < 1 for r in got)


def brute_quality(rows, labels):
    """Every document's posteriors by loops: words counted, features made, evidence, host and path rates without the document."""
    votes = {}
    for d, q, t in labels:
        if None not in (d, q, t):
            votes.setdefault(d, []).append((q, t))
    lab = {d: (sum(q for q, _ in v) / len(v) < 0.5, sum(t for _, t in v) / len(v) >= 0.5) for d, v in votes.items()}
    words = lambda t: Q.WORD.findall((t or "").lower())
    sample = [(words(t), t, *lab[d]) for d, t, *_ in rows if d in lab and t is not None and len(t) <= Q.SAMPLE_CHARS]
    evidence = []
    for k in (2, 3):
        yes = [x for x in sample if x[k]]
        no = [x for x in sample if not x[k]]
        if len(sample) < 20 or not yes or not no:
            evidence.append(None)
            continue
        telling = {}
        for w in {w for x in yes for w in x[0]}:
            a1, a0 = sum(w in x[0] for x in yes), sum(w in x[0] for x in no)
            ratio = np.log((a1 + 0.5) / (len(yes) + 1)) - np.log((a0 + 0.5) / (len(no) + 1))
            if a1 >= Q.SUPPORT and ratio > 2.5:
                telling[w] = ratio

        def row(ws, t, telling=telling):
            m = Q.style(t or "", ws, len(set(ws)))
            hits = [telling[w] for w in set(ws) if w in telling]
            return [float(bool(hits)), np.log1p(len(hits)), max(hits, default=0.0), min(1.0, sum(hits) / 20), *m, *np.sqrt(np.maximum(m, 0))]

        x = np.array([row(s[0], s[1]) for s in sample])
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        w = Q._logistic(np.clip((x - mean) / scale, -8, 8), np.array([float(s[k]) for s in sample]))
        evidence.append([float(np.clip(np.clip((np.array(row(words(t), t)) - mean) / scale, -8, 8) @ w[:-1] + w[-1], -12, 12)) for _, t, *_ in rows])
    site = []
    for r in rows:
        host, *rest = ("\0",) if r[3] is None else r[3].split("://")[-1].split("/")
        site.append((host, rest[0] if rest else ""))
    out = {}
    for e in evidence:
        p = [1 / (1 + np.exp(-x)) for x in e]
        n, m = len(p), min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
        hosts = {h: [x for x, s in zip(p, site, strict=True) if s[0] == h] for h, _ in site}
        between = sum(sum(v) ** 2 / len(v) for v in hosts.values()) - n * m * m - (len(hosts) - 1) * m * (1 - m)
        spread = n - sum(len(v) ** 2 for v in hosts.values()) / n
        tau = between / spread if spread > 0 else 0.0
        a = min(max(m * (1 - m) / tau - 1 if tau > 0 else 1000.0, 5.0), 1000.0)
        for i, (r, s, own) in enumerate(zip(rows, site, p, strict=True)):
            path = [x for x, z in zip(p, site, strict=True) if z == s]
            other = [x for x, z in zip(p, site, strict=True) if z[0] == s[0] and z != s]
            h = min(max((a * m + sum(other)) / (a + len(other)), 1e-6), 1 - 1e-6)
            q = min(max((a * h + sum(path) - own) / (a + len(path) - 1), 1e-6), 1 - 1e-6)
            out.setdefault((i, r[0]), []).append(1 / (1 + np.exp(-(e[i] + np.log(q / (1 - q)) - np.log(m / (1 - m))))))
    return sorted((d is not None, d or 0, round(x, 6), round(y, 6)) for (_, d), (x, y) in out.items())


def test_op4_equals_brute_force(spark, tmp_path):
    rows, labels = quality_rows(300)
    rows += [(x[0] if x[0] is None else 10_000 + x[0], *x[1:]) for x in documents(5)]
    labels += [(None, 1, 0), (1, None, 1), (3, 0, 1), (3, 1, 0), (7, 0, 0), (7, 1, 0)]
    d = saved(spark, tmp_path, rows, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.p_bad, 6), round(r.p_toxic, 6)) for r in op4_site_quality(spark, d).collect())
    want = brute_quality(rows, labels)
    assert len(got) == len(want) and all(g[:2] == w[:2] and np.allclose(g[2:], w[2:], atol=2e-5) for g, w in zip(got, want, strict=True))


def test_sparse_sites_shrink(spark):
    rows = [(i, f"big{i % 5}", 3.0 if i % 5 == 0 else -3.0, -6.0) for i in range(500)] + [(900, "tiny", 3.0, -6.0)]
    e = spark.createDataFrame(rows, "doc_id bigint, source string, bad double, toxic double")
    by = {r.source: r for r in Q.site_posteriors(e).collect()}
    rate = lambda r: (r.a_bad * r.m_bad + r.p_bad) / (r.a_bad + r.n_path)
    assert rate(by["big0"]) > 0.85 and rate(by["big1"]) < 0.15
    assert rate(by["tiny"]) < 0.5  # one bad document doesn't make a bad host


def test_op4_empty(spark, tmp_path):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert op4_site_quality(spark, saved(spark, tmp_path, [], labels=lab)).count() == 0
    (tmp_path / "more").mkdir()
    d = saved(spark, tmp_path / "more", documents(5), labels=lab)
    assert not any(r.toxic for r in op4_site_quality(spark, d).collect())
