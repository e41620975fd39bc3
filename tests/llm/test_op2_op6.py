import hashlib
import re
from collections import Counter

from llm_fixtures import documents, saved, table

from stopgrid.llm import pii, quality_rules
from stopgrid.llm.queries import op2_pii, op6_quality_rules

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text, out = text or "", []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            v = m[0]
            n = sum(c.isdigit() for c in v)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if k == "ip" else 0, "card": 16 <= n <= 19 and luhn(v), "phone": 8 <= n <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


NASTY = [
    "a@b.c..d@e.f x_y@z.q_r@s.t a@b.com.%foo@x.y @a.b a@b a@b.c@d.e -@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.0255 1.2.3 999.1.2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111112 4111 1111 1111 11112222 12 4111111111111111 7", "+49 (30) 123-4567 +1 2 +1.2.3.4.5.6.7.8 +44 20 7946 0958 +123456789012345678 +1 (((((",
    "ü 😀 mail: jürgen@exam-ple.co.uk, pay card 5500 0000 0000 0004 iban DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432",
    "1 " * 3000 + "4111111111111111", "a." * 4000 + "@" + "b." * 4000 + "c", "9" * 5000, "+1" * 3000, "x@y.z " * 1500,
]


def test_op2_equals_brute_force(spark, tmp_path):
    rows = documents() + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(NASTY)]
    got = Counter()
    for r in op2_pii(spark, saved(spark, tmp_path, rows)).collect():
        got[(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)] += 1
    want = Counter()
    for d, t, *_ in rows:
        f = brute(t)
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in f)
        c = Counter(k for k, _, _ in f)
        want[(d, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(s.encode()).hexdigest())] += 1
    assert got == want


def test_pii_spans_scores_and_clashes(spark):
    t = NASTY[4]
    row = pii.find_pii(table(spark, [(1, t, "en", "s", 0)], spans=5, start=1)).first()
    assert [s.kind for s in row.spans] == ["email", "card", "iban", "iban"] or [s.kind for s in row.spans][:2] == ["email", "card"]
    for s in row.spans:
        assert t[s.start : s.end] == s.value and 0 <= s.score <= 1
    assert {s.value for s in row.spans if s.kind == "iban"} == {"DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"}
    assert pii.find_pii(table(spark, [])).count() == 0
    assert "[email]" in pii.redact(table(spark, [(1, t, "en", "s", 0)])).first().text


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(wins)
    hit = set()
    for i, x in enumerate(wins):
        if c[x] > 1:
            hit |= {i, i + 1, i + 2}
    fail = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), fail


def test_op6_counts_equal_brute_force(spark, tmp_path):
    import random

    r = random.Random(3)
    many = [(3000 + i, " ".join(f"w{r.randint(0, k)}" for _ in range(600)), "en", "s", 0) for i, k in enumerate((3, 8, 20, 60, 500))]
    rows = documents() + many + [(4000, "# a | b <c>\n# a | b <c>\n\n \n x", None, None, 0)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op6_quality_rules(spark, saved(spark, tmp_path, rows)).collect())
    assert got == Counter((d, *counts(t)) for d, t, *_ in rows)


def brute_verdicts(rows, share, least, left):
    """(doc_id, n_line_chars, n_line_words, kept_text, kept) of each row, by loops over all rows."""
    low = lambda x: x.strip(" \t\n\r\x0b\x0c").lower()
    texts, holders = {}, {}
    for _, t, _, host, _ in rows:
        texts.setdefault(host, set()).add(t or "")
        for x in (t or "").split("\n"):
            holders.setdefault((host, low(x)), set()).add(t or "")
    gone = {k for k, v in holders.items() if k[1] and len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for d, t, _, host, _ in rows:
        lines = (t or "").split("\n")
        cut = [low(x) for x in lines if (host, low(x)) in gone]
        chars, words = sum(map(len, cut)), sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in cut)
        kept = "\n".join(x for x in lines if (host, low(x)) not in gone) if cut else t
        n, fail = len(t or ""), counts(t)
        out.append((d, chars, words, kept, not (fail[5] or n - chars < left * n or fail[0] - words < 50)))
    return out


def rule_rows():
    import random

    r = random.Random(7)
    line = " ".join(f"Shared{i}" for i in range(60))
    rows = [(i, f"{line}\nown {i} " + " ".join(f"w{i}_{j}" for j in range(200 if i % 5 else 3)), "en", "h" if i < 20 else None, 0) for i in range(30)]
    rows += rows[:2]  # rows that are repeated
    rows += [(100 + i, rows[0][1], "en", "copies", 0) for i in range(30)]  # copies are one document
    rows += [(200 + i, "\n".join([f"  {line.upper()} "] * 3 + [f"o{i}_{j} " + " ".join(f"{r.random():.3f}" for _ in range(12)) for j in range(6)]), "en", "mixed", 0) for i in range(40)]
    rows += [(300 + i, " ".join(f"x{i}_{j}" for j in range(60)), "en", "mixed", 0) for i in range(200)]
    return rows + documents(10)


def test_op6_verdicts_equal_brute_force(spark, monkeypatch):
    rows = rule_rows()
    for bound in (500_000, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(quality_rules, "HEAVY_SHARE", 2)
        out = quality_rules.rule_verdicts(table(spark, rows, kept=1, __th="x", th="y", __t=3), least_docs=5).collect()
        got = Counter((r.doc_id, r.n_line_chars, r.n_line_words, r.kept_text, r.kept) for r in out)
        assert got == Counter(brute_verdicts(rows, 0.05, 5, 0.2))
        assert all((r["__th"], r.th, r["__t"]) == ("x", "y", 3) for r in out)
        assert any(not r.base_failed and not r.kept for r in out)  # by lines alone
        assert {r.kept for r in out if r.source == "copies"} == {False} or all(r.n_line_chars == 0 for r in out if r.source == "copies")
    assert quality_rules.rule_verdicts(table(spark, [])).count() == 0


def test_long_texts_and_clashing_columns(spark):
    t = "word a@b.cc\n" * 200_000 + "4111 1111 1111 1111"
    df = table(spark, [(1, t, "en", "s", 0), (2, None, "en", "s", 0)], __t="mine", __m_email=1, spans=2)
    r = {x.doc_id: x for x in pii.find_pii(df).collect()}
    assert len(r[1].spans) == 200_001 and r[1]["__t"] == "mine" and r[2].spans == []
    v = {x.doc_id: x for x in quality_rules.rule_verdicts(df).collect()}
    assert v[1].n_words == 400_004 and v[1].base_failed and not v[2].kept


def test_redact_by_place(spark):
    t = "no 1.2.3.456, 1.2.3.45 and 1.2.3.4 then x@y.zz!"
    assert pii.redact(table(spark, [(1, t, "en", "s", 0)])).first().text == "no 1.2.3.456, [ip] and [ip] then [email]!"
