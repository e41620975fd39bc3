"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

DataFrame functions only. Every pattern below runs in linear time and constant
stack: Java recurses for repeated groups, so the repeated groups of the
contract's patterns are restated as runs of one character class that stop at a
lookahead. They accept the same leftmost, non-overlapping matches.

Defined results: a null text is empty and has no spans; ties cannot occur
within a kind (spans of one kind never overlap); repeated rows give repeated
results; an empty table gives an empty table; a text of any length is searched
whole, in time that grows with its length; other columns pass through, whatever
their names, and ``spans`` replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, own_name, prefix_sums, text_of

#: Local part: a whole run of its class, or what is left of it after the match before (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only chains of 16 to 19 digits: chains are maximal and disjoint, so leaving the others out moves no match.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|@",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay",
    "phone": r"(?i)phone|tel|mobile|call|fax|cell",
    "iban": r"(?i)iban|bank|account|konto|transfer",
}
#: Code points before and after a span that are searched for context words.
NEAR = 48

SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def _digits(v: Column) -> Column:
    return F.split(F.regexp_replace(v, "[^0-9]", ""), "")


def luhn_ok(v: Column) -> Column:
    """Luhn's checksum over the digits of ``v``."""
    d = F.reverse(_digits(v))
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(v: Column) -> Column:
    """The account number checksum: first four characters last, letters as 10 to 35, remainder 1."""
    s = F.replace(v, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _ip_ok(v: Column) -> Column:
    """Four parts of at most 255 by value; leading zeros don't count."""
    return ~v.rlike(r"(^|\.)0*+(?:[0-9]{4,}|25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9])(\.|$)")


def _phone_ok(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)


RULES = {
    "email": (EMAIL, None, lambda t: F.contains(t, F.lit("@"))),
    "ip": (IP, _ip_ok, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (CARD, luhn_ok, lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")),
    "phone": (PHONE, _phone_ok, lambda t: F.contains(t, F.lit("+"))),
    "iban": (IBAN, mod97_ok, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}")),
}


def _span_of(k: str, gap: Column, before: Column):
    def span(m: Column, i: Column) -> Column:
        start = before[i] + F.length(gap[i])
        near = F.concat(F.substring(gap[i], -NEAR, NEAR), F.lit(" "), F.substring(gap[i + 1], 1, NEAR)).rlike(CONTEXT[k])
        score = F.lit(0.8 if RULES[k][1] else 0.5) + F.when(near, 0.2).otherwise(0.0)
        return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.round(score, 2).alias("score"))

    return span


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, value, score), by kind as listed, then start.

    Offsets are code points, end exclusive. The score is 0.5 for a pattern,
    0.3 more if a checksum or range confirms it, 0.2 more if a context word
    stands within NEAR code points (up to the next span of the kind).
    """
    own = [c for c in docs.columns if c != "spans"]
    # Columns made on the way get names that no column of docs has.
    made = {x: own_name(f"__{x}", docs) for x in ("t", *[f"{p}_{k}" for p in "mgb" for k in kinds])}
    t = made["t"]
    out = docs.select(*own).withColumn(t, text_of(F.col(text)))
    for k in kinds:
        pattern, _, may = RULES[k]
        out = out.withColumn(made[f"m_{k}"], F.when(may(F.col(t)) & held(), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for k in kinds:
        out = out.withColumn(made[f"g_{k}"], F.when((F.size(made[f"m_{k}"]) > 0) & held(), F.split(t, RULES[k][0], -1)).otherwise(F.array().cast("array<string>")))
    for k in kinds:
        gap, hit = F.col(made[f"g_{k}"]), F.col(made[f"m_{k}"])
        steps = F.zip_with(F.slice(gap, 1, F.size(hit)), hit, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        out = out.withColumn(made[f"b_{k}"], F.when((F.size(hit) > 0) & held(), prefix_sums(steps)).otherwise(F.array().cast("array<bigint>")))
    spans = []
    for k in kinds:
        confirm = RULES[k][1]
        found = F.transform(made[f"m_{k}"], _span_of(k, F.col(made[f"g_{k}"]), F.col(made[f"b_{k}"])))
        spans.append(F.filter(found, lambda s: confirm(s["value"])) if confirm else found)  # noqa: B023  called at once
    return out.withColumn("spans", F.concat(*[s.cast(SPAN_TYPE) for s in spans])).select(*own, "spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; a span that begins within an earlier one goes with that."""
    found = find_pii(docs, text)
    whole = text_of(F.col(text))
    ordered = F.array_sort(F.transform(F.filter("spans", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        clear = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(clear, F.array_append(a["out"], piece)).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(ordered, none, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(whole, (a["at"] + 1).cast("int"), F.length(whole))))
    return found.withColumn(text, clean)
