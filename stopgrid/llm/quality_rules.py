"""Quality rules: per-text counts, and lines that too many documents of a host share.

DataFrame functions only. Lines are normalised (outer white space off,
lower-cased) and hashed to 128 bits; for each host the distinct documents that
hold a line are counted, where documents of one text are one. A line that more
than MAX_SHARE of the host's documents hold, and more than LEAST_DOCS, is
boilerplate: it is removed from all of them. A document is depleted, and
rejected, if what is left has too few words for the base rule or is too small a
share of its text. The limit is a share, so it means the same at every size.

Each line is hashed once, into a table in the shared folder that is counted and
then searched. Where only the verdict is asked for, texts are not shuffled.

Skew: the counts are hash aggregates with partial sums, so a hot host or line
costs no single task more than others. A host has at most 1 / MAX_SHARE such
lines for each line of a mean document. A broadcast of them is made only below
BROADCAST_ROWS; beyond it only those are broadcast that can number at most
HEAVY_SHARE, and the rest are joined by shuffle.

Defined results: a null text is empty, fails the base rule and is rejected; a
null host is a host of its own; repeated rows each get the same verdict and
count once; a line held by exactly the limit stays; a text of megabytes is
counted whole (windows found twice are looked up, or sorted if many); an empty
table gives an empty table; output columns replace columns of their name, all
others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HEAVY_SHARE, held, own_name, text_of, written

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"

#: The share of a host's distinct documents that may hold a line, and a number of them that always may.
MAX_SHARE, LEAST_DOCS = 0.05, 10
#: Words of a document, as it is and after the removal of lines.
MIN_WORDS = 50
#: A document of whose characters less than this share is left by the removal of lines is rejected.
LEAST_LEFT = 0.2
#: Columns that ``rule_verdicts`` makes.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_chars", "n_line_words", "kept_text", "kept")


def words_of(t: Column) -> Column:
    trimmed = F.btrim(t, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and base_failed."""
    none = F.array().cast("array<bigint>")
    n = {x: own_name(f"__{x}", docs) for x in "twlxhsdpa"}
    w, h, s = F.col(n["w"]), F.col(n["h"]), F.col(n["s"])
    out = docs.withColumn(n["t"], text_of(text)).withColumn(n["w"], words_of(F.col(n["t"])))
    out = out.withColumn("n_words", F.size(w).cast("long"))
    out = out.withColumn("word_chars", F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    out = out.withColumn("n_symbols", (F.length(n["t"]) - F.length(F.regexp_replace(n["t"], r"[#*$%&|<>]", ""))).cast("long"))
    lines = F.filter(F.split(n["t"], "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(n["l"], lines).withColumn("n_dup_lines", (F.size(n["l"]) - F.size(F.array_distinct(n["l"]))).cast("long"))
    # Each word is hashed once; a window's hash is over its three word hashes.
    out = out.withColumn(n["x"], F.transform(w, lambda x: F.xxhash64(x)))
    x = F.col(n["x"])
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
    out = out.withColumn(n["h"], F.when(F.size(w) >= 3, hashes).otherwise(none)).withColumn(n["s"], F.array_sort(h))
    twice = F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1)))
    out = out.withColumn(n["d"], twice)
    # Where windows found twice start. Few of them: each window is looked up; many: hash and start are sorted together.
    looked = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(F.col(n["d"]), F.get(h, i)))
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(n["p"], F.when(F.size(n["d"]) > 40, pairs))
    p = F.col(n["p"])
    sorted_ = F.array_sort(F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i + 1)["h"]) | (F.when(i > 0, x["h"] == F.get(p, i - 1)["h"]).otherwise(False))), lambda x: x["i"]))
    at = F.when(F.size(n["d"]) == 0, F.array().cast("array<int>")).when(F.size(n["d"]) > 40, sorted_).otherwise(looked)
    out = out.withColumn(n["a"], at)
    a = F.col(n["a"])
    covered = F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda acc, n: acc + n)
    out = out.withColumn("n_repeat_words", F.when(held(), covered))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop(*n.values())


def _line_hashes(line):
    """A line's key: two hashes of it, normalised."""
    key = F.lower(F.btrim(line, F.lit(SPACE)))
    return key, F.xxhash64(key), F.xxhash64(F.lit(1), key)


def line_table(rows: DataFrame) -> DataFrame:
    """(host, th, a, b, n, w) of (host, th, t): for each line but blank ones its hashes, code points and words."""
    each = rows.select("host", "th", F.explode(F.split("t", "\n", -1)).alias("line"))
    key, a, b = _line_hashes(F.col("line"))
    lines = each.withColumn("key", key).where("key <> ''")
    return lines.select("host", "th", a.alias("a"), b.alias("b"), F.length("key").cast("long").alias("n"), F.size(F.split("key", SPACES)).cast("long").alias("w"))


def frequent_lines(lines: DataFrame, twins: DataFrame, max_share: float, least_docs: int) -> DataFrame:
    """(host, a, b, docs, rows): lines that more than the limit of a host's distinct documents hold; ``twins`` has each (host, th) once."""
    once = lines.groupBy("host", "a", "b", "th").agg(F.count("*").alias("c"))
    n = once.groupBy("host", "a", "b").agg(F.count("*").alias("docs"), F.sum("c").alias("rows")).where(F.col("docs") > least_docs)
    hosts = twins.groupBy("host").agg(F.count("*").alias("of"))
    return n.join(hosts, n["host"].eqNullSafe(hosts["host"])).where(F.col("docs") > max_share * F.col("of")).select(n["host"], "a", "b", "docs", "rows")


def _held_by(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` that are in ``found``."""
    total, n = found.agg(F.sum("rows"), F.count("*")).first()
    names = lambda d: d.select(F.col("host").alias("fh"), F.col("a").alias("fa"), F.col("b").alias("fb"))
    on = lambda r: lines["host"].eqNullSafe(r["fh"]) & (lines["a"] == r["fa"]) & (lines["b"] == r["fb"])
    if n <= BROADCAST_ROWS:
        right = F.broadcast(names(found))
        return lines.join(right, on(right), "left_semi")
    most = total // HEAVY_SHARE
    heavy, light = F.broadcast(names(found.where(F.col("rows") > most))), names(found.where(F.col("rows") <= most))
    return lines.join(heavy, on(heavy), "left_semi").unionByName(lines.join(heavy, on(heavy), "left_anti").join(light, on(light), "left_semi"))


def rule_verdicts(docs: DataFrame, host: str = "source", text: str = "text", max_share: float = MAX_SHARE, least_docs: int = LEAST_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs`` with the columns of ``text_counts``, n_line_chars and n_line_words (of its lines above the limit, removed), kept_text and kept."""
    own = [c for c in docs.columns if c not in MADE or c in (host, text)]
    base = docs.select(*own)
    th, size, drop = (own_name(x, base) for x in ("__th", "__size", "__drop"))
    base = base.withColumn(th, F.xxhash64(text_of(text)))
    texts = base.select(F.col(host).alias("host"), F.col(th).alias("th"), text_of(text).alias("t"))
    every = written(line_table(texts), "lines")
    twins = written(texts.groupBy("host", "th").agg(F.count("*").alias("rows")), "texts")
    found = written(frequent_lines(every, twins, max_share, least_docs), "frequent_lines")
    sums = _held_by(every, found).groupBy("host", "th").agg(F.sum("n").alias("chars"), F.sum("w").alias("words"), F.collect_set(F.struct("a", "b")).alias("keys"))
    per = sums.join(twins, sums["host"].eqNullSafe(twins["host"]) & (sums["th"] == twins["th"])).select(
        sums["host"].alias("ph"), sums["th"].alias("pt"), (F.col("chars") / F.col("rows")).cast("long").alias("pc"), (F.col("words") / F.col("rows")).cast("long").alias("pw"), F.col("keys").alias("pk"),
    )
    counted = text_counts(base, text).withColumn(size, F.length(text_of(text)))
    out = counted.join(per, counted[host].eqNullSafe(per["ph"]) & (counted[th] == per["pt"]), "left")
    chars, words = (F.coalesce(per[c], F.lit(0).cast("long")) for c in ("pc", "pw"))
    left = F.filter(F.split(text_of(text), "\n", -1), lambda x: ~F.array_contains(F.col(drop), F.struct(*[h.alias(n) for h, n in zip(_line_hashes(x)[1:], "ab", strict=True)])))
    out = out.select(*[counted[c] for c in [*own, *MADE[:6], size]], chars.alias(MADE[6]), words.alias(MADE[7]), per["pk"].alias(drop))
    out = out.withColumn("kept_text", F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    depleted = (F.col(size) - F.col("n_line_chars") < F.lit(least_left) * F.col(size)) | (F.col("n_words") - F.col("n_line_words") < MIN_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop(size, drop)
