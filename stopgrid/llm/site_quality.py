"""Quality and toxicity by hierarchical empirical Bayes.

1. A document classifier is fitted on about LABELLED labelled documents of at
   most SAMPLE_CHARS code points, chosen by a hash of their id (the documented
   bound of the labelled sample): words that tell a label apart, and a few
   measures of style, in a logistic model. The executors cut the texts into
   words; the driver gets numbers and the words kept, never texts.
2. Every document gets its evidence, a log odds. Sums of the probabilities over
   hosts and over paths within hosts are grouped aggregates with partial sums.
3. A host's rate, from the documents of its other paths, is shrunk to the global
   rate; a path's, from its other documents, to that. So no document is counted
   twice: not as its own evidence, nor as its path's and its host's. The
   strength of the prior comes from the spread of the rates between hosts by the
   method of moments, so sparse sites stay near the prior. A host with one path
   only is one site, shrunk to the global rate.
4. The posterior log odds are the evidence plus the log odds of the document's
   site against the global ones.

A source is ``host`` or ``host/path/...``; a URL's scheme is cut off.

Skew: a hot host costs the aggregates nothing more; site rates are joined by
count (``join_by_count``), so a hot site's documents stay where they are, and so
are hosts' sums with the paths of a host that has very many.

Defined results: a null text is empty; a null source is a site of its own; a
document with several label rows takes their majority, where a tie is good and
toxic; rows with a null label or id are no labels; without twenty labelled
documents of both kinds a rule by style alone decides quality and nothing is
toxic; a posterior of exactly a half is bad, and toxic; a text of megabytes is
judged whole; repeated rows give repeated results; an empty table gives an empty
table; only the id, source and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, small_batches, written

LABELLED = 5_000
SAMPLE_CHARS = 50_000
#: Documents of a label that must hold a word before it counts.
SUPPORT = 8
WORD = re.compile(r"\w+")
UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&<>@^~={}[]\\_`"
STYLE = ("upper", "symbols", "bars", "shouts", "digits", "word_length", "repeats", "stops", "words")


def style(text: str, words: list[str], distinct: int) -> list[float]:
    """Measures of a text's style, each small for plain prose."""
    raw = text.encode()
    n = max(1, len(raw))
    share = lambda cut: (n - len(raw.translate(None, cut)) if raw else 0) / n
    many = max(1, len(words))
    return [
        share(UPPER), share(SYMBOLS), raw.count(b"|") / many, raw.count(b"!") / many, share(b"0123456789"),
        sum(map(len, words)) / many, 1 - distinct / many, raw.count(b".") / many, float(np.log1p(len(words))),
    ]


def _table(x: np.ndarray) -> np.ndarray:
    """Style measures with their square roots, which tell small values apart."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


@dataclass
class Head:
    """A logistic model over a word list's hits and the measures of style."""

    words: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def hits(self, distinct: set[str]) -> list[float]:
        found = [self.words[w] for w in distinct.intersection(self.words)]
        return [float(bool(found)), float(np.log1p(len(found))), max(found, default=0.0), min(1.0, sum(found) / 20)]

    def log_odds(self, distinct: list[set[str]], measures: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.array([self.hits(d) for d in distinct]), _table(measures)], axis=1)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -12, 12)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and intercept by iteratively reweighted least squares."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, bad, toxic, style, words) of about ``most`` labelled documents: their measures of style and distinct words."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = one.count()
    share = int(min(1.0, most / max(1, n)) * 1_000_003)
    some = one.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1_000_003)) < share).limit(2 * most)
    small_batches(docs.sparkSession)
    kept = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))

    def features(batches):
        import pyarrow as pa

        for b in batches:
            split = [WORD.findall(t.lower()) for t in b.column(3).to_pylist()]
            distinct = [sorted(set(s)) for s in split]
            x = [style(t, s, len(d)) for t, s, d in zip(b.column(3).to_pylist(), split, distinct, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.list_(pa.float64())), pa.array(distinct, pa.list_(pa.string()))], ["doc_id", "bad", "toxic", "style", "words"])

    chosen = kept.join(F.broadcast(some), "doc_id").select("doc_id", "bad", "toxic", "text")
    return written(chosen.mapInArrow(features, "doc_id bigint, bad int, toxic int, style array<double>, words array<string>").orderBy("doc_id", F.xxhash64("words")).limit(2 * most), "labelled")


def telling_words(sample: DataFrame, label: str, yes: int, no: int) -> dict[str, float]:
    """The words that at least SUPPORT documents with the label hold, far more often than others, and their log ratios."""
    n = sample.select(F.col(label).alias("y"), F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("a1"), F.sum(1 - F.col("y")).alias("a0"))
    ratio = F.log((F.col("a1") + 0.5) / (yes + 1)) - F.log((F.col("a0") + 0.5) / (no + 1))
    return {r.w: r.r for r in n.where(F.col("a1") >= SUPPORT).select("w", ratio.alias("r")).where("r > 2.5").orderBy("w").collect()}


def fit_head(sample: DataFrame, label: str) -> Head | None:
    """A model of a label, or None if there are too few rows or either class is missing."""
    yes, n = sample.agg(F.sum(label), F.count("*")).first()
    if n < 20 or yes in (0, n):
        return None
    words = telling_words(sample, label, yes, n - yes)
    shared = sample.sparkSession.sparkContext.broadcast(words)

    def hits(batches):
        import pyarrow as pa

        head = Head(shared.value, np.zeros(1), np.ones(1), np.zeros(1))
        for b in batches:
            x = [head.hits(set(w)) for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "style", "hits"])

    rows = sample.select(F.col(label).cast("double").alias("y"), "style", "words").mapInArrow(hits, "y double, style array<double>, hits array<double>").collect()
    x = np.concatenate([np.array([r.hits for r in rows]), _table(np.array([r.style for r in rows]))], axis=1)
    head = Head(words, x.mean(0), np.maximum(x.std(0), 1e-3), np.zeros(1))
    head.weights = _logistic(np.clip((x - head.mean) / head.scale, -8, 8), np.array([r.y for r in rows]))
    return head


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict[str, Head | None]:
    sample = labelled_sample(docs, labels, most)
    return {k: fit_head(sample, k) for k in ("bad", "toxic")}


def _evidence(docs: DataFrame, model: dict[str, Head | None]) -> DataFrame:
    """(doc_id, source, bad, toxic): log odds by the document alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            split = [WORD.findall(t.lower()) for t in texts]
            distinct = [set(s) for s in split]
            m = np.array([style(t, s, len(d)) for t, s, d in zip(texts, split, distinct, strict=True)]).reshape(-1, len(STYLE))
            bad, toxic = shared.value["bad"], shared.value["toxic"]
            plain = np.where((m[:, 0] > 0.5) | (m[:, 1] > 0.1) | (m[:, 2] > 0.3), 3.0, -3.0)
            cols = [bad.log_odds(distinct, m) if bad else plain, toxic.log_odds(distinct, m) if toxic else np.full(len(m), -6.0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.float64()) for c in cols]], ["doc_id", "source", "bad", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(rows, "doc_id bigint, source string, bad double, toxic double")


def _logit(p):
    return F.log(p / (1 - p))


def _odds(x):
    return 1 / (1 + F.exp(-x))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(source, host, path, ...): for each source its path's sums p_*, n_path, its host's h_*, n_host, the global rates m_* and the strengths a_* of their prior."""
    parts = F.split(F.regexp_replace("source", r"^[a-z]+://", ""), "/")
    sited = evidence.withColumn("host", F.coalesce(parts[0], F.lit("\0"))).withColumn("path", F.coalesce(F.get(parts, 1), F.lit("")))
    sums = [F.sum(_odds(F.col(k))).alias(f"s_{k}") for k in ("bad", "toxic")]
    paths = written(sited.groupBy("source", "host", "path").agg(F.count("*").alias("n_source"), *sums), "sites")
    by_path = paths.groupBy("host", "path").agg(F.sum("n_source").alias("n_path"), F.count("*").alias("__sources"), *[F.sum(f"s_{k}").alias(f"p_{k}") for k in ("bad", "toxic")])
    hosts = by_path.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.count("*").alias("__paths"), F.sum("__sources").alias("__all"), *[F.sum(f"p_{k}").alias(f"h_{k}") for k in ("bad", "toxic")])
    made = []
    for k in ("bad", "toxic"):
        m = F.sum(f"h_{k}") / F.sum("n_host")
        made += [m.alias(f"m_{k}"), F.sum(F.pow(F.col(f"h_{k}"), 2) / F.col("n_host")).alias(f"q_{k}")]
    total = hosts.agg(F.count("*").alias("k"), F.sum("__paths").alias("paths"), F.sum("__all").alias("sources"), F.sum("n_host").alias("n"), F.sum(F.pow(F.col("n_host"), 2)).alias("n2"), *made).first()
    by_path = join_by_count(by_path, hosts.drop("__all"), ["host"], "__paths", total["paths"] or 0).drop("__paths")
    out = join_by_count(paths, by_path, ["host", "path"], "__sources", total["sources"] or 0).drop("__sources")
    for k in ("bad", "toxic"):
        mean, strength = 0.1, 50.0
        if total["n"]:
            mean = min(max(total[f"m_{k}"], 1e-4), 1 - 1e-4)
            # The variance between hosts beyond what chance gives; none: a prior of 1000 documents.
            inner = mean * (1 - mean)
            between = total[f"q_{k}"] - total["n"] * mean**2 - (total["k"] - 1) * inner
            scale = total["n"] - total["n2"] / total["n"]
            tau = between / scale if scale > 0 else 0.0
            strength = min(max(inner / tau - 1 if tau > 0 else 1000.0, 5.0), 1000.0)
        out = out.withColumn(f"m_{k}", F.lit(mean)).withColumn(f"a_{k}", F.lit(strength))
    return out


def assess(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, p_bad, p_toxic, host_bad, path_bad, kept, toxic, quality) for each row of ``docs`` (doc_id, source, text).

    ``host_bad`` is the rate of the host's other paths, shrunk; ``path_bad`` that of the document's path without itself.
    """
    evidence = written(_evidence(docs, fit(docs, labels, most)), "evidence").withColumn("key", F.coalesce("source", F.lit("\0")))
    sites = written(site_posteriors(evidence), "site_rates")
    named = sites.withColumn("key", F.coalesce("source", F.lit("\0"))).drop("source", "host", "path")
    total = sites.agg(F.sum("n_source")).first()[0] or 0
    x = join_by_count(evidence, named, ["key"], "n_source", total)
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    for k in ("bad", "toxic"):
        a, m, own = F.col(f"a_{k}"), F.col(f"m_{k}"), _odds(F.col(k))
        elsewhere = (a * m + F.col(f"h_{k}") - F.col(f"p_{k}")) / (a + F.col("n_host") - F.col("n_path"))
        x = x.withColumn(f"host_{k}", inside(elsewhere))
        path = (a * F.col(f"host_{k}") + F.col(f"p_{k}") - own) / (a + F.col("n_path") - 1)
        x = x.withColumn(f"path_{k}", inside(path))
        x = x.withColumn(f"post_{k}", _odds(F.col(k) + _logit(F.col(f"path_{k}")) - _logit(F.col(f"m_{k}"))))
    return x.select(
        "doc_id", F.col("post_bad").alias("p_bad"), F.col("post_toxic").alias("p_toxic"), "host_bad", "path_bad",
        ((F.col("post_bad") < 0.5) & (F.col("post_toxic") < 0.5)).alias("kept"), (F.col("post_toxic") >= 0.5).alias("toxic"), (F.col("post_bad") < 0.5).cast("int").alias("quality"),
    )
