"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, language_id, line_dedup, pii, quality_rules, simhash, site_quality, suffix_dedup, token_store
from .oracle import ORACLE_SQL  # noqa: F401


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as shards and read back."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    manifest = token_store.write_store(docs, _vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read_store(spark, manifest)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(_documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), shingle=3, bits=3)


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document, by itself and its site."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return site_quality.assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents hold, by a state that has seen insertions and deletions."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.drop_lines(docs, line_dedup.grown_state(docs, min_docs=10))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return quality_rules.rule_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_chars", "n_line_words", "kept")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return byte_bpe.digests(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = language_id.held_out()
    model = language_id.train_model(docs.where(~held & F.col("doc_id").isNotNull()), language_id.vocabulary(_vocabulary("piece_bpe_32k.model")))
    return language_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("doc_text"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.find_contamination(docs, bench, text="doc_text")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that also start earlier."""
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_store, op2_pii, op3_simhash, op4_site_quality, op5_line_dedup, op6_quality_rules, op7_byte_bpe, op8_language_id, op9_decontamination, op10_suffix_dedup)
}
