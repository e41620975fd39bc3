"""A corpus from raw documents to token ids, in five stages, each an operator of ``stopgrid.llm``.

Every stage but the last returns the columns of ``documents``; the last adds
``n_tokens`` and ``token_ids``. Stages are written as Parquet to the shared
folder and read again, so a lost executor costs part of one stage.

- quality_rules removes lines that too many documents of a host hold and drops
  documents that the rules reject.
- line_dedup drops lines that ten or more documents share, where copies, by the
  links of the next stage, count as one. Lines that only copies share are left
  for that stage, which else would find groups of copies empty.
- near_dedup keeps one document of each group. Documents link if one of eight
  SimHash fingerprints over five-word shingles differs by at most three bits,
  or if their sets of five-word shingles have a similarity of 0.8 or more.
- decontaminate drops documents of which a twentieth is benchmark text.
- byte_bpe encodes what is left.

Defined results: a null text is rejected by the first stage; so is an empty one;
rows with a null id, host or language stay if their text does; of equal rows one
stays; of a group the least id stays, null ids last, then a hash of the text;
texts of any length go through whole; an empty table gives an empty one; columns
of ``documents`` beyond text pass through all stages, whatever their names, but
for token_ids and n_tokens, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopgrid.llm import byte_bpe as bpe
from stopgrid.llm import decontaminate as benchmark
from stopgrid.llm import line_dedup as lines
from stopgrid.llm import quality_rules as rules
from stopgrid.llm import simhash
from stopgrid.plans.storage import written

#: Row for row, SQL can't express the fingerprints' hash or the merges.
ORACLE_SQL = None


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator makes, and the name of each column: none is lost to an operator's column of its name."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(docs: DataFrame, names: dict[str, str], **instead: str) -> DataFrame:
    return docs.select(*[F.col(instead.get(c, n)).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _aside(docs)
    return _back(rules.rule_verdicts(own, names["source"], names["text"]).where("kept"), names, text="kept_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _aside(docs)
    groups = simhash.text_groups(own, names["doc_id"], names["text"])
    return _back(lines.dedup_lines(own, names["text"], groups=groups), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _aside(docs)
    return _back(simhash.keep_one(own, names["doc_id"], names["text"]), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, names = _aside(docs)
    return _back(benchmark.find_contamination(own, items, names["text"]).where(~benchmark.contaminated()), names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [(f.__name__, f) for f in (quality_rules, line_dedup, near_dedup, decontaminate, byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
