"""The corpus pipeline: quality, line rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of
``documents``; the last returns the packed pieces. Stages are written as Parquet and read again, so
each works on what the one before it kept and a lost executor re-reads files. A null text is a text
of no words: the quality model scores it, the line rules reject it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import crf, forest, packing, pii, queries, rules
from tallyframe.llm.store import stage, table

# Workers keep the packing stage's table of chunks while later work runs in the same executors, so
# it is smaller here than where packing runs alone.
PACK_CHUNKS = 100_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores as bad go."""
    return crf.keep_good(docs, crf.fit(docs, table(spark, sf_dir, "labels"), queries.quality_rows))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above their host's limit go, and documents that fail the base rules or are depleted."""
    return rules.apply_rules(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return forest.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row for each piece of a document."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), max_chunks=PACK_CHUNKS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None      # models and tokenizers: SQL can't express them; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
