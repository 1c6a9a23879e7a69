"""Registered queries of the operators and their oracle SQL.

Each query gets its rows through its operator and returns the columns its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import audit, chat, codes, crf, fingerprint, forest, infill, license, packing, pii, piece, rules, toxic
from tallyframe.llm.store import exact, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_rows(column):
    """Rows whose quality labels may be learnt from."""
    return F.pmod(crf.fold(column), F.lit(4)) != 2


@query
def op2_quality_crf(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = crf.fit(docs, labels, quality_rows)
    return (crf.score(docs, model)
            .withColumn("held_out", F.pmod(crf.fold("doc_id"), F.lit(4)) == 2)
            .withColumn("predicted", (F.col("score") >= crf.CUT).cast("int")))


@query
def op4_sentencepiece(spark, sf_dir):
    return piece.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op5_line_rules(spark, sf_dir):
    return rules.line_rules(table(spark, sf_dir, "documents")).drop("row_id", "text_hash", "removed_lines")


@query
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op8_token_codes(spark, sf_dir):
    return codes.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op6_ngram_join(spark, sf_dir):
    return forest.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op1_license_scan(spark, sf_dir):
    return license.scan(table(spark, sf_dir, "documents"))


@query
def op3_fingerprints(spark, sf_dir):
    return fingerprint.edited(table(spark, sf_dir, "documents"))


ORACLE["op1_license_scan"] = license.oracle()


@query
def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic.fit(docs, labels, lambda c: F.pmod(crf.fold(c), F.lit(5)) != 0)
    return (toxic.score(docs, model)
            .withColumn("held_out", F.pmod(crf.fold("doc_id"), F.lit(5)) == 0)
            .withColumn("predicted", (F.col("score") >= toxic.CUT).cast("int")))


@query
def op10_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


SAID = "</s>[INST] ok [/INST]"        # the contract's conversation -7


@query
def op11_chat_format(spark, sf_dir):
    convs = exact(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], convs.schema)
    return chat.read_back(chat.format_conversations(convs.unionAll(own)))


@query
def op12_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = audit.oracle()


@query
def op13_infill(spark, sf_dir):
    return infill.digests(table(spark, sf_dir, "documents"))
