"""The queries of this subpackage, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import bpe, conversations, decontaminate, importance, language_model, license_scan, near_dedup, packing, quality_rules, repeated_spans, secret_scan, token_files, toxicity
from quarrylens.llm.common import short_batches
from quarrylens.llm.common import table as read_table
from quarrylens.llm.importance_sql import SQL as IMPORTANCE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query's application."""
    short_batches(spark)
    return read_table(spark, sf_dir, name)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), width=4)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_rules.fit(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judge(documents, model)


#: The vocabulary file of the token queries.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), WORD_BPE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(table(spark, sf_dir, "conversations")))


#: The vocabulary file of the packing query.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_repeated_spans": op7_repeated_spans,
    "op8_license_scan": op8_license_scan,
    "op9_language_model": op9_language_model,
    "op10_bpe": op10_bpe,
    "op11_importance": op11_importance,
    "op12_conversations": op12_conversations,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {"op11_importance": IMPORTANCE_SQL}
