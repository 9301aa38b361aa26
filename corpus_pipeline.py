"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``; the last returns each document's token ids.

Edge cases: null and empty texts fail the quality rules and go; repeated rows stay
together where they stay, and rows of one id with different texts are judged each by its
own; documents without an id are never duplicates; an empty ``labels`` or ``benchmark``
keeps what the base rules keep; an empty table gives an empty result; columns beyond those
of ``documents`` are passed on, whatever their names, up to the last stage, which drops
them; a very long text is handed to Python alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bpe, decontaminate, near_dedup, quality_rules, secret_scan
from quarrylens.llm.common import shared_folder, short_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines stay."""
    short_batches(spark)
    model = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: shingles of five words, 0.8."""
    short_batches(spark)
    return near_dedup.dedupe(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    short_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark."""
    short_batches(spark)
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the token ids of each document that is left."""
    short_batches(spark)
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), "lang", "source")
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding", tokens),
]

#: Trained labelling, MinHash and BPE are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read from what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
