"""Ranked text search: BM25 of stated queries over all documents.

The queries' terms are inverted, not the documents': a first pass counts how many documents
hold each of them, a second scores each document where it lies with all queries that share
a term with it (``operators.asked``).  A task gives the first few documents of each query,
so no posting is shuffled.  The result is that of scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.asked import Best, Inverted, Sets, hashes, meet, stored
from quarrylens.sources.shared import folder

#: The usual parameters.
K1, B = 1.2, 0.75
#: How far sums of doubles may differ by their order.
SLACK = 1e-6


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


@dataclass
class Index:
    """All documents as (doc_id, terms): the hashes of their terms, repeats counted."""

    documents: DataFrame
    b: float


def index(documents: DataFrame, b: float = B) -> Index:
    """documents: (doc_id, text); ids are unique."""
    return Index(documents.select(F.col("doc_id").cast("long"), hashes(terms_of(F.col("text"))).alias("terms")), b)


def _held(table: pa.Table, pages: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """How many documents hold each term of the queries; the documents (kind 1) and all of
    their terms (kind 2)."""
    own, n, terms = Inverted(Sets(table["terms"])), 0, 0
    counts = np.zeros(len(own.words), dtype=np.int64)
    for page in pages:
        sets = Sets(page["terms"])
        row, at = own.known(sets)
        counts += np.bincount(np.unique(row * len(counts) + at) % max(1, len(counts)), minlength=len(counts))
        n, terms = n + len(sets.sizes), terms + len(sets.values)
    part = table["query_id"][0].as_py()
    yield {"kind": np.r_[np.zeros(len(counts), dtype=np.int64), 1, 2], "part": np.full(len(counts) + 2, part), "term": np.r_[own.words, 0, 0].astype(np.int64), "n": np.r_[counts, n, terms]}


def _scored(mean: float, k1: float, b: float, most: int):
    def run(table: pa.Table, pages: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Inverted(Sets(table["terms"]), Sets(table["idf"]).values)
        ids, best = table["query_id"].to_numpy(), Best(table.num_rows, most, 0.0)
        for page in pages:
            page = page.filter(page["doc_id"].is_valid())
            sets, doc_ids = Sets(page["terms"]), page["doc_id"].to_numpy()
            row, at = own.known(sets)
            cells, tf = np.unique(row * len(own.words) + at, return_counts=True)
            row, at = np.divmod(cells, max(1, len(own.words)))
            weight = own.weights[at] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * sets.sizes[row] / mean)))
            scores = own.sums(len(doc_ids), row, at, weight)
            row, at = np.nonzero((scores > 0) & (scores >= (best.least - SLACK)[None]))
            rounded = np.floor(scores[row, at] * 1e6 + 0.5) / 1e6
            kept = rounded >= best.least[at]
            best.add(at[kept], rounded[kept], doc_ids[row][kept])
        if (found := best.chosen()) is not None:
            yield {"query_id": ids[found[0]], "doc_id": found[2], "score": found[1]}

    return run


def search(own: Index, queries: DataFrame, most: int = 10, k1: float = K1) -> DataFrame:
    """(query_id, doc_id, score, place): the first ``most`` documents of each query of
    (query_id, text), ties by id; scores are rounded to six digits."""
    spark, at, counted = queries.sparkSession, folder(queries.sparkSession), "kind int, part long, term long, n long"
    terms = F.array_distinct(hashes(terms_of(F.col("text"))))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long"), terms.alias("terms")).where(F.size("terms") > 0)
    meet(own.documents, stored(asked, "query_id", ["terms"]), _held, counted).write.parquet(at)
    counts = spark.read.schema(counted).parquet(at).groupBy("kind", "part", "term").agg(F.sum("n").alias("n")).groupBy("kind", "term").agg(F.max("n").alias("n"))  # each part counts all
    whole = counts.agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((1, "n"), (2, "terms")))).first()  # two numbers
    idf = F.log(1 + (whole.n - F.col("n") + 0.5) / (F.col("n") + 0.5))
    held = counts.where((F.col("kind") == 0) & (F.col("n") > 0)).select("term", idf.alias("idf"))
    known = asked.select("query_id", F.explode("terms").alias("term")).join(held, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("own"))
    weighed = known.select("query_id", F.col("own.term").alias("terms"), F.col("own.idf").alias("idf"))
    mean = whole.terms / whole.n if whole.terms else 1.0
    found = meet(own.documents, stored(weighed, "query_id", ["terms"]), _scored(mean, k1, own.b, most), "query_id long, doc_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))  # ``most`` rows of each task
    ids = queries.schema["query_id"].dataType
    return found.select(F.col("query_id").cast(ids).alias("query_id"), "doc_id", "score", place.alias("place")).where(F.col("place") <= most)
