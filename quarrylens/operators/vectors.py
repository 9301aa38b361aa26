"""Nearest vectors by cosine: an inverted file of trained cells, exact within its cells.

Cells are trained by k-means on at most ``SAMPLE`` vectors; all vectors are dealt to their
nearest cell.  A query visits the ``probes`` nearest cells and compares itself with every
vector there.  ``exact`` then visits each other cell that may hold a nearer one: unit
vectors of a cell of radius ``r`` are at least ``|q - c| - r`` away.  Cells are dealt in
parts of some ``PART`` vectors and queries in blocks of ``PART``, so that no task holds
more however crowded a cell is; parts meet blocks as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.duplicates import first_of

#: Vectors that cells are trained on, at most; rows of a part of a cell.
SAMPLE, PART = 20_000, 4_000
ROUNDS, SEED = 15, 7
FOUND = "query_id long, vec_id long, similarity double"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    rows = np.asarray(rows, dtype=np.float64)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def matrix(column: pd.Series) -> np.ndarray:
    return unit(np.stack([np.asarray(x, dtype=np.float64) for x in column])) if len(column) else np.zeros((0, 1))


def train(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of ``cells`` cells by k-means on the first ``sample`` vectors by a hash."""
    chosen = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    rows = matrix(chosen["embedding"])
    if not len(rows):
        return np.zeros((1, 1))
    rng = np.random.default_rng(SEED)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(rows, centres).argmin(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = rows[near == k].mean(axis=0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def dealt(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, embedding, cell, away): each vector's cell and distance to its centre."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                away = distances(matrix(pdf["embedding"]), centres)
                yield pdf.assign(cell=away.argmin(axis=1).astype(np.int32), away=away.min(axis=1))

    own = vectors.where("embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return own.mapInPandas(run, "vec_id long, embedding array<double>, cell int, away double")


def _visits(queries: DataFrame, centres: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(query_id, embedding, cell, turn, nearest): all cells of each query, nearest first,
    and how near a vector there can be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                away = distances(matrix(pdf["embedding"]), centres)
                order = away.argsort(axis=1, kind="stable")
                n = len(centres)
                yield pd.DataFrame({
                    "query_id": np.repeat(pdf["query_id"].to_numpy(), n), "embedding": [x for x in pdf["embedding"] for _ in range(n)], "cell": order.ravel().astype(np.int32),
                    "turn": np.tile(np.arange(n, dtype=np.int32), len(pdf)), "nearest": np.take_along_axis(away - radius[None], order, axis=1).ravel(),
                })

    return queries.mapInPandas(run, "query_id long, embedding array<double>, cell int, turn int, nearest double")


def _compared(visits: DataFrame, parts: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each part of a cell for each query that visits it."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        ids = held["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        like = np.round(matrix(asked["embedding"]) @ matrix(held["embedding"]).T, 6)[:, order]
        best = np.argsort(-like, axis=1, kind="stable")[:, : most + 1]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), best.shape[1]), "vec_id": ids[order][best].ravel(), "similarity": np.take_along_axis(like, best, axis=1).ravel()})

    blocks = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(16)))
    asked = blocks.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a part is read once for each block of queries that visits it
    wanted = asked.select(*(F.col(c).alias(c) for c in ("cell", "part", "block"))).distinct()
    held = parts.join(wanted, ["cell", "part"])
    keys = ["cell", "part", "block"]
    found = asked.select("query_id", "embedding", *keys).groupBy(*keys).cogroup(held.select("vec_id", "embedding", *keys).groupBy(*keys)).applyInPandas(run, FOUND)
    return found.where("query_id <> vec_id")


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10, cells: int = 64, probes: int = 8, exact: bool = False, part: int = PART) -> DataFrame:
    """(query_id, vec_id, similarity, place): the ``most`` nearest other vectors of each
    query vector (query_id, embedding), ties by id; similarities are rounded to six digits.

    vectors: (vec_id, embedding), ids unique; null vectors are passed over.
    """
    centres = train(vectors, cells)
    own = dealt(vectors, centres)
    shape = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    known = shape.collect()  # a row a cell
    radius = np.zeros(len(centres))
    for row in known:
        radius[row.cell] = row.radius
    sizes = shape.select("cell", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    parts = own.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("vec_id", "embedding", "cell", "part")
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    visits = _visits(asked, centres, radius)
    order = [F.desc("similarity"), F.col("vec_id")]
    best = first_of(_compared(visits.where(F.col("turn") < probes), parts, sizes, most), ["query_id"], order, most, "vec_id")
    if exact:
        worst = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.min("similarity").alias("least"))
        # unit vectors of a similarity s are sqrt(2 - 2s) apart
        reach = F.when(F.col("held") >= most, F.sqrt(2 - 2 * F.col("least")) + 1e-5).otherwise(F.lit(3.0))
        open_ = visits.where(F.col("turn") >= probes).join(worst.select("query_id", reach.alias("reach")), "query_id", "left").where(F.col("nearest") <= F.coalesce("reach", F.lit(3.0)))
        more = _compared(open_.drop("reach"), parts, sizes, most)
        best = first_of(best.select("query_id", "vec_id", "similarity").unionByName(more), ["query_id"], order, most, "vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))  # ``most`` rows each
    return best.withColumn("place", place).select("query_id", "vec_id", "similarity", "place")
