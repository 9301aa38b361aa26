"""Runs of the semantic index: staged apart, then published by one manifest row.

A run writes its files, symbols and summaries to a folder of its attempt, which no reader
looks into, and then appends one row to the manifests.  Readers follow manifests only, so
an attempt that breaks off leaves nothing to be seen, and a run that is repeated with the
same content finds its own manifest and writes nothing.  Of two manifests of one run (two
drivers at a time) readers take the earlier.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.semantic import fingerprint
from quarrylens.sources import trees

MANIFEST = (
    "index_run_id string, attempt string, workspace_id string, surface string, head_sha string, dirty_files int, index_fingerprint string, "
    "file_rows long, symbol_rows long, summary_rows long, created_at timestamp"
)
PARTS = {
    "files": "place int, path string, score int, sha256 string, status string",
    "symbols": "path string, symbol string, kind string, line_start int, enclosing_scope string",
    "summaries": "path string, summary string",
}


class Blocked(ValueError):
    """A run that may not start; says why."""


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """What has been published: one row a run."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    whole = rows.where("index_run_id is not null")
    first = whole.groupBy("index_run_id").agg(F.min_by(F.struct("*"), F.struct("created_at", "attempt")).alias("m"))
    return first.select("m.*")


def staged(tree: DataFrame, plan: DataFrame, path: str) -> dict[str, int]:
    """Write the parts of an attempt; the rows of each.

    tree: (path, text); plan: (place, path, score, sha256).  Planned paths that the tree
    doesn't hold any more are listed as missing.
    """
    chosen = tree.join(F.broadcast(plan.select("path")), "path", "left_semi")  # a plan's size is its argument
    there = chosen.select("path", F.lit("stored").alias("status"))
    symbols = trees.symbols(chosen)
    counted = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    said = trees.explained(chosen).join(counted, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    parts = {
        "files": plan.join(there, "path", "left").withColumn("status", F.coalesce("status", F.lit("missing"))),
        "symbols": symbols,
        "summaries": said.select("path", trees.explanation().alias("summary")),
    }
    rows = {}
    for name, df in parts.items():
        fields = [f.split() for f in PARTS[name].split(", ")]
        df.select(*(F.col(c).cast(kind) for c, kind in fields)).write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = df.sparkSession.read.schema(PARTS[name]).parquet(f"{path}/{name}").count()
    return rows


def run(tree: DataFrame, plan: DataFrame, path: str, workspace: str, surface: str, head: str | None, dirty: int = 0, dry: bool = False, blockers: list[str] | None = None) -> DataFrame:
    """Index the planned paths and publish the run; its manifest row (none: dry or known).

    The run's name is made of what it indexes, so the same run isn't published twice.
    """
    spark = tree.sparkSession
    if dry:
        return spark.createDataFrame([], MANIFEST)
    if blockers:
        raise Blocked("semantic index run is blocked: " + "; ".join(blockers))
    mark = fingerprint(plan, workspace, surface, head).first().fingerprint  # one row
    name = "semidx_" + mark[:24]
    known = manifests(spark, path).where(F.col("index_run_id") == name)
    if not known.isEmpty():
        return spark.createDataFrame([], MANIFEST)
    attempt = uuid.uuid4().hex
    rows = staged(tree, plan, f"{path}/runs/{name}/{attempt}")
    one = spark.range(1).select(
        F.lit(name).alias("index_run_id"), F.lit(attempt).alias("attempt"), F.lit(workspace).alias("workspace_id"), F.lit(surface).alias("surface"), F.lit(head).cast("string").alias("head_sha"),
        F.lit(dirty).alias("dirty_files"), F.lit(mark).alias("index_fingerprint"), *(F.lit(rows[p]).cast("long").alias(f"{p[:-1] if p != 'summaries' else 'summary'}_rows") for p in ("files", "symbols", "summaries")),
        F.current_timestamp().alias("created_at"),
    )
    one.coalesce(1).write.mode("append").json(f"{path}/manifests")
    return manifests(spark, path).where(F.col("index_run_id") == name)


def baseline(spark: SparkSession, path: str, workspace: str, surface: str) -> DataFrame:
    """The manifest of the latest run of a workspace's surface: one row or none."""
    own = manifests(spark, path).where((F.col("workspace_id") == workspace) & (F.col("surface") == surface))
    latest = own.agg(F.max_by(F.struct("*"), F.struct("created_at", "index_run_id")).alias("m")).where("m is not null")
    return latest.select("m.*")


def part(spark: SparkSession, path: str, workspace: str, surface: str, name: str) -> DataFrame:
    """``files``, ``symbols`` or ``summaries`` of the baseline."""
    found = baseline(spark, path, workspace, surface).first()  # one row
    if found is None:
        return spark.createDataFrame([], PARTS[name])
    return spark.read.schema(PARTS[name]).parquet(f"{path}/runs/{found.index_run_id}/{found.attempt}/{name}")
