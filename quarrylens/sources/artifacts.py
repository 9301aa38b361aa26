"""Stored collections: JSON documents, JSON lines and Parquet, read by explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylens import schemas


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def collection(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A collection kept as one JSON array or as a directory of JSON documents; without
    files it is empty.  Documents that don't parse are left out."""
    schema = schemas.TABLES[table]
    try:
        own = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        return own.select(StructType.fromDDL(schema).names)  # no columns of directories' names
    except AnalysisException as error:
        if _absent(error):
            return spark.createDataFrame([], schema)
        raise


def run_records(spark: SparkSession, directory: str, workspace_id: str) -> DataFrame:
    """Run records of a directory, outputs (``*.out.json``) left out, newest first."""
    every = spark.read.schema(schemas.TABLES["runs"]).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(directory)
    own = every.where(~F.col("_metadata.file_name").endswith(".out.json") & F.col("run_id").isNotNull() & (F.col("workspace_id") == workspace_id))
    return own.orderBy(F.desc("created_at"), F.desc("run_id"))


def metrics(spark: SparkSession, directory: str, workspace_id: str) -> DataFrame:
    return collection(spark, directory, "run_metrics").where(F.col("workspace_id") == workspace_id).orderBy(F.desc("calculated_at"), F.desc("run_id"))


def coverage_results(spark: SparkSession, directory: str, workspace_id: str, issue_id: str | None = None) -> DataFrame:
    own = collection(spark, directory, "coverage_results").where(F.col("workspace_id") == workspace_id)
    return own.where(F.col("issue_id") == issue_id) if issue_id else own


def activity_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only activity log; lines that are blank or don't parse are left out."""
    try:
        return spark.read.schema(schemas.TABLES["activity"]).option("mode", "DROPMALFORMED").json(path).where("activity_id is not null")
    except AnalysisException as error:
        if _absent(error):
            return spark.createDataFrame([], schemas.TABLES["activity"])
        raise


def latest_activity(activity: DataFrame, workspace_id: str, issue_id: str | None = None, run_id: str | None = None, most: int = 100) -> DataFrame:
    from quarrylens.operators.selection import activity_filter

    own = activity_filter(activity.where(F.col("workspace_id") == workspace_id), issue_id, run_id)
    return own.orderBy(F.desc("created_at"), F.desc("activity_id")).limit(most)


def structural_matches(lines: DataFrame) -> DataFrame:
    """Matches from the JSON lines (column line) of a structural search tool; its places
    count from 0, these from 1."""
    parsed = lines.select(F.from_json("line", "struct<file: string, text: string, language: string, range: struct<start: struct<line: int, column: int>, end: struct<line: int, column: int>>>").alias("m"))
    at = lambda side, part: (F.col(f"m.range.{side}.{part}") + 1).alias(f"{part}_{side}")
    return parsed.where("m.file is not null").select(F.col("m.file").alias("path"), at("start", "line"), at("start", "column"), at("end", "line"), at("end", "column"), F.col("m.text").alias("matched_text"), "m.language")
