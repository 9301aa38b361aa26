"""Writes: collections, appends, replacements, tables and Markdown reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import schemas


def overwrite(df: DataFrame, path: str) -> None:
    """The whole collection anew; readers see the old files until the job commits."""
    df.write.mode("overwrite").parquet(path)


def overwrite_json(df: DataFrame, path: str, rows: int = 500) -> None:
    """The same as JSON files, each an array of some ``rows`` documents."""
    files = max(1, -(-df.count() // rows))
    dealt = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(files)).alias("file"), F.struct(*df.columns).alias("row"))
    listed = dealt.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value"))
    listed.repartition(max(1, min(files, 200)), "file").write.mode("overwrite").partitionBy("file").text(path)


def append_activity(df: DataFrame, path: str) -> None:
    """Events behind those that the log holds, as JSON lines."""
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Partitions that ``df`` has rows of are replaced, others stay as they are."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def schema_name(name: str) -> str:
    """The name, if it is a plain identifier."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a schema name: {name!r}")
    return name


def ddl(schema: str) -> list[str]:
    """Statements that create the schema and its tables."""
    own = schema_name(schema)
    tables = [f"CREATE TABLE IF NOT EXISTS {own}.{name} ({columns}) USING parquet" for name, columns in schemas.TABLES.items()]
    return [f"CREATE SCHEMA IF NOT EXISTS {own}", *tables]


def bootstrap(spark: SparkSession, schema: str) -> list[str]:
    """Create what is missing; the names of all tables of the schema."""
    for statement in ddl(schema):
        spark.sql(statement)
    return sorted(schemas.TABLES)


def append_search(queries: DataFrame, matches: DataFrame, query_path: str, match_path: str) -> None:
    """A search and its matches, joined by a reference made from what was asked."""
    reference = F.sha2(F.to_json(F.struct("workspace_id", "surface", "pattern", "language", "path_glob")), 256)
    queries.withColumn("query_ref", reference).write.mode("append").parquet(query_path)
    matches.withColumn("query_ref", reference).drop("surface", "pattern", "language", "path_glob").write.mode("append").parquet(match_path)


def markdown(df: DataFrame, title: str, by: list[str]) -> DataFrame:
    """One row ``markdown``: a report that is already small, as a table in order of ``by``."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*by, row.alias("_row")))), lambda x: x["_row"])
    return df.agg(F.concat_ws("\n", F.concat(F.array(*map(F.lit, head)), rows)).alias("markdown"))
