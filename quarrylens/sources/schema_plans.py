"""What separates the stored tables of a schema from the wanted ones, and its application.

A plan is a table of steps: create a table, add a column, widen one to a type that holds
all its values, keep it, or refuse, where values could be lost.  Columns that aren't
wanted any more stay.  ``apply`` runs a plan without refusals: what is missing is created
and added; a table with columns to widen is written anew beside the old one and takes its
place by a rename, so a run that breaks off leaves the old table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from quarrylens import schemas
from quarrylens.sources.sinks import schema_name

STEP = "table_name string, column_name string, action string, stored string, wanted string"
#: The wider types that hold all values of a type.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"), "smallint": ("int", "bigint", "float", "double"), "int": ("bigint", "double"),
    "float": ("double",), "date": ("timestamp",),
}


class Refused(ValueError):
    """A plan that would lose values; says which columns."""


def action(stored: DataType | None, wanted: DataType) -> str:
    """What a column needs; structs and arrays are compared as a whole."""
    if stored is None:
        return "add"
    if stored.simpleString() == wanted.simpleString():
        return "keep"
    return "widen" if wanted.simpleString() in WIDER.get(stored.simpleString(), ()) else "refuse"


def wanted_tables(tables: dict[str, str]) -> dict[str, StructType]:
    return {name: StructType.fromDDL(columns) for name, columns in tables.items()}


def steps(spark: SparkSession, schema: str, tables: dict[str, str] = schemas.TABLES) -> list[tuple]:
    own, found = schema_name(schema), []
    for name, wanted in wanted_tables(tables).items():
        at = f"{own}.{name}"
        if not spark.catalog.tableExists(at):
            found.append((name, None, "create", None, wanted.simpleString()))
            continue
        stored = {f.name.lower(): f.dataType for f in spark.table(at).schema}
        for f in wanted:
            old = stored.get(f.name.lower())
            found.append((name, f.name, action(old, f.dataType), old.simpleString() if old else None, f.dataType.simpleString()))
    return found


def plan(spark: SparkSession, schema: str, tables: dict[str, str] = schemas.TABLES) -> DataFrame:
    """The steps as a table; a few hundred rows, as many as columns are wanted."""
    return spark.createDataFrame(steps(spark, schema, tables), STEP)


def apply(spark: SparkSession, schema: str, tables: dict[str, str] = schemas.TABLES) -> DataFrame:
    """Bring the stored tables to what is wanted; the plan that was applied."""
    own, todo = schema_name(schema), steps(spark, schema, tables)
    if refused := [f"{t}.{c}: {old} to {new}" for t, c, what, old, new in todo if what == "refuse"]:
        raise Refused("schema plan is refused: " + "; ".join(refused))
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {own}")
    for name, columns in tables.items():
        mine = {what: [(c, new) for t, c, w, _, new in todo if t == name and w == what] for what in ("create", "add", "widen")}
        if mine["create"]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {own}.{name} ({columns}) USING parquet")
        elif mine["widen"]:
            changed, added = dict(mine["widen"]), mine["add"]
            chosen = [f"CAST(`{c}` AS {changed[c]}) AS `{c}`" if c in changed else f"`{c}`" for c in spark.table(f"{own}.{name}").columns]
            chosen += [f"CAST(NULL AS {kind}) AS `{c}`" for c, kind in added]
            spark.sql(f"DROP TABLE IF EXISTS {own}.{name}__new")
            spark.sql(f"CREATE TABLE {own}.{name}__new USING parquet AS SELECT {', '.join(chosen)} FROM {own}.{name}")
            spark.sql(f"DROP TABLE IF EXISTS {own}.{name}__old")
            spark.sql(f"ALTER TABLE {own}.{name} RENAME TO {own}.{name}__old")
            spark.sql(f"ALTER TABLE {own}.{name}__new RENAME TO {own}.{name}")
            spark.sql(f"DROP TABLE {own}.{name}__old")
        elif mine["add"]:
            spark.sql(f"ALTER TABLE {own}.{name} ADD COLUMNS ({', '.join(f'`{c}` {kind}' for c, kind in mine['add'])})")
    return spark.createDataFrame(todo, STEP)
