"""Coverage reports in three formats, each parsed row by row from (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.arrays import let
from quarrylens.functions.numbers import rounded
from quarrylens.functions.paths import strip, text_lines

LISTED = 50
LINES = "struct<line: array<struct<_hits: string>>>"
CLASS = f"struct<_filename: string, lines: {LINES}, methods: struct<method: array<struct<lines: {LINES}>>>>"
COBERTURA = f"`_line-rate` string, `_branch-rate` string, packages struct<package: array<struct<classes: struct<class: array<{CLASS}>>>>>"


def _hits(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)) > 0))


def _result(reports: DataFrame, fmt: str, files: Column, rate: Column | None = None, branch: Column | None = None) -> DataFrame:
    """Totals of an array of (file, hit, total, counts); ``counts`` is false for a file
    without line data, which adds to the number of files alone."""
    own = reports.withColumn("files", F.coalesce(files, F.array().cast("array<struct<file: string, hit: int, total: int, counts: boolean>>")))
    add = lambda name: F.aggregate("files", F.lit(0), lambda a, x: a + x[name])
    hit, total = add("hit"), add("total")
    bare = F.filter("files", lambda x: x["counts"] & (x["hit"] == 0) & (x["file"] != ""))
    own_rate = F.when(total > 0, rounded(hit * 100.0 / total, 2)).otherwise(0.0)
    return own.select(
        F.col("path").alias("raw_report_path"), F.lit(fmt).alias("format"), (own_rate if rate is None else rate).alias("line_coverage"),
        (F.lit(None).cast("double") if branch is None else branch).alias("branch_coverage"), hit.alias("lines_covered"), total.alias("lines_total"),
        F.size(F.filter("files", lambda x: x["hit"] > 0)).alias("files_covered"), F.size("files").alias("files_total"),
        F.slice(F.transform(bare, lambda x: x["file"]), 1, LISTED).alias("uncovered_files"),
    )


def lcov(reports: DataFrame) -> DataFrame:
    """``SF:`` opens a file, ``DA:line,hits`` is a line of it, ``end_of_record`` closes it.
    Hits that are no number count as none; a file without lines is an uncovered one."""
    records = let(F.split("text", r"(?m)^[ \t]*SF:"), lambda x: F.slice(x, F.lit(2), F.size(x)))

    def counted(own: Column) -> Column:
        lines = F.filter(F.transform(F.filter(own, lambda x: F.contains(x, F.lit("DA:"))), strip), lambda x: x.startswith("DA:"))
        data = F.filter(F.transform(lines, lambda x: F.split(F.substring(x, 4, 1 << 30), ",")), lambda x: F.size(x) >= 2)
        hits = lambda x: F.struct(_hits(F.transform(x, lambda y: y[1])).alias("hit"), F.size(x).alias("total"))
        return F.struct(strip(own[0]).alias("file"), let(data, hits).alias("n"))

    def one(record: Column) -> Column:
        body = F.split(record, r"(?m)^[ \t]*end_of_record", 2)[0]
        return let(let(text_lines(body), counted), lambda x: F.struct(x["file"].alias("file"), x["n"]["hit"].alias("hit"), x["n"]["total"].alias("total"), F.lit(True).alias("counts")))

    return _result(reports, "lcov", F.filter(F.transform(records, one), lambda x: x["file"] != ""))


def cobertura(reports: DataFrame) -> DataFrame:
    """Counts from the lines of all classes; rates from the root's attributes.  A report
    that isn't XML gives a result of zeros."""
    parsed = reports.withColumn("x", F.from_xml("text", COBERTURA, {"mode": "PERMISSIVE"}))
    none = F.array().cast("array<string>")
    listed = lambda lines: F.coalesce(F.transform(lines["line"], lambda x: x["_hits"]), none)

    def one(c: Column) -> Column:
        own = F.concat(listed(c["lines"]), F.coalesce(F.flatten(F.transform(c["methods"]["method"], lambda m: listed(m["lines"]))), none))
        return F.struct(F.coalesce(c["_filename"], F.lit("")).alias("file"), _hits(own).alias("hit"), F.size(own).alias("total"), F.lit(True).alias("counts"))

    nothing = F.array().cast(f"array<{CLASS}>")
    classes = F.flatten(F.transform("x.packages.package", lambda p: F.coalesce(p["classes"]["class"], nothing)))
    percent = lambda name: rounded(F.col("x")[name].try_cast("double") * 100, 2)
    return _result(parsed, "cobertura", F.transform(classes, one), F.coalesce(percent("_line-rate"), F.lit(0.0)), percent("_branch-rate"))


def istanbul(reports: DataFrame) -> DataFrame:
    """``source_files`` or ``coverage``, a list or a map by path; a statement counts as hit
    if its number is positive or it says ``executed``."""
    body = F.coalesce(F.get_json_object("text", "$.source_files"), F.get_json_object("text", "$.coverage"))
    by_path = lambda b: F.transform(F.map_entries(F.from_json(b, "map<string,string>")), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("json")))
    listed = lambda b: F.transform(F.from_json(b, "array<string>"), lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.path"), F.get_json_object(x, "$.file"), F.lit("")).alias("path"), x.alias("json")))

    def counted(values: Column, path: Column) -> Column:
        hit = F.size(F.filter(values, lambda v: F.coalesce(v.try_cast("bigint") > 0, F.get_json_object(v, "$.executed") == "true", F.lit(False))))
        total = F.when(values.isNull(), 0).otherwise(F.size(values))
        return F.struct(path.alias("file"), F.when(total > 0, hit).otherwise(0).alias("hit"), total.alias("total"), (total > 0).alias("counts"))

    def one(f: Column) -> Column:
        statements = F.coalesce(F.get_json_object(f["json"], "$.s"), F.get_json_object(f["json"], "$.statementMap"))
        return let(F.map_values(F.from_json(statements, "map<string,string>")), lambda values: counted(values, f["path"]))

    files = let(body, lambda b: F.transform(F.when(F.ltrim(b).startswith("["), listed(b)).otherwise(by_path(b)), one))
    return _result(reports, "istanbul", files)


def results(reports: DataFrame) -> DataFrame:
    """All reports by their extension; others give empty results of an unknown format."""
    end = F.regexp_extract("path", r"\.([^./]+)$", 1)
    known = reports.withColumn("text", F.coalesce("text", F.lit("")))
    other = known.where(~end.isin("xml", "json", "csv", "txt", "info", ""))
    parts = [cobertura(known.where(end == "xml")), istanbul(known.where(end == "json")), lcov(known.where(end.isin("csv", "txt", "info", "")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(_result(other, "unknown", F.lit(None).cast("array<struct<file: string, hit: int, total: int, counts: boolean>>")))
