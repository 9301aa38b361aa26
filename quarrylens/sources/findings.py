"""Scanner findings from SARIF and Nessus JSON, one row of (path, text) a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.arrays import ordered_distinct
from quarrylens.functions.paths import taxonomy_ids
from quarrylens.functions.text import blank_to_null, stable_id

PROPERTIES = "map<string, string>"
RULE = f"struct<id: string, shortDescription: struct<text: string>, helpUri: string, help_uri: string, properties: {PROPERTIES}>"
PLACE = "struct<physicalLocation: struct<artifactLocation: struct<uri: string, uriBaseId: string>, region: struct<startLine: int>>>"
RESULT = f"struct<ruleId: string, rule_id: string, level: string, message: struct<text: string>, properties: {PROPERTIES}, locations: array<{PLACE}>>"
RUN = f"struct<tool: struct<driver: struct<name: string, rules: array<{RULE}>>>, results: array<string>>"
ITEM = (
    "struct<plugin_name: string, pluginName: string, name: string, synopsis: string, description: string, "
    "plugin_output: string, output: string, risk_factor: string, severity: string, path: string, file: string, uri: string, line: string, see_also: string, "
    "references: string, cwe: string, cwe_ids: string, cve: string, cves: string, solution: string, host: string>"
)
#: Names of severities as scanners give them.
SEVERITIES = {
    "critical": ("critical", "crit", "4", "very-high"), "high": ("high", "error", "3", "important"),
    "medium": ("medium", "moderate", "warning", "warn", "2"), "low": ("low", "note", "1"),
}


def severity(value: Column, is_number: Column | None = None) -> Column:
    """A severity from a scanner's name or number.

    A number written as text counts only where it is one of the listed ones; a JSON
    number (``is_number``) falls into its band.
    """
    low = F.lower(F.trim(value))
    named = F.lit("info")
    for name, words in reversed(SEVERITIES.items()):
        named = F.when(low.isin(*words), name).otherwise(named)
    if is_number is None:
        return named
    n = value.try_cast("double")
    band = F.when(n >= 4, "critical").when(n >= 3, "high").when(n >= 2, "medium").when(n >= 1, "low").otherwise("info")
    return F.when(is_number, band).otherwise(named)


def sarif(reports: DataFrame) -> DataFrame:
    """Findings of (path, text): each result with the rule of its tool that it names, the
    first place only; reports that aren't SARIF have none."""
    runs = reports.select(F.col("path").alias("report"), F.explode(F.from_json(F.get_json_object("text", "$.runs"), f"array<{RUN}>")).alias("run"))
    rows = runs.select("report", F.coalesce("run.tool.driver.name", F.lit("sarif")).alias("scanner"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("raw_payload"))
    rows = rows.withColumn("r", F.from_json("raw_payload", RESULT)).withColumn("rule_id", F.coalesce(blank_to_null(F.col("r.ruleId")), blank_to_null(F.col("r.rule_id"))))
    # the last rule of an id counts
    rows = rows.withColumn("rule", F.try_element_at(F.filter("rules", lambda x: x["id"] == F.col("rule_id")), F.lit(-1)))
    own = F.col("r.properties")
    properties = F.when(own.isNotNull() & (F.size(own) > 0), own).otherwise(F.col("rule.properties"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    message, short = F.coalesce("r.message.text", F.lit("")), F.coalesce("rule.shortDescription.text", F.lit(""))
    said = F.concat(F.coalesce(F.from_json(F.coalesce(properties["tags"], F.lit("[]")), "array<string>"), F.array().cast("array<string>")), F.array(F.coalesce("rule_id", F.lit("")), message, short))
    title = F.coalesce(F.nullif(short, F.lit("")), F.col("rule_id"), F.nullif(message, F.lit("")), F.lit("SARIF finding"))
    asked = F.coalesce(properties["security-severity"], F.col("r.level"), properties["problem.severity"])
    number = properties["security-severity"].isNotNull() & F.get_json_object("raw_payload", "$.properties").rlike(r'"security-severity"\s*:\s*[0-9.]')
    out = rows.select(
        "report", "scanner", F.lit("sarif").alias("source"), severity(asked, F.coalesce(number, F.lit(False))).alias("severity"), F.lit("open").alias("status"), title.alias("title"),
        F.trim(message).alias("summary"), "rule_id", F.coalesce(blank_to_null(place["artifactLocation"]["uri"]), blank_to_null(place["artifactLocation"]["uriBaseId"])).alias("location_path"),
        place["region"]["startLine"].alias("location_line"), taxonomy_ids(said, "cwe").alias("cwe_ids"), taxonomy_ids(said, "cve").alias("cve_ids"),
        F.array_compact(F.array(F.coalesce(blank_to_null(F.col("rule.helpUri")), blank_to_null(F.col("rule.help_uri"))))).alias("references"),
        F.array_compact(F.array(blank_to_null(message))).alias("evidence"), "raw_payload",
    )
    return _identified(out)


def _identified(findings: DataFrame) -> DataFrame:
    """With an id that the same finding gets in every import."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "scanner", "rule_id", "title", "location_path", "location_line")]
    return findings.withColumn("finding_id", stable_id("vf_", *parts))


def _texts(value: Column) -> Column:
    """A JSON list of texts, or one text, as an array."""
    listed = F.from_json(value, "array<string>")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.array().cast("array<string>")).when(F.trim(value).startswith("["), F.coalesce(listed, F.array(value))).otherwise(F.array(value))


def nessus(reports: DataFrame) -> DataFrame:
    """Findings of (path, text): items of the four top lists, of ReportHost and of hosts;
    an item without a host takes its host's name."""
    top = [F.from_json(F.get_json_object("text", f"$.{k}"), "array<string>") for k in ("findings", "vulnerabilities", "issues", "results")]
    none = F.array().cast("array<string>")
    pairs = lambda items, host: F.transform(F.coalesce(items, none), lambda x: F.struct(x.alias("json"), host.cast("string").alias("host")))
    report_hosts = F.from_json(F.get_json_object("text", "$.ReportHost"), "array<struct<name: string, ReportItem: array<string>>>")
    hosts = F.from_json(F.get_json_object("text", "$.hosts"), "array<struct<host: string, findings: array<string>, items: array<string>, report_items: array<string>, vulnerabilities: array<string>>>")
    nothing = F.array().cast("array<struct<json: string, host: string>>")
    every = F.concat(
        *(pairs(x, F.lit(None)) for x in top),
        F.coalesce(F.flatten(F.transform(report_hosts, lambda h: pairs(h["ReportItem"], h["name"]))), nothing),
        F.coalesce(F.flatten(F.transform(hosts, lambda h: F.concat(*(pairs(h[k], h["host"]) for k in ("findings", "items", "report_items", "vulnerabilities"))))), nothing),
    )
    rows = reports.select(F.col("path").alias("report"), F.explode(every).alias("e")).select("report", F.col("e.json").alias("raw_payload"), F.col("e.host").alias("outer"), F.from_json("e.json", ITEM).alias("i")).where(F.col("raw_payload").startswith("{"))
    i = F.col("i")
    first = lambda *names: F.coalesce(*(blank_to_null(i[n]) for n in names))
    # two of these names differ in case alone, which a schema can't hold
    plugin = F.coalesce(*(F.get_json_object("raw_payload", f"$.{n}") for n in ("plugin_id", "pluginID", "pluginId")))
    asked = F.coalesce(blank_to_null(i["risk_factor"]), blank_to_null(i["severity"]))
    number = blank_to_null(i["risk_factor"]).isNull() & F.col("raw_payload").rlike(r'"severity"\s*:\s*[0-9.]')
    ids = F.concat(*(_texts(i[k]) for k in ("cwe", "cwe_ids", "cve", "cves")))
    out = rows.select(
        "report", F.lit("nessus").alias("scanner"), F.lit("nessus-json").alias("source"), severity(asked, F.coalesce(number, F.lit(False))).alias("severity"), F.lit("open").alias("status"),
        F.coalesce(first("plugin_name", "pluginName", "name", "synopsis"), F.lit("Nessus finding")).alias("title"), F.coalesce(first("synopsis", "description", "plugin_output", "output"), F.lit("")).alias("summary"),
        F.concat(F.lit("plugin-"), plugin).alias("rule_id"), first("path", "file", "uri").alias("location_path"), i["line"].try_cast("int").alias("location_line"),
        taxonomy_ids(ids, "cwe").alias("cwe_ids"), taxonomy_ids(ids, "cve").alias("cve_ids"), ordered_distinct(F.concat(_texts(F.coalesce(i["see_also"], i["references"]))), 12).alias("references"),
        ordered_distinct(F.array_compact(F.array(i["plugin_output"], i["description"], i["solution"])), 12).alias("evidence"), "raw_payload", F.coalesce(i["host"], F.col("outer")).alias("host"),
    )
    return _identified(out)
