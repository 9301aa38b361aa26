"""Bug ledgers in Markdown and verdict bundles in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import evidence_of, strip, text_lines
from quarrylens.functions.text import fix_status

HEADER = r"###\s+(P\d_\d{2}M\d{2}_\d{3})\.\s+([^\r\n]*)"
STATUS = r"^- Status \(([^)]+)\):\s*(.*)$"


def issues(ledgers: DataFrame) -> DataFrame:
    """Issues of (path, text): a header opens a block, its lines fill the fields.

    A line's mode is set by the last line above that opens evidence, verification or
    neither; modes are carried forward within a block, so no task sees more than one.
    """
    blocks = ledgers.select("path", F.posexplode(F.split("text", rf"(?m)(?=^{HEADER})")).alias("block", "body")).where(F.col("body").rlike(f"^{HEADER}"))
    head = F.regexp_extract("body", f"^{HEADER}", 0)
    rows = blocks.select("path", "block", F.regexp_extract("body", HEADER, 1).alias("bug_id"), F.regexp_extract("body", HEADER, 2).alias("title"), F.posexplode(text_lines(F.substring(F.col("body"), F.length(head) + 1, F.length("body")))).alias("pos", "raw"))
    line = strip(F.col("raw"))
    status = F.col("raw").rlike(STATUS)
    rows = rows.withColumns({
        "line": line, "is_status": status,
        "opens": F.when(line.startswith("- Evidence:"), "evidence").when(line.startswith("- Verification/update evidence:"), "verification").when(line.rlike(r"^- (Remaining gap:|Correction)"), "none"),
    })
    at = Window.partitionBy("path", "block").orderBy("pos")
    rows = rows.withColumn("mode", F.coalesce(F.last("opens", ignorenulls=True).over(at), F.lit("none")))
    said = F.substring("line", 3, 1 << 30)
    plain = ~line.rlike("^- (Summary|Impact):") & F.col("opens").isNull() & ~F.col("is_status") & F.col("line").startswith("- ")
    proof = plain & (F.col("mode") != "none") & (F.col("line").contains("pytest") | F.col("line").contains("npm run"))
    ordered = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", value.alias("v"))))), lambda x: x["v"])
    field = lambda name: F.max_by(F.when(F.col("line").startswith(f"- {name}:"), F.trim(F.substring("line", len(name) + 4, 1 << 30))), F.when(F.col("line").startswith(f"- {name}:"), F.col("pos")))
    last_status = lambda group: F.max_by(F.when(F.col("is_status"), F.regexp_extract("raw", STATUS, group)), F.when(F.col("is_status"), F.col("pos")))
    found = rows.groupBy("path", "block", "bug_id", "title").agg(
        field("Summary").alias("summary"), field("Impact").alias("impact"), last_status(1).alias("verified_at"), F.coalesce(fix_status(last_status(2)), F.lit("open")).alias("doc_status"),
        F.flatten(ordered(plain & (F.col("mode") == "evidence"), evidence_of(F.col("line")))).alias("evidence"),
        F.flatten(ordered(plain & (F.col("mode") == "verification"), evidence_of(F.col("line")))).alias("verification_evidence"),
        ordered(proof, strip(said)).alias("tests_passed"),
        ordered(plain & (F.col("mode") == "none") & F.col("line").contains("test/"), strip(said)).alias("tests_added"),
        F.nullif(F.array_join(ordered(F.col("opens") == "none", strip(said)), " | "), F.lit("")).alias("notes"),
    )
    issue_status = F.when(F.col("doc_status").isin("fixed", "resolved"), "resolved").when(F.col("doc_status") == "partial", "partial").otherwise("open")
    return found.select(
        "bug_id", "title", F.substring_index("bug_id", "_", 1).alias("severity"), issue_status.alias("issue_status"), F.lit("ledger").alias("source"), F.col("path").alias("source_doc"), "doc_status",
        "summary", "impact", "evidence", "verification_evidence", "tests_added", "tests_passed", "notes", "verified_at", F.lit("ledger").alias("verified_by"),
        (F.col("doc_status") != "fixed").alias("needs_followup"), F.sha1(F.concat_ws(":", "path", "bug_id", "title")).alias("fingerprint"),
    )


def verdicts(bundles: DataFrame) -> DataFrame:
    """(path, pos, bug_id, verdict, item) of (path, text): a list of verdicts, or one under
    ``verdicts``; entries that aren't objects are left out."""
    text = F.ltrim("text")
    body = F.when(text.startswith("["), text).otherwise(F.get_json_object("text", "$.verdicts"))
    rows = bundles.select("path", F.posexplode(F.from_json(body, "array<string>")).alias("pos", "item")).where(F.ltrim("item").startswith("{"))
    pick = lambda *names: F.coalesce(*(F.get_json_object("item", f"$.{n}") for n in names))
    return rows.select("path", "pos", pick("id", "bug_id").alias("bug_id"), pick("verdict", "status").alias("verdict"), "item")
