"""Source trees as relations: files, their lines, the repository map, signals and symbols.

Everything works on one row per file or line, so a tree of any size is read by as many
tasks as it has files; no step but ``symbols`` shuffles, by path.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import paths


def files(spark: SparkSession, root: str, content: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, size, modified_at[, text]) of the files below ``root``, paths relative to it.

    Without ``content`` Spark lists the files and reads none.  ``text`` is null where a
    file isn't UTF-8.  Spark's reader passes over files of no bytes, so they aren't listed.
    """
    place = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    below = F.element_at(F.split(F.col("path"), re.escape(place), 2), -1)
    columns = [below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")]
    if content:
        columns.append(F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return reader.load(root).select(*columns)


def lines(texts: DataFrame, of: Callable[[Column], Column] = paths.text_lines) -> DataFrame:
    """(path, line_no, line) of (path, text): lines count from 1; null texts have none."""
    return texts.where("text is not null").select("path", F.posexplode(of(F.col("text"))).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def repo_map(tree: DataFrame) -> DataFrame:
    """(path, role, size) of the files with a role, outside skipped directories."""
    path = F.col("path")
    return tree.where(~paths.is_skipped(path, "target")).select("path", paths.map_role(path).alias("role"), "size").where("role is not null")


def repo_map_totals(mapped: DataFrame) -> DataFrame:
    """One row: files in all, source files, tests, bytes and top directories."""
    return mapped.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("role").isin("source", "entry")).alias("source_files"),
        F.count_if(F.col("role") == "test").alias("test_files"), F.sum("size").alias("total_bytes"), F.count_distinct(F.split("path", "/")[0]).alias("top_entries"),
    )


def signals(tree: DataFrame) -> DataFrame:
    """Discovery signals of the scanned files of (path, text), a row for each kind that a
    line shows."""
    own = lines(tree.where(paths.is_scanned(F.col("path"))))
    found = own.select(F.col("path").alias("file_path"), F.col("line_no").alias("line"), F.inline(paths.signals_of(F.col("path"), F.col("line_no"), F.col("line"))))
    return found.withColumns({"signal_id": F.concat(F.lit("sig_"), F.left("fingerprint", F.lit(12))), "tags": F.array(F.col("kind"), F.lit("auto-discovery"))})


def symbols(tree: DataFrame, most: int = 48) -> DataFrame:
    """(path, symbol, kind, line_start, enclosing_scope): the first ``most`` symbols of
    each scanned file; the scope is the last class or type named above."""
    found = lines(tree.where(paths.is_scanned(F.col("path"), "target"))).withColumn("s", paths.symbol_of(F.col("line"))).where("s is not null")
    by_line = Window.partitionBy("path").orderBy("line_no")
    scope = F.last(F.when(F.col("s.kind").isin("class", "type"), F.col("s.symbol")), ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    placed = found.withColumns({"place": F.row_number().over(by_line), "enclosing_scope": scope})
    return placed.where(F.col("place") <= most).select("path", "s.symbol", "s.kind", F.col("line_no").alias("line_start"), "enclosing_scope")


def explained(tree: DataFrame) -> DataFrame:
    """(path, role, line_count, import_count) of (path, text)."""
    own = paths.text_lines(F.col("text"))
    return tree.where("text is not null").select("path", F.coalesce(paths.map_role(F.col("path")), F.lit("source")).alias("role"), F.size(own).alias("line_count"), paths.import_lines(own).alias("import_count"))


def directory(tree: DataFrame, at: str = "", most: int = 80) -> DataFrame:
    """(name, is_dir, has_children): what stands directly below ``at``; directories first."""
    prefix = at.strip("/") + "/" if at.strip("/") else ""
    below = tree.where(F.col("path").startswith(prefix)).select(F.split(F.substring(F.col("path"), len(prefix) + 1, 1 << 30), "/").alias("parts"))
    one = below.groupBy(F.col("parts")[0].alias("name")).agg((F.max(F.size("parts")) > 1).alias("is_dir"))
    return one.withColumn("has_children", F.col("is_dir")).orderBy(F.desc("is_dir"), F.lower("name"), "name").limit(most)


def latest_ledger(tree: DataFrame) -> DataFrame:
    """One row: the last bug ledger by name, null if there is none."""
    own = tree.where(F.col("path").rlike(r"^docs/bugs/Bugs_[^/]*\.md$") & ~F.col("path").contains("_status_"))
    return own.agg(F.max("path").alias("path"))


def manifests(tree: DataFrame) -> DataFrame:
    """Package manifests at most two directories deep."""
    path = F.col("path")
    return tree.where((paths.file_name(path) == "package.json") & (F.size(F.split(path, "/")) <= 3) & ~paths.is_skipped(path)).select("path")


def targets(tree: DataFrame) -> DataFrame:
    """(kind, command, source_path, confidence): what can be run: make targets, package
    scripts and compose files; of one command the surest source counts."""
    path, text = F.col("path"), F.col("text")
    name = paths.file_name(path)
    made = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z0-9_.-]+)\s*:(?!=)"), 1), lambda t: ~t.startswith("."))
    scripts = F.map_keys(F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>"))
    make = tree.where(name == "Makefile").select(F.explode(made).alias("label"), F.concat(F.lit("make "), F.col("label")).alias("command"), "path", F.lit(80).alias("confidence"))
    npm = tree.where(name == "package.json").select(F.explode(scripts).alias("label"), F.concat(F.lit("npm run "), F.col("label")).alias("command"), "path", F.lit(85).alias("confidence"))
    compose = tree.where(name.rlike(r"^(docker-)?compose\.ya?ml$")).select(F.lit("compose").alias("label"), F.concat(F.lit("docker compose -f "), path, F.lit(" up")).alias("command"), "path", F.lit(75).alias("confidence"))
    from quarrylens.functions.text import target_kind

    every = make.unionByName(npm).unionByName(compose).withColumn("kind", target_kind(F.col("label")))
    best = every.groupBy("kind", "command").agg(F.max_by(F.struct("label", F.col("path").alias("source_path"), "confidence"), F.struct("confidence", "path")).alias("b"))
    return best.select("kind", "command", "b.*")


def explanation() -> Column:
    """A sentence on a file of ``explained`` with its number of ``symbols``."""
    return F.format_string("%s is a %s file with %d lines, %d import-like lines and %d symbols.", "path", "role", "line_count", "import_count", "symbols")


#: Where guidance stands: path or folder, kind, always on, priority.
GUIDANCE = (
    ("AGENTS.md", "agent_instructions", True, 10), ("agents.md", "agent_instructions", True, 10), ("CLAUDE.md", "agent_instructions", True, 12), ("GEMINI.md", "agent_instructions", True, 12),
    (".openhands/microagents/repo.md", "agent_instructions", True, 14), ("CONVENTIONS.md", "conventions", True, 20), (".clinerules", "conventions", True, 22), (".devin/wiki.json", "repo_index", True, 25),
    ("README.md", "workspace_overview", False, 60), (".openhands/microagents/", "agent_instructions", True, 28), (".openhands/skills/", "skill", False, 30), (".agents/skills/", "skill", False, 32), (".cursor/rules/", "conventions", False, 34),
)


def guidance_places(spark: SparkSession) -> DataFrame:
    """``GUIDANCE`` as a dimension for ``guidance``."""
    return spark.createDataFrame(GUIDANCE, "path string, kind string, always_on boolean, priority int")


def guidance(tree: DataFrame, known: DataFrame, most: int = 6) -> DataFrame:
    """Guidance files: the tree's files that a dimension (path, kind, always_on, priority)
    names, or that lie below a directory named there (path ends in /).  A file meets the
    dimension on its own path and on each directory above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.when(k == F.size(parts), F.col("path")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    opened = tree.select("path", F.explode(above).alias("rule")).where(~F.col("rule").endswith("/") | F.col("path").rlike(r"(?i)\.(md|mdc|json)$"))
    found = opened.join(known.withColumnRenamed("path", "rule"), "rule")
    one = found.groupBy(F.lower("path").alias("key")).agg(F.min_by(F.struct("path", "kind", "always_on", "priority"), F.struct("priority", "path")).alias("g"))
    return one.select("g.*").orderBy("priority", F.lower("path"), "path").limit(most)
