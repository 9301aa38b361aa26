"""What git prints, as relations: changes since a reference, and a worktree's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import git_status



def since_ref(lines: DataFrame) -> DataFrame:
    """Changes of the lines (pos, line) of ``git diff --name-status``."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.where(F.size(parts) >= 2).withColumn("p", parts)
    renamed = F.col("p")[0].startswith("R") & (F.size("p") >= 3)
    return rows.select(
        "pos", F.element_at("p", -1).alias("path"), git_status(F.col("p")[0]).alias("status"), F.lit("since_ref").alias("scope"),
        F.when(renamed, F.col("p")[1]).alias("previous_path"), F.lit(False).alias("staged"), F.lit(False).alias("unstaged"))


def working_tree(lines: DataFrame) -> DataFrame:
    """Changes of the lines (pos, line) of ``git status --porcelain=v1``."""
    code, rest = F.left("line", F.lit(2)), F.trim(F.substring("line", 4, 1 << 30))
    status = F.when(code.startswith("??"), "untracked").otherwise(git_status(F.trim(code)))
    return lines.where(F.length("line") >= 4).select(
        "pos", F.trim(F.substring_index(rest, " -> ", -1)).alias("path"), status.alias("status"), F.lit("working_tree").alias("scope"), F.lit(None).cast("string").alias("previous_path"),
        (~F.left(code, F.lit(1)).isin(" ", "?")).alias("staged"), (F.substring(code, 2, 1) != " ").alias("unstaged"))


def changes(diff: DataFrame, status: DataFrame) -> DataFrame:
    """Both kinds of changes, one a scope and path: the later line counts."""
    every = since_ref(diff).unionByName(working_tree(status))
    rest = ("status", "previous_path", "staged", "unstaged")
    return every.groupBy("scope", "path").agg(F.max_by(F.struct(*rest), "pos").alias("c")).select("path", "scope", *(f"c.{c}" for c in rest))


def worktree(lines: DataFrame, listed: int = 20) -> DataFrame:
    """One row of the lines (pos, line) of ``git status --branch --porcelain=v2``."""
    line = F.col("line")
    after = lambda prefix: F.max(F.when(line.startswith(prefix), F.nullif(F.trim(F.replace(line, F.lit(prefix), F.lit(""))), F.lit(""))))
    new, changed = line.startswith("? "), line.rlike(r"^[12u] ") & (F.size(F.split(line, r"\s+")) >= 3)
    path = F.when(new, F.trim(F.substring(line, 3, 1 << 30))).when(changed, F.element_at(F.split(F.trim(line), r"\s+"), -1))
    number = lambda sign: F.coalesce(F.max(F.when(line.startswith("# branch.ab "), F.regexp_extract(line, rf"\{sign}(\d+)", 1).try_cast("int"))), F.lit(0))
    dirty = F.array_sort(F.collect_list(F.when(path.isNotNull(), F.struct("pos", path.alias("path")))))
    return lines.agg(
        after("# branch.head ").alias("branch"), F.nullif(after("# branch.oid "), F.lit("(initial)")).alias("head_sha"), number("+").alias("ahead"), number("-").alias("behind"),
        F.count_if(new | changed).alias("dirty_files"), F.count_if(changed & (F.substring(F.split(line, r"\s+")[1], 1, 1) != ".")).alias("staged_files"), F.count_if(new).alias("untracked_files"),
        F.slice(F.transform(dirty, lambda x: x["path"]), 1, listed).alias("dirty_paths"),
    )
