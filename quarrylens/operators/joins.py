"""Joins of issues, runs, fixes, reviews, findings and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import glob_pattern
from quarrylens.functions.text import blank_to_null
from quarrylens.operators import duplicates


def review_ready(runs: DataFrame, fixes: DataFrame, reviews: DataFrame, most: int = 8) -> DataFrame:
    """(issue_id, n, run_ids): completed runs with neither a fix nor a review; all are
    counted, the newest ``most`` are listed: of each part of an issue's runs, then of those."""
    open_ = runs.where("status = 'completed'").join(fixes, "run_id", "left_anti").join(reviews, "run_id", "left_anti").select("issue_id", "run_id", "created_at")
    counted = open_.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n"))
    newest = open_.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(16)))
    for keys in (["issue_id", "part"], ["issue_id"]):
        newest = newest.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("run_id")))).where(F.col("place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("place", "run_id")))
    return counted.join(newest.groupBy("issue_id").agg(F.transform(listed, lambda x: x["run_id"]).alias("run_ids")), "issue_id")


def with_verdicts(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Issues with the code status of their last verdict and what it contradicts.

    verdicts: (bug_id, pos, verdict); of repeated ids the later one counts.
    """
    last = verdicts.groupBy("bug_id").agg(F.max_by("verdict", "pos").alias("verdict"))
    joined = issues.join(last, "bug_id", "left").withColumn("code_status", F.coalesce("verdict", "code_status"))
    flag = (
        F.when((F.col("doc_status") == "fixed") & (F.col("code_status") != "fixed"), "doc_fixed_code_not_fixed")
        .when((F.col("code_status") == "fixed") & (F.col("doc_status") != "fixed"), "code_fixed_doc_not_fixed")
    )
    return joined.withColumn("flag", flag)


def tracker_merge(imported: DataFrame, tracked: DataFrame, texts: list[str], always: list[str], key: str = "bug_id") -> DataFrame:
    """Full outer join: a tracked text wins unless blank, ``always`` columns are the
    tracked ones wherever there are any, labels are the sorted union."""
    t = tracked.select(key, F.lit(True).alias("_t"), *(F.col(c).alias(f"t_{c}") for c in [*texts, *always, "labels"]))
    j = imported.join(t, key, "full_outer")
    empty = F.array().cast("array<string>")
    return j.select(
        key,
        *(F.coalesce(blank_to_null(F.col(f"t_{c}")), F.col(c)).alias(c) for c in texts),
        *(F.when(F.col("_t"), F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in always),
        F.array_sort(F.array_union(F.coalesce("labels", empty), F.coalesce("t_labels", empty))).alias("labels"),
    )


def patched(df: DataFrame, patches: DataFrame, columns: list[str], key: str = "bug_id") -> DataFrame:
    """Left join of a sparse patch: only values that are present and not blank replace."""
    p = patches.select(key, *(F.col(c).alias(f"p_{c}") for c in columns))
    return df.join(p, key, "left").select(*(F.coalesce(blank_to_null(F.col(f"p_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with their key; others are added."""
    return old.join(new, keys, "left_anti").unionByName(new)


def array_membership(left: DataFrame, ids: str, dim: DataFrame, dim_key: str, value: str) -> DataFrame:
    """The dimension's value of each listed id, in the list's order; unknown ids go."""
    keys = [c for c in left.columns if c != ids]
    opened = left.select(*keys, F.posexplode(ids).alias("pos", dim_key))
    joined = opened.join(dim.select(dim_key, value), dim_key)
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return joined.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias("values"))


def similar_titles(issues: DataFrame, asked: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of an asked issue and another whose title's words have a Jaccard of
    ``least`` or more.

    There may be as many as asked issues times all, so none is shuffled: the asked titles
    meet all others in blocks, and each pair found leaves its task as a result.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda x: x != ""))
    own = lambda df: df.select("bug_id", words.alias("t"))
    found = duplicates.alike(own(issues), own(asked), least)
    id_ = issues.schema["bug_id"].dataType
    return found.withColumns({c: F.col(c).cast(id_) for c in ("a", "b")})


def full_delta(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """FULL OUTER by key, an absent side counts as 0; ``delta_*`` is b minus a."""
    right = b.select(key, *(F.col(v).alias(f"b_{v}") for v in values))
    j = a.select(key, *values).join(right, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(key, *(zero(v).alias(f"a_{v}") for v in values), *(zero(f"b_{v}").alias(f"b_{v}") for v in values), *((zero(f"b_{v}") - zero(v)).alias(f"delta_{v}") for v in values))


def glob_matches(rows: DataFrame, globs: DataFrame) -> DataFrame:
    """Rows (path, ...) with the globs (glob, ...) that they match.  Both meet on the
    directories before a glob's first wildcard: a path on each directory above it."""
    fixed = F.regexp_extract("glob", r"^((?:[^*?\[/]*/)*)", 1)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k), F.when(k > 0, F.lit(""))))
    known = globs.select("*", fixed.alias("_root"), glob_pattern(F.col("glob")).alias("_pattern"))
    opened = rows.withColumn("_root", F.explode(F.array_distinct(above)))
    return opened.join(known, "_root").where(F.expr("path RLIKE _pattern")).drop("_root", "_pattern")
