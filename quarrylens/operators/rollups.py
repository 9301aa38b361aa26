"""Aggregations over activity, runs, issues, verification and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.numbers import rate, rounded


def touched(entity: str) -> Column:
    """The id of the entity an event touches: its own column, or the event's entity."""
    own = F.nullif(F.trim(F.col(f"{entity}_id")), F.lit(""))
    return F.coalesce(own, F.when(F.col("entity_type") == entity, F.col("entity_id")))


def activity_totals(activity: DataFrame) -> DataFrame:
    """One row of totals, distinct counts and the newest time."""
    return activity.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("actor_key").alias("actors"),
        F.count_distinct("action").alias("actions"),
        F.count_if(F.col("actor_kind") == "agent").alias("by_agents"),
        F.count_if(F.col("actor_kind") == "operator").alias("by_operators"),
        F.count_distinct(touched("issue")).alias("issues"),
        F.count_distinct(touched("run")).alias("runs"),
        F.max("created_at").alias("newest"),
    )


def top(df: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, n): the most frequent values; ties by key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(most)


def activity_overview(activity: DataFrame, most: int = 5) -> DataFrame:
    """(section, key, label, n): top actors, actions and entities.  An actor's label is
    the one of its oldest event."""
    actors = activity.groupBy(F.col("actor_key").alias("key")).agg(F.min_by("actor_label", F.struct("created_at", "activity_id")).alias("label"), F.count(F.lit(1)).alias("n"))
    parts = [actors.orderBy(F.desc("n"), "key").limit(most).select(F.lit("actors").alias("section"), "key", "label", "n")]
    for section, column in (("actions", "action"), ("entities", "entity_type")):
        parts.append(top(activity, column, most).select(F.lit(section).alias("section"), "key", F.col("key").alias("label"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cost_summary(runs: DataFrame, metrics: DataFrame, by: str) -> DataFrame:
    """Runs, cost and tokens by a dimension of the runs; runs without metrics count."""
    return runs.join(metrics, "run_id", "left").groupBy(F.col(by).alias("key")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("double").alias("cost"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
    )


def breakdown(history: DataFrame, key: str) -> DataFrame:
    """Runs, successes, failures, success rate and newest time by key."""
    s, n = F.count_if("success"), F.count(F.lit(1))
    return history.groupBy(key).agg(n.alias("total"), s.alias("succeeded"), (n - s).alias("failed"), rate(s, n).alias("success_rate"), F.max("created_at").alias("newest"))


def profile_report(history: DataFrame, profiles: DataFrame) -> DataFrame:
    """A row for each profile, those without history too."""
    good = F.col("success") & (F.col("attempt_count") <= 1)
    confidence = F.when(~F.col("success"), "low").when(good & F.col("item_passed"), "high").otherwise("medium")
    joined = profiles.join(history.withColumn("confidence", confidence), "profile_id", "left")
    n = F.count("run_id")
    s = F.count_if("success")
    return joined.groupBy("profile_id").agg(
        n.alias("total"), s.alias("succeeded"), rate(s, n).alias("success_rate"),
        F.coalesce(rounded(F.sum("attempt_count") / n, 2), F.lit(0.0)).alias("avg_attempts"),
        rate(F.count_if("item_passed"), n).alias("checklist_rate"),
        *(F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")),
    )


def drift_summary(issues: DataFrame) -> DataFrame:
    """Drift flags by what stands before their colon."""
    return issues.select(F.explode("drift_flags").alias("flag")).groupBy(F.substring_index("flag", ":", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_summary(issues: DataFrame) -> DataFrame:
    """The counters of a snapshot, in one pass."""
    fixed = (F.col("doc_status") == "fixed") | (F.col("code_status") == "fixed")
    return issues.agg(
        F.count(F.lit(1)).alias("issues_total"), F.count_if(fixed).alias("fixed_total"),
        F.count_if(F.col("issue_status").isin("open", "partial")).alias("open_total"),
        F.count_if("needs_followup").alias("followup_total"), F.sum(F.size("drift_flags")).alias("drift_total"),
    )


def vulnerability_rollup(findings: DataFrame) -> DataFrame:
    """By issue: findings, open ones, worst severity, and the scanners in order."""
    from quarrylens.operators.selection import severity_rank

    closed = F.col("status").isin("fixed", "verified", "closed")
    return findings.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~closed).alias("open"), F.min(severity_rank(F.col("severity"))).alias("worst"),
        F.count_distinct("scanner").alias("n_scanners"), F.array_join(F.array_sort(F.collect_set("scanner")), ",").alias("scanners"),
    )


def coverage_totals(lines: DataFrame) -> DataFrame:
    """By result: lines and files, covered ones, and the percentage of lines."""
    files = lines.groupBy("result_id", "file").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("hit"))
    return files.groupBy("result_id").agg(
        F.sum("total").alias("lines_total"), F.sum("hit").alias("lines_covered"), F.count(F.lit(1)).alias("files_total"),
        F.count_if(F.col("hit") > 0).alias("files_covered"), rate(F.sum("hit"), F.sum("total"), 2).alias("line_coverage"),
    )


def output_summary(lines: DataFrame) -> DataFrame:
    """By run: lines, assistant turns, first and last type, and the length of all text."""
    return lines.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "assistant").alias("tool_events"), F.min_by("type", "pos").alias("first_type"),
        F.max_by("type", "pos").alias("last_type"), (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("text_chars"),
    )


def consensus(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """yes if two or more say so, else no if two or more do, else unknown."""
    yes, no = F.count_if(F.col(vote) == "yes"), F.count_if(F.col(vote) == "no")
    return votes.groupBy(key).agg(yes.alias("yes"), no.alias("no"), F.when(yes >= 2, "yes").when(no >= 2, "no").otherwise("unknown").alias("consensus"))


def pairwise_ranks(variants: DataFrame) -> DataFrame:
    """Condorcet ranking of variants (issue_id, variant, status_rank, cost): a better
    status wins, then the lower cost; ranks by wins, losses, status, cost, name.

    Wins and losses are counted by rank functions, not by forming pairs: a variant
    beats all that stand strictly after it in (status, cost) order.
    """
    best = [F.desc("status_rank"), F.asc("cost")]
    issue = Window.partitionBy("issue_id")
    ahead = F.rank().over(issue.orderBy(*best)) - 1
    behind = F.rank().over(issue.orderBy(F.asc("status_rank"), F.desc("cost"))) - 1
    n = F.count(F.lit(1)).over(issue)
    counted = variants.withColumns({"n": n, "losses": ahead, "wins": behind}).where("n >= 2")
    place = F.row_number().over(issue.orderBy(F.desc("wins"), "losses", F.desc("status_rank"), "cost", "variant"))
    return counted.withColumn("place", place).drop("n")


def guidance_health(stale: Column, none: Column, lacking: Column) -> Column:
    """stale before missing before partial before healthy."""
    return F.when(stale, "stale").when(none, "missing").when(lacking, "partial").otherwise("healthy")


def weighted_vote(scenario: DataFrame, baseline: DataFrame, key: str, criteria: dict[str, tuple[int, bool]]) -> DataFrame:
    """(key, own, other, preferred): each criterion's weight goes to the better report.

    criteria: column to (weight, whether more is better).
    """
    side = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in criteria))
    both = side(scenario, "a").join(side(baseline, "b"), key)

    def votes(x: str, y: str) -> Column:
        total = F.lit(0)
        for c, (weight, more) in criteria.items():
            better = F.col(f"{x}_{c}") > F.col(f"{y}_{c}") if more else F.col(f"{x}_{c}") < F.col(f"{y}_{c}")
            total = total + better.cast("int") * weight
        return total

    own = both.select(key, votes("a", "b").alias("own"), votes("b", "a").alias("other"))
    return own.withColumn("preferred", F.when(F.col("own") > F.col("other"), "scenario").when(F.col("own") < F.col("other"), "baseline").otherwise("tie"))
