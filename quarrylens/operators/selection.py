"""Filters, look-ups and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _listed(values: list[str] | None) -> list[str]:
    return [v.strip() for v in values or [] if v.strip()]


def issue_filter(issues: DataFrame, q: str = "", severities=None, statuses=None, sources=None, labels=None, drift_only=False, needs_followup=None, review_ready_only=False) -> DataFrame:
    """The issue queue: every argument that is given narrows it; labels match any, in
    either case; ``q`` is sought in id, title and summary."""
    conditions: list[Column] = []
    for column, values in (("severity", severities), ("issue_status", statuses), ("source", sources)):
        if _listed(values):
            conditions.append(F.col(column).isin(*_listed(values)))
    if _listed(labels):
        wanted = F.array(*(F.lit(v.lower()) for v in _listed(labels)))
        conditions.append(F.coalesce(F.arrays_overlap(F.transform("labels", F.lower), wanted), F.lit(False)))
    if drift_only:
        conditions.append(F.size("drift_flags") > 0)
    if needs_followup is not None:
        conditions.append(F.col("needs_followup") == F.lit(needs_followup))
    if review_ready_only:
        conditions.append(F.col("review_ready_count") > 0)
    if q.strip():
        text = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("bug_id", "title", "summary")]
        conditions.append(reduce(lambda a, b: a | b, (t.contains(q.strip().lower()) for t in text)))
    return issues.where(reduce(lambda a, b: a & b, conditions)) if conditions else issues


def activity_filter(activity: DataFrame, issue_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Events of an issue or a run; a null id matches nothing."""
    for column, value in (("issue_id", issue_id), ("run_id", run_id)):
        if value:
            activity = activity.where(F.col(column) == value)
    return activity


def activity_search(activity: DataFrame, text: str, action: str = "all", entity_type: str = "all") -> DataFrame:
    """Free text over the joined fields of an event, nulls left out."""
    hay = F.lower(F.concat_ws(" ", "summary", "action", "entity_type", "entity_id", "actor_label", "issue_id", "run_id"))
    for column, value in (("action", action), ("entity_type", entity_type)):
        if value != "all":
            activity = activity.where(F.col(column) == value)
    return activity.where(hay.contains(text.strip().lower()))


def queue_presets(issues: DataFrame) -> DataFrame:
    """How many issues each preset of the queue holds, in one pass."""
    drift = F.size("drift_flags") > 0
    presets = {
        "critical_open": F.col("severity").isin("P0", "P1") & F.col("issue_status").isin("open", "triaged", "investigating", "in_progress"),
        "verification": F.col("issue_status") == "verification",
        "followup_drift": drift & F.col("needs_followup"),
        "source_drift": drift & F.col("source").isin("src0", "src1"),
    }
    return issues.agg(*(F.count_if(c).alias(name) for name, c in presets.items()))


def latest_per(df: DataFrame, keys: list[str], order: list[Column], salt: str) -> DataFrame:
    """The first row of each key in the order given; end it with a unique column.  The
    first of each of 16 parts (by the column ``salt``) comes before the first of all."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(16)))
    for own in ([*keys, "_part"], keys):
        part = part.withColumn("_place", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where("_place = 1")
    return part.drop("_place", "_part")


def severity_rank(column: Column) -> Column:
    """critical 0 ... info 4, anything else 99."""
    out = F.lit(99)
    for rank, name in reversed(list(enumerate(("critical", "high", "medium", "low", "info")))):
        out = F.when(column == name, rank).otherwise(out)
    return out


def ledger(key: str, order: str, kinds: list[tuple[str, DataFrame, int, Column | None, int]], most: int = 32) -> DataFrame:
    """(key, kind, id, score, place): rows of several kinds in one ranking for each key.

    kinds: (kind, rows of (key, order, id), base, bonus or None, most rows): a row scores
    base less its place in its own list, and the bonus; of equal (kind, id) the first counts.
    """
    every = None
    for kind, rows, base, bonus, first in kinds:
        i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
        placed = rows.withColumn("i", i).where(F.col("i") < first)
        score = F.lit(base) - F.col("i") + (F.lit(0) if bonus is None else bonus)
        own = placed.select(key, F.lit(kind).alias("kind"), "id", "i", F.greatest(F.lit(1), score).alias("score"))
        every = own if every is None else every.unionByName(own)
    one = every.groupBy(key, "kind", "id").agg(F.min_by("score", "i").alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "kind", F.lower("id"), "id"))
    return one.withColumn("place", place).where(F.col("place") <= most)
