"""Rules and scores over runs' outputs and issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import fed_lines, strip

#: Words that rules look for.
CRITICAL_WORDS = ("crash", "data loss", "security", "rce", "injection")
BREAKAGE_WORDS = ("break", "fail", "error", "wrong")
MARKERS = ("TODO", "FIXME", "HACK", "XXX")
SECRET_WORDS = ("password", "secret", "api_key", "token")
ENVIRONMENT_WORDS = ("env(", "os.environ", "getenv")
DESTRUCTIVE_WORDS = ("rm -rf", "del /s", "format c:", "drop table", "delete from")
EXECUTING_WORDS = ("os.system", "subprocess.call", "exec(", "eval(")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def patch_issues(text: Column, exit_code: Column, error: Column) -> Column:
    """What is wrong with a run's output, as an array of names."""
    low = F.lower(text)
    rules = {
        "non-zero exit": F.coalesce(exit_code != 0, F.lit(False)), "run error": F.coalesce(error != "", F.lit(False)), "traceback": low.contains("traceback"),
        "exception": low.contains("exception") & ~low.contains("caught"), "panic": low.contains("panic"), "segmentation fault": has_any(low, ("segmentation fault", "segfault")), "empty output": strip(text) == "",
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def correctness(text: Column, exit_code: Column, error: Column) -> Column:
    issues = patch_issues(text, exit_code, error)
    known = lambda name: F.array_contains(issues, name).cast("int")
    lost = 0.3 * known("non-zero exit") + 0.2 * known("run error") + 0.15 * known("traceback") + 0.15 * known("exception") + 0.4 * known("empty output")
    return F.greatest(F.lit(0.0), F.lit(1.0) - lost)


def completeness(text: Column, excerpt: Column, tool_events: Column, events: Column) -> Column:
    given = lambda weight, condition: F.lit(weight) * F.coalesce(condition, F.lit(False)).cast("int")
    return F.least(F.lit(1.0), given(0.3, strip(text) != "") + given(0.3, excerpt != "") + given(0.2, tool_events > 0) + given(0.2, events > 3))


def style(text: Column) -> Column:
    """0.3 for nothing; long lines cost."""
    sizes = F.transform(fed_lines(text), F.length)
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size(sizes)
    score = F.lit(0.7) - F.lit(0.1) * (mean > 200).cast("int") - F.lit(0.15) * (F.size(F.filter(sizes, lambda n: n > 500)) > 5).cast("int")
    return F.when(strip(text) == "", 0.3).otherwise(score)


def safety(text: Column) -> Column:
    """Destructive and executing words cost, and so does a panic; a segmentation fault
    doesn't, as its issue is not spelled the way the score looks for."""
    low = F.lower(text)
    lost = F.lit(0.4) * has_any(low, DESTRUCTIVE_WORDS).cast("int") + F.lit(0.2) * has_any(low, EXECUTING_WORDS).cast("int") + F.lit(0.3) * low.contains("panic").cast("int")
    return F.greatest(F.lit(0.0), F.lit(1.0) - lost)


def grade(mean: Column) -> Column:
    return F.when(mean >= 0.85, "excellent").when(mean >= 0.7, "good").when(mean >= 0.5, "acceptable").when(mean >= 0.3, "needs_work").otherwise("poor")


def critiques(outputs: DataFrame) -> DataFrame:
    """Scores and grade of (run_id, text, exit_code, error, excerpt, tool_events, events)."""
    text, code, error = F.col("text"), F.col("exit_code"), F.col("error")
    scored = outputs.select(
        "run_id", correctness(text, code, error).alias("correctness"), completeness(text, F.col("excerpt"), F.col("tool_events"), F.col("events")).alias("completeness"),
        style(text).alias("style"), safety(text).alias("safety"), F.size(patch_issues(text, code, error)).alias("n_issues"))
    return scored.withColumn("quality", grade((F.col("correctness") + F.col("completeness") + F.col("style") + F.col("safety")) / 4))


def improvements(lines: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` suggestions of each run from its lines (run_id, line_no, line)."""
    said = strip(F.col("line"))
    found = [F.when(said.contains(m), F.struct(F.lit(k).alias("rule"), F.lit(m).alias("found"), F.lit("maintainability").alias("category"), F.lit("low").alias("severity"))) for k, m in enumerate(MARKERS)]
    secret = has_any(F.lower(said), SECRET_WORDS) & ~has_any(said, ENVIRONMENT_WORDS)
    found.append(F.when(secret, F.struct(F.lit(len(MARKERS)).alias("rule"), F.lit("secret").alias("found"), F.lit("security").alias("category"), F.lit("high").alias("severity"))))
    rows = lines.select("run_id", "line_no", F.inline(F.array_compact(F.array(*found))))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("line_no", "rule", "found", "category", "severity"))), 1, most)
    return rows.groupBy("run_id").agg(listed.alias("own")).select("run_id", F.inline("own"))


def triage(issues: DataFrame) -> DataFrame:
    """A suggested severity, labels and confidence of each issue; a severity is suggested
    only where none is given, or ``medium``."""
    impact, empty = F.lower(F.coalesce("impact", F.lit(""))), F.coalesce(F.col("severity").isin("", "medium"), F.lit(True))
    worst = empty & has_any(impact, CRITICAL_WORDS)
    broken = empty & ~worst & has_any(impact, BREAKAGE_WORDS)
    many = empty & ~worst & ~broken & (F.size("evidence_paths") >= 3)
    silent, verdict = F.exists("drift_flags", lambda x: x.contains("exception_swallow")), F.col("source") == "verdict"
    labels = F.array_distinct(F.concat("labels", F.array_compact(F.array(F.when(silent, "silent-failure"), F.when(verdict, "verdict-derived")))))
    weight = lambda w, c: F.lit(w) * F.coalesce(c, F.lit(False)).cast("int")
    confidence = weight(0.3, worst) + weight(0.25, broken) + weight(0.2, many) + weight(0.15, silent) + weight(0.1, verdict)
    return issues.select(
        "bug_id", F.when(worst, "critical").when(broken | many, "high").alias("suggested_severity"),
        F.when(F.size(labels) == 0, F.array(F.lit("needs-triage"))).otherwise(labels).alias("suggested_labels"), F.least(F.round(confidence, 2), F.lit(1.0)).alias("confidence"))


def similarity(title: Column, summary: Column, same_severity: Column, paths: Column, labels: Column) -> Column:
    """A duplicate's score from the Jaccard similarities of its parts."""
    part = lambda s, least, weight: F.when(s > least, s * weight).otherwise(0.0)
    score = part(title, 0.5, 0.35) + part(summary, 0.4, 0.25) + F.lit(0.1) * same_severity.cast("int") + paths * 0.2 + labels * 0.1
    return F.floor(F.least(score, F.lit(1.0)) * 1000 + 0.5) / 1000


def test_files(issue_paths: Column, severity: Column, most: int = 5) -> Column:
    """Tests to write for an issue: one beside each of its first files, or a general one."""
    urgent = F.when(F.lower(severity).isin("critical", "high"), "high").otherwise("medium")

    def beside(path: Column) -> Column:
        return F.struct(F.regexp_replace(path, r"^(.*?)(\.[^./]+)?$", "$1.test$2").alias("file"), urgent.alias("priority"))

    general = F.array(F.struct(F.lit("tests/regression").alias("file"), urgent.alias("priority")))
    return F.when(F.size(issue_paths) == 0, general).otherwise(F.transform(F.slice(issue_paths, 1, most), beside))


def acceptance(criterion: Column, corpus: Column, most: int = 6) -> Column:
    """met, partial, not_met or unknown: how many of a criterion's first tokens occur."""
    from quarrylens.functions.text import matched, query_tokens

    terms = F.slice(query_tokens(criterion), 1, most)
    found, needed = F.size(matched(terms, corpus)), F.least(F.lit(2), F.greatest(F.lit(1), F.size(terms)))
    return F.when(F.size(terms) == 0, "unknown").when(found >= needed, "met").when(found > 0, "partial").otherwise("not_met")


def out_of_scope(dirty: Column, focus: Column) -> Column:
    """Changed paths that neither are, hold, nor lie below one of the focus paths."""
    def related(path: Column) -> Column:
        return F.exists(focus, lambda f: (path == f) | path.startswith(F.concat(f, F.lit("/"))) | f.startswith(F.concat(path, F.lit("/"))))

    return F.filter(dirty, lambda p: ~related(p))


def confidence(success: Column, failed_items: Column, attempts: Column) -> Column:
    return F.when(~success, "low").when((failed_items > 0) | (attempts > 1), "medium").otherwise("high")
