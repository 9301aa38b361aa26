"""Impact, retrieval and the semantic index over a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import paths
from quarrylens.functions.text import matched
from quarrylens.operators.duplicates import first_of
from quarrylens.operators.joins import glob_matches
from quarrylens.operators.reviews import test_files
from quarrylens.sources import trees


#: Letters of the pieces on which terms and texts meet.
GRAM = 6


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)(.)"), 1)


def grams(own: Column, size: int) -> Column:
    """The distinct runs of a size of an array of letters."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, F.lit(size)), ""))
    return F.when(F.size(own) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows of ``texts`` with each distinct term that they contain.

    A term of ``GRAM`` letters or more meets the texts on that of its pieces of so many
    letters which the fewest texts have, a shorter one as a whole; then the term itself is
    looked for.  A text is opened into ``GRAM`` pieces a letter, whatever its length.
    """
    sizes = range(1, GRAM + 1)
    spelled = texts.withColumn("_letters", letters(F.col(text)))
    opened = spelled.withColumn("_gram", F.explode(F.flatten(F.array(*(grams(F.col("_letters"), k) for k in sizes))))).drop("_letters")
    held = opened.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    own = terms.select(term).where(F.length(term) > 0).distinct()
    whole = F.when(F.length(term) < GRAM, F.array(term)).otherwise(grams(letters(F.col(term)), GRAM))
    rarest = own.withColumn("_gram", F.explode(whole)).join(held, "_gram", "left").groupBy(term).agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("_held"), "_gram")).alias("_g"))
    chosen = rarest.where("_g._held > 0").select(term, F.col("_g._gram").alias("_gram"))
    return opened.join(chosen, "_gram").where(F.contains(F.col(text), F.col(term))).drop("_gram")


def references(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, ref): paths that equal, hold or lie within a referenced text, in any case."""
    low = files.select("path", F.lower("path").alias("low")).distinct()
    own = refs.select("ref", F.lower("ref").alias("low_ref")).distinct()
    holds = containing(low, "low", own.select("low_ref"), "low_ref").join(own, "low_ref").select("path", "ref")
    within = containing(own, "low_ref", low.select("low"), "low").join(low, "low").select("path", "ref")
    return holds.union(within).distinct()


def changed_symbols(tree: DataFrame, changes: DataFrame, most: int = 8) -> DataFrame:
    """(path, symbol, kind, line, scopes, statuses): what the changed files define that
    weren't deleted; a symbol's scopes and statuses in the order of the changes."""
    alive = changes.where("status <> 'deleted'")
    own = trees.symbols(tree.join(alive.select("path").distinct(), "path", "left_semi"))
    first = own.groupBy("path", "symbol", "kind").agg(F.min("line_start").alias("line"))
    seen = alive.groupBy("path").agg(F.array_sort(F.collect_set("scope")).alias("scopes"), F.array_sort(F.collect_set("status")).alias("statuses"))
    return first.join(seen, "path").select("path", "symbol", "kind", "line", F.slice("scopes", 1, most).alias("scopes"), F.slice("statuses", 1, most).alias("statuses"))


def impact_terms(changes: DataFrame, symbols: DataFrame, most: int = 64) -> DataFrame:
    """(term, n): the tokens of changed paths, as often as they occur, and symbols' names
    until there are ``most`` terms."""
    alive = changes.where("status <> 'deleted'")
    tokens = alive.select(F.explode(paths.path_tokens(F.col("path"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    left = max(0, most - (tokens.agg(F.sum("n")).first()[0] or 0))
    named = symbols.groupBy(F.lower("symbol").alias("term")).agg(F.min(F.struct("path", "line", "symbol")).alias("first")).join(tokens.select("term"), "term", "left_anti")
    return tokens.unionByName(named.orderBy("first").limit(left).select("term", F.lit(1).cast("long").alias("n")))


def affected(tree: DataFrame, changes: DataFrame, symbols: DataFrame, candidates: int = 180, most: int = 10) -> DataFrame:
    """(path, is_test, score): the first ``most`` files and tests whose paths the changes'
    terms occur in, of the first ``candidates`` scanned paths; changed ones are left out."""
    alive = changes.where("status <> 'deleted'").select("path")
    first = tree.where(paths.is_scanned(F.col("path"))).select("path").orderBy("path").limit(candidates)
    path = F.col("path")
    role = F.coalesce(paths.map_role(path), F.lit("")) == "test"
    low = F.lower(path)
    own = first.join(alive, "path", "left_anti").select("path", low.alias("low"), role.alias("marked"), (role | low.contains("test") | low.endswith(".spec.ts")).alias("is_test"))
    hits = containing(own, "low", impact_terms(changes, symbols), "term").join(impact_terms(changes, symbols), "term")
    counted = hits.where(F.length("term") >= 3).groupBy("path").agg(F.sum("n").alias("n"))
    scored = own.join(counted, "path", "left").select("path", "is_test", (F.coalesce("n", F.lit(0)) * 2 + F.col("marked").cast("int")).alias("score")).where("score > 0")
    # at most ``candidates`` rows are left
    place = F.row_number().over(Window.partitionBy("is_test").orderBy(F.desc("score"), "path"))
    return scored.withColumn("place", place).where(F.col("place") <= most).drop("place")


def impact_confidence(changes: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """One row: high where symbols changed and something is affected, medium where
    anything changed, else low."""
    parts = {"changed": changes.where("status <> 'deleted'"), "symbols": symbols, "affected": found}
    every = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        every = one if every is None else every.unionByName(one)
    counts = every.agg(*(F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts))
    label = F.when((F.col("symbols") > 0) & (F.col("affected") > 0), "high").when(F.col("changed") > 0, "medium").otherwise("low")
    return counts.select("changed", "symbols", "affected", label.alias("confidence"))


def retrieval(tree: DataFrame, terms: list[str], most: int = 12, bytes_: int = 30_000, hit_files: int = 24) -> DataFrame:
    """(source_type, path, title, score): key files by path (6 and a point a term), files by
    path and the beginning of their text (4), and symbols of the first hit files (9); of
    equal hits the earlier kind counts."""
    asked = F.array(*map(F.lit, terms))
    n = lambda text: F.size(matched(asked, text))
    path, role = F.col("path"), paths.map_role(F.col("path"))
    mapped = tree.where(role.isNotNull()).select("path", n(F.concat_ws(" ", path, role)).alias("n"), F.lit(6).alias("points"))
    read = tree.where(role.isNotNull() | paths.is_scanned(path)).select("path", n(F.concat_ws(" ", path, F.left("content", F.lit(bytes_)))).alias("n"), F.lit(4).alias("points"))
    lexical = mapped.unionByName(read).where("n > 0").groupBy("path").agg(F.max_by(F.col("n") + F.col("points"), F.col("points")).alias("score"))
    named = lexical.select(F.lit("lexical_hit").alias("source_type"), "path", F.col("path").alias("title"), F.col("score").cast("long").alias("score"))
    first = lexical.orderBy(F.desc("score"), "path").limit(hit_files).select("path")
    symbols = trees.symbols(tree.select("path", F.col("content").alias("text")).join(first, "path", "left_semi"))
    title = F.concat_ws(" ", "kind", "symbol")
    structural = symbols.select("path", title.alias("title"), n(F.concat_ws(" ", "symbol", "kind")).alias("n")).where("n > 0").distinct()
    every = named.unionByName(structural.select(F.lit("structural_hit").alias("source_type"), "path", "title", (F.col("n") + 9).cast("long").alias("score")))
    return every.orderBy(F.desc("score"), "source_type", F.concat("path", "title")).limit(most)


def symbol_context(tree: DataFrame, terms: list[str], focus: list[str], most: int = 8) -> DataFrame:
    """(path, symbol, kind, line, score): two points for each of the first 12 terms in path
    or symbol, two if the path is one of the first four in focus."""
    asked, near = F.array(*map(F.lit, terms[:12])), F.col("path").isin(*focus[:4])
    score = F.size(matched(asked, F.concat_ws(" ", "path", "symbol"))) * 2 + F.when(near, 2).otherwise(0)
    own = trees.symbols(tree.select("path", F.col("content").alias("text"))).groupBy("path", "symbol").agg(F.min(F.struct("line_start", "kind")).alias("s"))
    scored = own.select("path", "symbol", "s.kind", F.col("s.line_start").alias("line"), score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "path", "symbol").limit(most)


def index_plan(tree: DataFrame, surface: str, most: int = 100) -> DataFrame:
    """(place, path, score, sha256): the worthiest paths of a surface."""
    path = F.col("path")
    able = paths.is_scanned(path) | paths.map_role(path).isNotNull() & (paths.map_role(path) != "test")
    chosen = tree.where(able).select("path", paths.index_score(path, surface).alias("score"), F.sha2("content", 256).alias("sha256")).orderBy(F.desc("score"), "path").limit(most)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


#: What a selected path's terms may be, and the marks of a surface.
SELECTION_TERMS = ("cli", "runtime", "server", "agent", "command", "test", "config", "entry", "source")
WEB_TERMS = ("frontend", "web", "ui")
MARKS = {"cli": r"cli|runtime|server|agent|command|terminal", "web": r"frontend/|web/|ui/|src/app|src/pages|src/components"}
MARKED = {"cli": "matches CLI/runtime surface markers", "web": "matches web surface markers"}


def selections(plan: DataFrame, surface: str, most: int = 6) -> DataFrame:
    """The plan with each path's role, why it was chosen, and the terms that it matches."""
    low = F.lower("path")
    role = paths.go_role(F.col("path"))
    kind = "web" if surface == "web" else "cli"
    tested = low.rlike(r"\.test\.|\.spec\.") | F.concat(F.lit("/"), low, F.lit("/")).contains("/tests/")
    reasons = F.concat_ws(
        "; ", F.concat(role, F.lit(" file")), F.concat(F.lit("score "), F.col("score").cast("string")),
        F.when(low.rlike(MARKS[kind]), MARKED[kind]), F.when(tested, "test-like path received a ranking penalty"))
    said = plan.withColumns({"role": role, "reason": reasons})
    asked = F.array(*map(F.lit, SELECTION_TERMS + (WEB_TERMS if surface == "web" else ())))
    found = F.filter(asked, lambda t: F.contains(F.lower(F.concat_ws(" ", "path", "reason")), t))
    return said.withColumn("matched_terms", F.slice(found, 1, most))


def readiness(plan: DataFrame, configured: bool, dirty: int) -> DataFrame:
    """One row: how many paths are selected, what stands in the way of a run, and what to
    mind about it."""
    none = F.count(F.lit(1)) == 0
    blockers = F.array_compact(F.array(F.lit(None if configured else "no storage is configured").cast("string"), F.when(none, "no paths were selected")))
    warnings = F.array_compact(F.array(F.lit("dirty files make the baseline provisional" if dirty else None).cast("string")))
    return plan.agg(F.count(F.lit(1)).alias("selected"), blockers.alias("blockers"), warnings.alias("warnings")).withColumn("can_run", F.size("blockers") == 0)


def fingerprint(plan: DataFrame, workspace: str, surface: str, head: str | None) -> DataFrame:
    """One row: the digest of a plan's JSON, its paths in their order (a hundred at most)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "path", "sha256"))), lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256")))
    payload = F.struct(F.lit(workspace).alias("workspace_id"), F.lit(surface).alias("surface"), *([F.lit(head).alias("head_sha")] if head else []), listed.alias("paths"))
    return plan.agg(F.sha2(F.to_json(payload), 256).alias("fingerprint"))


def freshness(planned: DataFrame, workspaces: DataFrame, baselines: DataFrame) -> DataFrame:
    """(workspace, state): whether the stored index still covers what would be indexed.

    planned: (workspace, path, sha256); workspaces: (workspace, ready, head, dirty, mark);
    baselines: (workspace, head, mark, paths: map of path to sha256).
    """
    base = baselines.select("workspace", F.lower("head").alias("old_head"), F.col("mark").alias("old_mark"), "paths")
    same = F.col("sha256").isNotNull() & F.coalesce(F.try_element_at("paths", "path") == F.col("sha256"), F.lit(False))
    covered = planned.join(base, "workspace").groupBy("workspace").agg(F.bool_and(same).alias("covers"))
    joined = workspaces.join(base, "workspace", "left").join(covered, "workspace", "left")
    fits = F.coalesce(F.col("mark") == F.col("old_mark"), F.lit(False)) | F.coalesce((F.lower("head") == F.col("old_head")) & F.col("covers"), F.lit(False))
    state = F.when(~F.col("ready"), "blocked").when(F.col("old_head").isNull(), "no_baseline").when(fits & (F.col("dirty") > 0), "dirty_provisional").when(fits, "fresh").otherwise("stale")
    return joined.select("workspace", state.alias("state"))


def repo_context(changes: DataFrame, symbols: DataFrame, found: DataFrame, plans: DataFrame, activity: DataFrame, fixes: DataFrame) -> DataFrame:
    """The ledger of a change (source_type, source_id, title, score): changes, symbols, run
    plans, activity that names a path, and the latest fix of one; 10, 10, 5, 5 and 1 rows.

    plans: (run_id, n, score); activity: (activity_id, created_at, action, summary);
    fixes: (fix_id, recorded_at, summary, path).
    """
    refs = changes.select(F.col("path").alias("ref")).union(found.select("path")).distinct()
    row = lambda kind, id_, title, score: [F.lit(kind).alias("source_type"), id_.alias("source_id"), title.alias("title"), score.cast("long").alias("score")]
    first = changes.orderBy("path").limit(10).select(*row("lexical_hit", F.concat(F.lit("change:"), "path"), F.concat_ws(" ", "status", "path"), F.lit(8)))
    named = symbols.orderBy("path", "line", "symbol").limit(10).select(*row("structural_hit", F.concat_ws(":", F.lit("symbol"), "path", "symbol"), F.concat_ws(" ", "kind", "symbol"), F.lit(10)))
    runs = plans.orderBy(F.desc("score"), "run_id").limit(5).select(*row("artifact", F.concat(F.lit("run_plan:"), F.col("run_id").cast("string")), F.concat(F.lit("Run plan "), F.col("run_id").cast("string")), F.col("score")))
    newest = activity.orderBy(F.desc("created_at"), F.desc("activity_id")).limit(80).withColumn("low", F.lower("summary"))
    said = newest.join(containing(newest.select("activity_id", "low"), "low", refs.select(F.lower("ref").alias("ref")), "ref").select("activity_id").distinct(), "activity_id", "left_semi")
    told = said.orderBy(F.desc("created_at"), F.desc("activity_id")).limit(5).select(*row("artifact", F.concat(F.lit("activity:"), "action"), F.col("summary"), F.lit(5)))
    touched = fixes.join(references(fixes.select("path"), refs).select("path").distinct(), "path", "left_semi")
    fixed = touched.orderBy(F.desc("recorded_at"), "fix_id").limit(1).select(*row("artifact", F.concat(F.lit("fix:"), "fix_id"), F.col("summary"), F.lit(9)))
    return first.unionByName(named).unionByName(runs).unionByName(told).unionByName(fixed)


def issue_packets(issues: DataFrame, fixes: DataFrame, activity: DataFrame, runs: DataFrame, most_fixes: int = 5, most_activity: int = 8) -> DataFrame:
    """A row for each issue: its focus paths, evidence, latest fixes and activity, and runs.

    issues: (bug_id, title, severity, paths: array, evidence: array); fixes: (issue_id,
    fix_id, recorded_at); activity: (issue_id, activity_id, created_at); runs: (issue_id, n).
    """
    def latest(rows: DataFrame, id_: str, at: str, most: int) -> DataFrame:
        own = rows.join(issues.select(F.col("bug_id").alias("issue_id")), "issue_id", "left_semi")
        # the newest of each part of an issue's rows, then of those
        part = own.withColumn("part", F.pmod(F.xxhash64(id_), F.lit(16)))
        for keys in (["issue_id", "part"], ["issue_id"]):
            part = part.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), id_))).where(F.col("place") <= most)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", id_))), lambda x: x[id_])
        return part.groupBy(F.col("issue_id").alias("bug_id")).agg(listed.alias(f"{id_}s"))

    none = F.array().cast("array<string>")
    counted = runs.select(F.col("issue_id").alias("bug_id"), F.col("n").alias("n_runs"))
    out = issues.join(latest(fixes, "fix_id", "recorded_at", most_fixes), "bug_id", "left").join(latest(activity, "activity_id", "created_at", most_activity), "bug_id", "left").join(counted, "bug_id", "left")
    focus = F.slice(F.array_distinct(F.transform("paths", paths.normal_path)), 1, 12)
    return out.select(
        "bug_id", "title", "severity", focus.alias("focus"), F.slice("evidence", 1, 20).alias("evidence"), F.coalesce("fix_ids", none).alias("fixes"),
        F.coalesce("activity_ids", F.array().cast("array<bigint>")).alias("activity"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def first_by_issue(issues: DataFrame, rows: DataFrame, value: str, order: list[Column], most: int, name: str) -> DataFrame:
    """(bug_id, name): the first ``most`` values of each issue's rows (issue_id, ...)."""
    own = rows.join(issues.select(F.col("bug_id").alias("issue_id")).distinct(), "issue_id", "left_semi")
    best = first_of(own, ["issue_id"], order, most, value)
    placed = best.withColumn("_k", F.row_number().over(Window.partitionBy("issue_id").orderBy(*order)))  # ``most`` rows each
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value])
    return placed.groupBy(F.col("issue_id").alias("bug_id")).agg(listed.alias(name))


def packet_parts(issues: DataFrame, tables: dict[str, DataFrame], globs: DataFrame, workspace: dict[str, DataFrame], most: int = 8) -> DataFrame:
    """What a context packet holds besides ``issue_packets``, a row for each issue.

    issues: (bug_id, severity, paths).  tables: ``tickets``, ``threats``, ``dumps`` (issue_id,
    id, at), ``runs`` (issue_id, id, at, status) and ``symbols`` (path, line, symbol); of each
    the first ``most`` of an issue, newest first, symbols by place.  globs: (glob,
    instruction).  workspace: ``guidance`` and ``profiles`` (rank, name), a few rows each.
    """
    focus = issues.select("bug_id", F.explode(F.array_distinct(F.slice(F.transform("paths", paths.normal_path), 1, 12))).alias("path"))
    out = issues.select("bug_id", "severity", F.array_distinct(F.transform("paths", paths.normal_path)).alias("focus"))
    for name in ("tickets", "threats", "dumps"):
        out = out.join(first_by_issue(issues, tables[name], "id", [F.desc("at"), F.col("id")], most, name), "bug_id", "left")
    runs = tables["runs"].withColumn("run", F.concat_ws(":", "id", "status"))
    out = out.join(first_by_issue(issues, runs, "run", [F.desc("at"), F.col("id")], most, "prior_runs"), "bug_id", "left")
    # symbols by path first: many issues share one
    known = tables["symbols"].join(focus.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("issue_id"), "line", "symbol")
    by_path = first_by_issue(focus.select(F.col("path").alias("bug_id")), known, "symbol", [F.col("line"), F.col("symbol")], most, "symbols").withColumnRenamed("bug_id", "path")
    of_issue = focus.join(by_path, "path").groupBy("bug_id").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "symbols"))), lambda x: x["symbols"])), 1, most).alias("symbols"))
    told = glob_matches(focus, globs).groupBy("bug_id").agg(F.array_sort(F.collect_set("instruction")).alias("instructions"))
    out = out.join(of_issue, "bug_id", "left").join(told, "bug_id", "left")
    for name, df in workspace.items():
        rows = df.orderBy("rank", "name").limit(most).collect()  # ``most`` rows
        out = out.withColumn(name, F.array(*(F.lit(r["name"]) for r in rows)).cast("array<string>"))
    none = F.array().cast("array<string>")
    tests = F.transform(test_files(F.col("focus"), F.col("severity")), lambda t: t["file"])
    lists = ("tickets", "threats", "dumps", "prior_runs", "symbols", "instructions")
    return out.select("bug_id", *(F.coalesce(F.col(c).cast("array<string>"), none).alias(c) for c in lists), *workspace, tests.alias("tests"))
