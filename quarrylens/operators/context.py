"""What belongs to an issue or a change: linked plans, activity, artifacts and criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.arrays import let
from quarrylens.functions.paths import strip
from quarrylens.functions.text import blank_to_null, matched


def pinned(rows: DataFrame, scenarios: DataFrame, key: str, ids: str, id_: str) -> DataFrame:
    """Rows of each scenario's key, those pinned by id in the pinned order; all of them, by
    id, where nothing is pinned.  Adds ``place``."""
    joined = rows.join(scenarios, key)
    at = F.array_position(F.col(ids), F.col(id_))
    kept = joined.where((F.size(ids) == 0) | (at > 0)).withColumn("_at", at)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_at", id_))).drop("_at", ids)


def linked_plans(steps: DataFrame, references: DataFrame, most: int = 8) -> DataFrame:
    """(run_id, n, score): plans whose steps touch a referenced path; steps are (run_id, files)."""
    touched = steps.select("run_id", F.explode("files").alias("path")).distinct()
    hits = touched.join(references.select("path").distinct(), "path", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.withColumn("score", F.col("n") + 8).orderBy(F.desc("score"), "run_id").limit(most)


def linked_activity(activity: DataFrame, terms: list[str], latest: int = 80, most: int = 8) -> DataFrame:
    """The newest ``most`` of the ``latest`` events whose text holds one of the terms."""
    newest = activity.orderBy(F.desc("created_at"), F.desc("activity_id")).limit(latest)
    found = newest.withColumn("terms", matched(F.array(*(F.lit(t.lower()) for t in terms)), F.col("summary"))).where(F.size("terms") > 0)
    return found.orderBy(F.desc("created_at"), F.desc("activity_id")).limit(most)


def batch_runs(queue: DataFrame, scenarios: DataFrame, runs: DataFrame) -> DataFrame:
    """The first queued run of each scenario of a batch, in the queue's order.

    queue: (batch_id, pos, run_id); scenarios: (batch_id, scenario_id) asked for; runs:
    (run_id, scenario_id).
    """
    joined = queue.join(runs, "run_id").join(scenarios, ["batch_id", "scenario_id"], "left_semi")
    return joined.groupBy("batch_id", "scenario_id").agg(F.min_by("run_id", "pos").alias("run_id"))


def ranked_artifacts(parts: dict[str, tuple[DataFrame, int]], terms: Column, most: int = 8, hits: int = 4) -> DataFrame:
    """(kind, id, score): artifacts of several kinds by how many terms their text holds.

    parts: kind to ((id, text), bonus); at most ``hits`` terms count, two points each.
    """
    every = None
    for kind, (df, bonus) in parts.items():
        own = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.size(matched(terms, F.col("text"))).alias("n"), F.lit(bonus).alias("bonus"))
        every = own if every is None else every.unionByName(own)
    score = F.least(F.col("n"), F.lit(hits)) * 2 + F.col("bonus")
    return every.where("n > 0").select("kind", "id", score.alias("score")).orderBy(F.desc("score"), "kind", "id").limit(most)


def criteria(text: Column, most: int = 10) -> Column:
    """Acceptance criteria of a Markdown text: the list below a heading that names them,
    else all list items."""
    section = F.regexp_extract(text, r"(?im)^#+[^\n]*acceptance[^\n]*criteria[^\n]*\n((?:(?!#)[^\n]*(?:\n|$))*)", 1)
    item = r"(?m)^\s*(?:[-*]|\d+[.)])\s*(?:\[[ xX]\]\s*)?(\S[^\n]*)"
    listed = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(item), 1), strip), lambda x: x != "")
    own = listed(section)
    return F.slice(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(listed(text))), 1, most)


def test_commands(text: Column, most: int = 6) -> Column:
    """Distinct test commands that a text names, white space collapsed."""
    found = F.regexp_extract_all(text, F.lit(r"((?:python -m pytest|pytest|npm (?:run )?test|npm run [a-z:-]+|go test|cargo test|make test)[^\n`;&|]*)"), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda x: strip(F.regexp_replace(x, r"\s+", " ")))), 1, most)


def named_files(text: Column, most: int = 8) -> Column:
    """Distinct file paths that a text names, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+)"), 1)), 1, most)


def json_in(text: Column) -> Column:
    """The JSON object in a text: of a fenced block, else from the first to the last brace;
    null if neither parses."""
    fenced, braces = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(F.nullif(fenced, F.lit(""))), ok(F.nullif(braces, F.lit(""))))


def verdict_of(text: Column) -> Column:
    """yes, no or unknown: what a text without JSON says of a fix."""
    low = F.lower(text)
    return F.when(low.contains("not fixed"), "no").when(low.contains("fixed"), "yes").otherwise("unknown")


def checklist(items: Column, success: Column, coverage: Column) -> Column:
    """(title, passed) of a profile's items: those on coverage pass where there is any,
    others where the run succeeded."""
    return F.transform(items, lambda x: F.struct(x.alias("title"), F.when(F.lower(x).contains("coverage"), coverage.isNotNull()).otherwise(success).alias("passed")))


def insights(status: Column, exit_code: Column, tool_events: Column, has_fix: Column) -> Column:
    """What a run's record says for or against it, as a distinct array."""
    return F.array_distinct(F.array_compact(F.array(
        F.when(status == "completed", "finished"), F.when(status == "failed", "failed"), F.when(exit_code != 0, "non-zero exit"), F.when(tool_events > 0, "used tools"),
        F.when(tool_events == 0, "used no tools"), F.when((status == "completed") & ~has_fix, "needs review"))))


def name_or(text: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(default))


def scored_matches(found: DataFrame, text: Column, terms: list[str], focus: list[str], most: int = 8) -> DataFrame:
    """The best matches of a pattern for a context: two points a term of the first 12 and
    two for one of the first four paths in focus, three at least."""
    asked = F.array(*map(F.lit, terms[:12]))
    points = F.size(matched(asked, text)) * 2 + F.when(F.col("path").isin(*focus[:4]), 2).otherwise(0)
    return found.withColumn("score", F.greatest(F.lit(3), points)).orderBy(F.desc("score"), "path", "line").limit(most)


def draft_summary(text: Column, most: int = 160) -> Column:
    """The first line without its bullet or number."""
    return F.left(F.regexp_replace(F.trim(F.split(text, "\n")[0]), r"^[-*0-9.)]+\s*", ""), F.lit(most))


def fix_drafts(runs: DataFrame, most: int = 8) -> DataFrame:
    """(run_id, issue_status, summary, tests, files) of (run_id, status, excerpt, dirty):
    where the excerpt names no files, the first dirty paths are suggested."""
    files = named_files(F.regexp_replace("excerpt", r"`[^`]*`", ""))
    status = F.when(F.col("status") == "completed", "verification").otherwise("in_progress")
    chosen = F.when(F.size(files) > 0, files).otherwise(F.slice("dirty", 1, most))
    return runs.select("run_id", status.alias("issue_status"), draft_summary(F.col("excerpt")).alias("summary"), test_commands(F.col("excerpt")).alias("tests"), chosen.alias("files"))


def guidance_summary(text: Column, path: Column) -> Column:
    """(title, summary, excerpt, keywords) of a guidance file: its first heading, its first
    three and four lines of prose, and up to eight keywords of its front matter."""
    front = F.regexp_extract(text, r"^---[ \t]*\n((?:(?!---)[^\n]*\n)*)---", 1)
    body = F.regexp_replace(text, r"^---[ \t]*\n(?:(?!---)[^\n]*\n)*---[ \t]*\n?", "")
    prose = F.regexp_replace(body, r"(?ms)^[ \t]*```.*?^[ \t]*```[^\n]*$", "")
    said = F.transform(F.filter(F.transform(F.split(prose, "\n"), strip), lambda x: (x != "") & ~x.startswith("#")), lambda x: F.regexp_replace(strip(F.regexp_replace(x, r"^[-*]+", "")), r"^\d+\.\s*", ""))
    # each is made once: a filter over lines that names them would make them anew for every line
    kept = let(F.filter(said, lambda x: x != ""), lambda lines: F.slice(F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1))), 1, 4))
    listed = F.split(F.regexp_extract(front, r"(?im)^\s*keywords:[^\[\n]*\[([^\]]*)\]", 1), ",")
    words = F.slice(F.filter(F.transform(listed, lambda x: strip(F.regexp_replace(strip(x), "^['\"]+|['\"]+$", ""))), lambda x: x != ""), 1, 8)
    name = F.element_at(F.split(path, "/"), -1)
    heading = strip(F.regexp_extract(text, r"(?m)^\s*#+([^\n]*)", 1))
    bare = F.concat(F.lit("Repository guidance from "), name)
    said_as = lambda k, n, between: F.when(F.size(k) > 0, F.array_join(F.slice(k, 1, n), between)).otherwise(bare)
    title = let(heading, lambda h: F.when(h != "", h).otherwise(name))
    return let(kept, lambda k: F.struct(title.alias("title"), said_as(k, 3, " ").alias("summary"), said_as(k, 4, "\n").alias("excerpt"), words.alias("keywords")))


#: Search patterns for a name, by language and by whether it begins with a capital.
PATTERNS = {
    "py": ("python", ["class {}: $$$BODY"], ["def {}($$$ARGS): $$$BODY"]),
    "ts": ("typescript", ["class {} {{ $$$BODY }}"], ["function {}($$$ARGS) {{ $$$BODY }}", "const {} = ($$$ARGS) => $$$BODY"]),
    "tsx": ("tsx", ["class {} {{ $$$BODY }}"], ["function {}($$$ARGS) {{ $$$BODY }}", "const {} = ($$$ARGS) => $$$BODY"]),
    "js": ("javascript", ["class {} {{ $$$BODY }}"], ["function {}($$$ARGS) {{ $$$BODY }}", "const {} = ($$$ARGS) => $$$BODY"]),
    "go": ("go", ["type {} struct {{ $$$BODY }}"], ["func {}($$$ARGS) {{ $$$BODY }}"]),
    "rs": ("rust", ["struct {} {{ $$$BODY }}"], ["fn {}($$$ARGS) {{ $$$BODY }}"]),
}
#: Words that name nothing in code.
NO_NAMES = ("export", "backend", "frontend", "render", "error", "issue")


def semantic_patterns(terms: Column, candidates: Column, most: int = 8) -> Column:
    """(pattern, language, glob): what to search for the first four names among the terms,
    in the languages of the first eight candidate paths."""
    names = F.slice(F.filter(terms, lambda t: t.rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$") & ~t.isin(*NO_NAMES)), 1, 4)
    endings = F.array_distinct(F.filter(F.transform(F.slice(candidates, 1, 8), lambda p: F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)), lambda x: x.isin(*PATTERNS)))

    def made(ending: str, name: Column) -> Column:
        language, upper, lower = PATTERNS[ending]

        def each(forms: list[str]) -> Column:
            parts = [f.replace("{{", "{").replace("}}", "}").split("{}", 1) for f in forms]
            return F.array(*(F.struct(F.concat(F.lit(a), name, F.lit(b)).alias("pattern"), F.lit(language).alias("language"), F.lit(f"**/*.{ending}").alias("glob")) for a, b in parts))

        return F.when(name.rlike("^[A-Z]"), each(upper)).otherwise(each(lower))

    def of(ending: Column, name: Column) -> Column:
        out = None
        for one in PATTERNS:
            out = F.when(ending == one, made(one, name)) if out is None else out.when(ending == one, made(one, name))
        return out

    every = F.flatten(F.transform(endings, lambda e: F.flatten(F.transform(names, lambda n: of(e, n)))))
    return F.slice(F.array_distinct(every), 1, most)


def plan_versions(plans: DataFrame, updates: DataFrame, most_dirty: int = 24) -> DataFrame:
    """(run_id, version, attached, dirty): plans after their updates; a new attachment takes
    the place of one with its path, all are in order of their paths."""
    def clean(raw: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\./", ""), "^/+", "")

    new = F.array_distinct(F.filter(F.transform("paths", clean), lambda p: p != ""))
    made = F.transform(new, lambda p: F.struct(p.alias("path"), F.lit("manual").alias("source")))
    joined = plans.join(updates, "run_id", "left").withColumn("made", made)
    kept = F.filter("attached", lambda x: ~F.exists("made", lambda m: m["path"] == x["path"]))
    merged = F.when(F.col("paths").isNull(), F.col("attached")).when(F.col("replace"), F.col("made")).otherwise(F.array_sort(F.concat(kept, "made")))
    dirty = F.coalesce(F.slice("dirty", 1, most_dirty), F.array().cast("array<string>"))
    return joined.select("run_id", F.when(F.col("paths").isNull(), F.col("version")).otherwise(F.col("version") + 1).alias("version"), merged.alias("attached"), dirty.alias("dirty"))


def plan_revisions(plans: DataFrame, worktrees: DataFrame, most_dirty: int = 24) -> DataFrame:
    """The row that is appended for each version of a plan: what it held, and the state of
    the working tree then.

    plans: (run_id, version, phase, summary, feedback, attached, created_at); worktrees:
    (run_id, branch, head_sha, dirty).
    """
    named = F.concat(F.lit("planrev_"), F.left(F.sha2(F.concat_ws(":", F.col("run_id").cast("string"), F.col("version").cast("string")), 256), F.lit(12)))
    dirty = F.coalesce(F.slice("dirty", 1, most_dirty), F.array().cast("array<string>")).alias("dirty_paths")
    return plans.join(worktrees, "run_id", "left").select(named.alias("revision_id"), "run_id", "version", "phase", "summary", "feedback", "branch", "head_sha", dirty, F.col("attached").alias("attached_files"), "created_at")


#: The phases of ingestion in their order, with what they need and what is
#: said where it lacks; phases without an own part are complete once that is there.
PHASES = (
    ("repo_scan", "complete", (("scanned", "Run a workspace scan before semantic ingestion phases can build on repo state."),)),
    ("repo_map", "complete", (("mapped", "Repo map has not been generated for this workspace yet."),)),
    ("runtime_discovery", "complete", (("scanned", "Workspace scan must complete before runtime discovery can report targets."),)),
    ("tree_sitter_index", "ready", (("mapped", "Repo map available"), ("stored", "Postgres configured"), ("parser", "tree-sitter language pack installed"))),
    ("ast_grep_rules", "ready", (("mapped", "Repo map available"), ("stored", "Postgres configured"), ("patterns", "ast-grep binary installed"))),
    ("lsp_enrichment", "ready", ((None, "Awaiting workspace LSP manager implementation."),)),
    ("search_materialization", "ready", (("stored", "Postgres configured"), (None, "Depends on symbol and edge materialization before hybrid retrieval can be trusted."))),
)


def ingestion_plan(given: DataFrame, key: str) -> DataFrame:
    """(key, place, phase_id, delivery_state, blockers, next_phase_id): all phases of each
    workspace; the next one is the first that is ready.

    given: the key and booleans ``scanned``, ``mapped``, ``stored``, ``parser``, ``patterns``.
    """
    def row(place: int, name: str, done: str, needs: tuple) -> Column:
        lacking = F.array_compact(F.array(*(F.lit(said) if need is None else F.when(~F.coalesce(need, F.lit(False)), said) for need, said in needs)))
        return F.struct(F.lit(place).alias("place"), F.lit(name).alias("phase_id"), F.when(F.size(lacking) == 0, done).otherwise("blocked").alias("delivery_state"), lacking.alias("blockers"))

    every = F.array(*(row(k, *phase) for k, phase in enumerate(PHASES, 1)))
    ready = F.filter("phases", lambda p: p["delivery_state"] == "ready")
    return given.select(key, every.alias("phases")).select(key, F.inline("phases"), F.try_element_at(ready, F.lit(1))["phase_id"].alias("next_phase_id"))


def phases(given: DataFrame, key: str, needs: dict[str, list[str]]) -> DataFrame:
    """(key, phase, state): ready where a phase's own condition and those of the phases it
    needs hold, next where only its own is missing, else blocked."""
    def row(name: str, before: list[str]) -> Column:
        done = F.lit(True)
        for one in before:
            done = done & F.col(one)
        return F.struct(F.lit(name).alias("phase"), F.when(done & F.col(name), "ready").when(done, "next").otherwise("blocked").alias("state"))

    return given.select(key, F.inline(F.array(*(row(name, before) for name, before in needs.items()))))
