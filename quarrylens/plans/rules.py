"""Rules, scores, orders and set operations over the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import arrays, numbers, paths, text
from quarrylens.operators import duplicates, joins, reviews, rollups, selection
from quarrylens.registry import query
from quarrylens.sources import adapters as src
from quarrylens.sources import findings as scanner
from quarrylens.sources import trees

#: A path of a source file for each page: its own, with an ending and a directory by its number.
FILE_PATH = """(CASE file_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'backend/data/' ELSE '' END || 'p' || file_id ||
CASE file_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.TS' ELSE '.ts' END)"""


def file_path() -> F.Column:
    folder = src.case(F.col("file_id") % 5, {0: "src/", 1: "tests/", 2: "node_modules/", 3: "backend/data/"}, "")
    return F.concat(folder, F.lit("p"), F.col("file_id").cast("string"), src.case(F.col("file_id") % 4, {0: ".py", 1: ".md", 2: ".TS"}, ".ts"))


def said(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("s29_symbol_reads", "SELECT file, line, hits, row_number() OVER (ORDER BY coalesce(nullif(line, 3), 2147483647), file, hits, created_at) AS place FROM coverage_lines WHERE result_id = 7 AND hits = 0 QUALIFY place <= 20")
def s29(spark: SparkSession, d: str) -> DataFrame:
    order = [F.coalesce(F.nullif(F.col("line"), F.lit(3)), F.lit(2147483647)), "file", "hits", "created_at"]
    found = src.coverage_lines(spark, d).where("result_id = 7 AND hits = 0").orderBy(*order).limit(20)
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("file", "line", "hits", "place")


#: Ledgers of bugs and status notes beside them, one for each part.
LEDGER = "(CASE WHEN p_size % 5 = 0 THEN 'docs/bugs/Bugs_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '_status_.md' WHEN p_size % 5 = 1 THEN 'docs/bugs/Bugs_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.md' WHEN p_size % 5 = 2 THEN 'docs/bugs/old/Bugs_' || p_partkey || '.md' ELSE 'docs/Bugs_' || p_partkey || '.md' END)"


@query("s06_latest_source", f"SELECT max(path) AS path FROM (SELECT {LEDGER} AS path FROM part) WHERE regexp_matches(path, '^docs/bugs/Bugs_[^/]*\\.md$') AND NOT contains(path, '_status_')")
def s06(spark: SparkSession, d: str) -> DataFrame:
    padded, plain = F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.col("p_partkey").cast("string")
    path = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("docs/bugs/Bugs_"), padded, F.lit("_status_.md"))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("docs/bugs/Bugs_"), padded, F.lit(".md"))).when(
        F.col("p_size") % 5 == 2, F.concat(F.lit("docs/bugs/old/Bugs_"), plain, F.lit(".md"))).otherwise(F.concat(F.lit("docs/Bugs_"), plain, F.lit(".md")))
    return trees.latest_ledger(src.table(spark, d, "part").select(path.alias("path")))


@query("s09_activity_latest", "SELECT activity_id, action FROM activity WHERE issue_id IS NOT NULL ORDER BY created_at DESC, activity_id DESC LIMIT 100")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return src.activity(spark, d).where("issue_id IS NOT NULL").orderBy(F.desc("created_at"), F.desc("activity_id")).limit(100).select("activity_id", "action")


@query("k09_patch_upsert", """SELECT bug_id, coalesce(toxic::VARCHAR, source) AS source FROM issues LEFT JOIN labels ON bug_id = doc_id
UNION ALL SELECT doc_id, 'x' FROM labels WHERE doc_id NOT IN (SELECT bug_id FROM issues)""")
def k09(spark: SparkSession, d: str) -> DataFrame:
    issues = src.issues(spark, d).select("bug_id", "source")
    labels = src.table(spark, d, "labels").select(F.col("doc_id").alias("bug_id"), F.col("toxic").cast("string").alias("source"))
    new = labels.join(issues.select("bug_id"), "bug_id", "left_anti").select("bug_id", F.lit("x").alias("source"))
    return joins.upserted(issues, joins.patched(issues, labels, ["source"]), ["bug_id"]).unionByName(new)


@query("k12_promotion", """SELECT activity_id, entity_type || '_AUTO_' || strftime(created_at, '%Y%m%d') || '_' || lpad(CAST(row_number() OVER (PARTITION BY entity_type, strftime(created_at, '%Y%m%d') ORDER BY created_at, activity_id) AS VARCHAR), 6, '0') AS bug_id,
array_to_string(list_sort(list_distinct(['auto-discovery', action, actor_kind])), ',') AS labels FROM activity WHERE entity_type = 'signal' AND issue_id IS NOT NULL""")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Signals are numbered within their day, so no task orders all of them."""
    promoted = src.activity(spark, d).where("entity_type = 'signal' AND issue_id IS NOT NULL").withColumn("day", F.date_format("created_at", "yyyyMMdd"))
    number = F.row_number().over(Window.partitionBy("entity_type", "day").orderBy("created_at", "activity_id"))
    labels = arrays.sorted_distinct(F.array(F.lit("auto-discovery"), F.col("action"), F.col("actor_kind")))
    return promoted.select("activity_id", F.concat("entity_type", F.lit("_AUTO_"), "day", F.lit("_"), F.lpad(number.cast("string"), 6, "0")).alias("bug_id"), F.array_join(labels, ",").alias("labels"))


@query("k14_change_log", """SELECT bug_id, CASE WHEN upper(source) <> source THEN source || '>' || upper(source) END AS severity_change, CASE WHEN quality = 0 THEN issue_status || '>rejected' END AS status_change
FROM issues JOIN labels ON bug_id = doc_id""")
def k14(spark: SparkSession, d: str) -> DataFrame:
    joined = src.issues(spark, d).join(src.table(spark, d, "labels"), F.col("bug_id") == F.col("doc_id"))
    change = lambda old, new: F.when(old != new, F.concat_ws(">", old, new))
    return joined.select("bug_id", change(F.col("source"), F.upper("source")).alias("severity_change"), F.when(F.col("quality") == 0, change(F.col("issue_status"), F.lit("rejected"))).alias("status_change"))


@query("f09_open_improvements", """SELECT run_id, len(list_filter(own, lambda x: x <> 'system')) AS n FROM (SELECT run_id, list(type ORDER BY pos) AS own FROM output_lines GROUP BY run_id)""")
def f09(spark: SparkSession, d: str) -> DataFrame:
    own = src.output_lines(spark, d).groupBy("run_id").agg(F.collect_list("type").alias("own"))
    return own.select("run_id", F.size(F.filter("own", lambda x: x != "system")).cast("long").alias("n"))


@query("f10_path_instructions", r"""SELECT n_nationkey AS instruction, count(*) AS n FROM nation JOIN (SELECT '/src/' || source || '/' || lang AS path FROM documents) p ON regexp_full_match(p.path, '/src/[^/]*' || n_nationkey || '/[^/]*') GROUP BY n_nationkey""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paths meet the globs that begin as they do, and are then matched."""
    glob = F.concat(F.lit("/src/*"), F.col("n_nationkey").cast("string"), F.lit("/*"))
    globs = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("instruction"), glob.alias("glob"))
    own = src.table(spark, d, "documents").groupBy(F.concat(F.lit("/src/"), "source", F.lit("/"), "lang").alias("path")).agg(F.count(F.lit(1)).alias("m"))
    return joins.glob_matches(own, globs).groupBy("instruction").agg(F.sum("m").alias("n"))


@query("a12_scenario_report", """SELECT runtime AS scenario, count(*) AS runs, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
CAST(coalesce(sum(estimated_cost), 0) AS DOUBLE) AS cost, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms, floor(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*) * 10 + 0.5) / 10 AS rate
FROM runs LEFT JOIN run_metrics USING (run_id) GROUP BY runtime""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    done, n = F.count_if(F.col("status") == "completed"), F.count(F.lit(1))
    return src.runs(spark, d).join(src.run_metrics(spark, d), "run_id", "left").groupBy(F.col("runtime").alias("scenario")).agg(
        n.alias("runs"), done.alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("double").alias("cost"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), numbers.rate(done, n).alias("rate"))


@query("a14_variant_rollup", """SELECT variant, count(DISTINCT run_id) AS runs, count(*) AS scenario_runs, CAST(sum(estimated_cost) AS DOUBLE) AS cost FROM (
SELECT run_id, estimated_cost, CASE WHEN len(own) = 0 THEN '__default__' ELSE array_to_string(own, '|') END AS variant FROM (SELECT run_id, estimated_cost,
list_filter([CASE WHEN model < '3' THEN model END, CASE WHEN runtime > 'F' THEN runtime END], lambda x: x IS NOT NULL) AS own FROM runs JOIN run_metrics USING (run_id))) GROUP BY variant""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    chosen = F.concat_ws("|", F.when(F.col("model") < "3", F.col("model")), F.when(F.col("runtime") > "F", F.col("runtime")))
    joined = src.runs(spark, d).join(src.run_metrics(spark, d), "run_id")
    return joined.groupBy(F.coalesce(F.nullif(chosen, F.lit("")), F.lit("__default__")).alias("variant")).agg(
        F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("scenario_runs"), F.sum("estimated_cost").cast("double").alias("cost"))


STATUS = "CASE status WHEN 'open' THEN 0 WHEN 'triaged' THEN 1 WHEN 'fixing' THEN 2 WHEN 'fixed' THEN 3 WHEN 'verified' THEN 4 WHEN 'closed' THEN 5 ELSE 99 END"


@query("a17_security_bundle", f"""(SELECT 'open' AS part, 'findings' AS id, count(*) AS value FROM findings WHERE status IN ('open', 'triaged', 'fixing'))
UNION ALL (SELECT 'finding', CAST(finding_id AS VARCHAR), row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, {STATUS}, lower(title), finding_id) AS place FROM findings QUALIFY place <= 5)
UNION ALL (SELECT 'activity', CAST(activity_id AS VARCHAR), row_number() OVER (ORDER BY created_at DESC, activity_id DESC) AS place FROM activity QUALIFY place <= 8)""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    """The number of open findings, the five worst, and the last eight activities."""
    found = src.findings(spark, d)
    status = src.case(F.col("status"), {"open": 0, "triaged": 1, "fixing": 2, "fixed": 3, "verified": 4, "closed": 5}, 99)

    def first(df: DataFrame, part: str, id_: str, order: list, most: int) -> DataFrame:
        kept = df.orderBy(*order).limit(most)
        return kept.select(F.lit(part).alias("part"), F.col(id_).cast("string").alias("id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("value"))

    open_ = found.where(F.col("status").isin("open", "triaged", "fixing")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("open").alias("part"), F.lit("findings").alias("id"), "value")
    worst = first(found, "finding", "finding_id", [selection.severity_rank(F.col("severity")), status, F.lower("title"), F.col("finding_id")], 5)
    return open_.unionByName(worst).unionByName(first(src.activity(spark, d), "activity", "activity_id", [F.desc("created_at"), F.desc("activity_id")], 8))


@query("a24_top_costs", "SELECT model, CAST(sum(estimated_cost) AS DOUBLE) AS cost FROM runs JOIN run_metrics USING (run_id) GROUP BY model ORDER BY cost DESC, model LIMIT 6")
def a24(spark: SparkSession, d: str) -> DataFrame:
    joined = src.runs(spark, d).join(src.run_metrics(spark, d), "run_id")
    return joined.groupBy("model").agg(F.sum("estimated_cost").cast("double").alias("cost")).orderBy(F.desc("cost"), "model").limit(6)


@query("a25_guidance_health", """SELECT source, count(*) FILTER (n_chars >= 500) AS guidance, count(*) FILTER (n_chars >= 500 AND lang = 'en') AS always_on, count(*) FILTER (n_chars < 50) AS stale,
3 - count(DISTINCT lang) FILTER (n_chars >= 100 AND lang IN ('en', 'de', 'fr')) AS missing, CASE WHEN count(*) FILTER (n_chars < 50) > 1 THEN 'stale' WHEN count(*) FILTER (n_chars >= 500) = 0 THEN 'missing'
WHEN count(DISTINCT lang) FILTER (n_chars >= 100 AND lang IN ('en', 'de', 'fr')) < 3 THEN 'partial' ELSE 'healthy' END AS health FROM documents GROUP BY source""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Guidance of a workspace (a source): files of some length, always on in one language;
    starters are three languages, stale those that hold next to nothing (one is forgiven)."""
    n, lang = F.col("n_chars"), F.col("lang")
    starters = F.count_distinct(F.when((n >= 100) & lang.isin("en", "de", "fr"), lang))
    counted = src.table(spark, d, "documents").groupBy("source").agg(
        F.count_if(n >= 500).alias("guidance"), F.count_if((n >= 500) & (lang == "en")).alias("always_on"), F.count_if(n < 50).alias("stale"), (3 - starters).alias("missing"))
    return counted.withColumn("health", rollups.guidance_health(F.col("stale") > 1, F.col("guidance") == 0, F.col("missing") > 0))


@query("w05_status_rank", "SELECT run_id, CASE status WHEN 'completed' THEN 4 WHEN 'running' THEN 3 WHEN 'queued' THEN 2 WHEN 'planning' THEN 1 WHEN 'failed' THEN 0 ELSE -1 END AS rank FROM runs")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return src.runs(spark, d).select("run_id", src.case(F.col("status"), {"completed": 4, "running": 3, "queued": 2, "planning": 1, "failed": 0}, -1).alias("rank"))


@query("w07_weighted_vote", """WITH v AS (SELECT issue_id, model = '1-URGENT' AS base, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS failed, floor(100.0::DOUBLE * count(*) FILTER (estimated_cost > 100000) / count(*) * 10 + 0.5) / 10 AS rate,
CAST(sum(estimated_cost) AS DOUBLE) AS cost, CAST(sum(duration_ms) // count(*) AS BIGINT) AS mean FROM runs JOIN run_metrics USING (run_id) GROUP BY ALL),
s AS (SELECT a.issue_id, 2 * (a.done > b.done)::INT + 2 * (a.failed < b.failed)::INT + 2 * (a.rate > b.rate)::INT + (a.cost < b.cost)::INT + (a.mean < b.mean)::INT AS own,
2 * (b.done > a.done)::INT + 2 * (b.failed < a.failed)::INT + 2 * (b.rate > a.rate)::INT + (b.cost < a.cost)::INT + (b.mean < a.mean)::INT AS other FROM v a JOIN v b USING (issue_id) WHERE NOT a.base AND b.base)
SELECT issue_id, own, other, CASE WHEN own > other THEN 'scenario' WHEN own < other THEN 'baseline' ELSE 'tie' END AS preferred FROM s""")
def w07(spark: SparkSession, d: str) -> DataFrame:
    """Five criteria: successes, failures and verification count two, cost and duration one."""
    joined = src.runs(spark, d).join(src.run_metrics(spark, d), "run_id").withColumn("base", F.col("model") == "1-URGENT")
    done, failed, verified = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed"), F.count_if(F.col("estimated_cost") > 100000)
    mean = F.expr("sum(duration_ms) div count(1)")
    reports = joined.groupBy("issue_id", "base").agg(done.alias("done"), failed.alias("failed"), numbers.rate(verified, F.count(F.lit(1))).alias("rate"), F.sum("estimated_cost").cast("double").alias("cost"), mean.alias("mean"))
    return rollups.weighted_vote(reports.where(~F.col("base")), reports.where("base"), "issue_id", {"done": (2, True), "failed": (2, False), "rate": (2, True), "cost": (1, False), "mean": (1, False)})


@query("w08_rank_positions", """WITH t AS (SELECT conv_id, role, turn, left(text, 12) AS id, len(list_filter(['the', 'de', 'und'], lambda x: contains(lower(left(text, 12)), x))) AS hits FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j FROM t),
u AS (SELECT conv_id, 'evidence' AS kind, id, i, 12 - i AS score FROM p WHERE role = 'user' AND i < 8 UNION ALL SELECT conv_id, 'related_path', id, i, greatest(1, 10 - i + hits) FROM p WHERE role = 'assistant' AND i < 8
UNION ALL SELECT conv_id, 'guidance', id, i, greatest(1, 6 - i) FROM p WHERE role = 'system' AND i < 6 UNION ALL SELECT conv_id, 'path_instruction', id, j, greatest(1, 8 - j) FROM q WHERE j < 6),
f AS (SELECT conv_id, kind, id, arg_min(score, i) AS score FROM u GROUP BY ALL)
SELECT conv_id, kind, id, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, kind, lower(id), id) AS place FROM f QUALIFY place <= 32""")
def w08(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns as evidence, assistants' as related paths, system turns as guidance, and
    all turns as path instructions; a score follows the place in its own list."""
    turns = said(spark, d).select("conv_id", "role", "turn", F.left("text", F.lit(12)).alias("id"))
    of = lambda role: turns.where(F.col("role") == role)
    hits = F.size(text.matched(F.array(F.lit("the"), F.lit("de"), F.lit("und")), F.col("id")))
    return selection.ledger("conv_id", "turn", [("evidence", of("user"), 12, None, 8), ("related_path", of("assistant"), 10, hits, 8), ("guidance", of("system"), 6, None, 6), ("path_instruction", turns, 8, None, 6)])


@query("w11_first_and_last", "SELECT issue_id, arg_min(status, (created_at, run_id)) AS baseline, arg_max(status, (created_at, run_id)) AS current FROM runs GROUP BY issue_id")
def w11(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("created_at", "run_id")
    return src.runs(spark, d).groupBy("issue_id").agg(F.min_by("status", at).alias("baseline"), F.max_by("status", at).alias("current"))


@query("w10_carried_scope", "SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope FROM conversations")
def w10(spark: SparkSession, d: str) -> DataFrame:
    above = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return said(spark, d).select("conv_id", "turn", F.last(F.when(F.col("role") == "system", F.left("text", F.lit(20))), ignorenulls=True).over(above).alias("scope"))


@query("t03_signal_order", "SELECT activity_id, action, entity_id FROM activity ORDER BY action, entity_id, activity_id")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return src.activity(spark, d).orderBy("action", "entity_id", "activity_id").select("activity_id", "action", "entity_id")


@query("t04_latest_fixes", "SELECT fix_id, recorded_at FROM fixes ORDER BY recorded_at DESC, fix_id")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return src.fixes(spark, d).orderBy(F.desc("recorded_at"), "fix_id").select("fix_id", "recorded_at")


@query("t06_largest_files", "SELECT file_id, size FROM files ORDER BY size DESC, file_id LIMIT 12")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return src.files(spark, d).orderBy(F.desc("size"), "file_id").limit(12).select("file_id", "size")


@query("t07_target_order", """SELECT kind, label, command FROM (SELECT DISTINCT CASE WHEN contains(lower(p_name), 'test') THEN 'test' WHEN contains(lower(p_name), 'lint') THEN 'lint' WHEN contains(lower(p_name), 'build') THEN 'build'
WHEN contains(lower(p_name), 'dev') OR contains(lower(p_name), 'serve') THEN 'dev' WHEN contains(lower(p_name), 'check') OR contains(lower(p_name), 'verify') THEN 'verify' ELSE 'other' END AS kind, p_name AS label, 'make ' || p_name AS command FROM part) ORDER BY kind, label, command""")
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Run targets by kind, label and command."""
    named = src.table(spark, d, "part").select(text.target_kind(F.col("p_name")).alias("kind"), F.col("p_name").alias("label"), F.concat(F.lit("make "), "p_name").alias("command")).distinct()
    return named.orderBy("kind", "label", "command")


#: Two lists of words for each issue: those of its title, and of the next line of its summary.
LISTS = "(SELECT bug_id, list_filter(string_split(title, ' '), lambda x: trim(x) <> '') AS a, list_filter(string_split(coalesce(string_split(summary, chr(10))[2], source), ' '), lambda x: trim(x) <> '') AS b FROM issues)"


def lists(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.filter(F.split(c, " "), lambda x: F.trim(x) != "")
    return src.issues(spark, d).select("bug_id", words(F.col("title")).alias("a"), words(F.coalesce(F.get(F.split("summary", "\n"), F.lit(1)), "source")).alias("b"))


@query("d02_sorted_dedupe", f"SELECT bug_id, array_to_string(list_sort(list_distinct(a)), '|') AS own, least(5, len(list_distinct(a))) AS n FROM {LISTS}")
def d02(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("bug_id", F.array_join(arrays.sorted_distinct(F.col("a")), "|").alias("own"), F.size(arrays.ordered_distinct(F.col("a"), 5)).cast("long").alias("n"))


@query("d04_difference", f"SELECT bug_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS gone FROM {LISTS}")
def d04(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("bug_id", F.array_join(arrays.difference(F.col("a"), F.col("b")), "|").alias("gone"))


@query("d06_replay_comparison", f"""SELECT bug_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed,
len(list_filter(b, lambda x: NOT list_contains(a, x))) + len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 AS changed FROM {LISTS}""")
def d06(spark: SparkSession, d: str) -> DataFrame:
    added, removed = F.size(arrays.ordered_difference(F.col("b"), F.col("a"))).cast("long"), F.size(arrays.ordered_difference(F.col("a"), F.col("b"))).cast("long")
    return lists(spark, d).select("bug_id", added.alias("added"), removed.alias("removed"), (added + removed > 0).alias("changed"))


@query("d07_last_wins", """SELECT result_id, file, arg_min(line, (created_at, line, hits)) AS first_line, arg_max(hits, (created_at, line, hits)) AS hits FROM coverage_lines GROUP BY ALL""")
def d07(spark: SparkSession, d: str) -> DataFrame:
    """Each key stands where it first came and holds what came last."""
    at = F.struct("created_at", "line", "hits")
    return src.coverage_lines(spark, d).groupBy("result_id", "file").agg(F.min_by("line", at).alias("first_line"), F.max_by("hits", at).alias("hits"))


SKIPPED = ", ".join(f"'{x}'" for x in paths.SKIPPED_DIRS)
IS_SKIPPED = "(len(list_filter(string_split(path, '/'), lambda p: p IN ({0}))) > 0 OR starts_with(path, 'backend/data/') OR starts_with(path, 'frontend/dist/'))"
EXTENSIONS = ", ".join(f"'{x}'" for x in paths.SCANNED_EXTENSIONS)
IS_SCANNED = "(NOT {0} AND regexp_extract(path, '\\.([^./]*)$', 1) IN ({1}))"


@query("u01_skipped_paths", f"SELECT file_id, {IS_SKIPPED.format(SKIPPED)} AS skipped, {IS_SCANNED.format(IS_SKIPPED.format(SKIPPED), EXTENSIONS)} AS scanned FROM (SELECT file_id, {FILE_PATH} AS path FROM files)")
def u01(spark: SparkSession, d: str) -> DataFrame:
    own = src.files(spark, d).select("file_id", file_path().alias("path"))
    return own.select("file_id", paths.is_skipped(F.col("path")).alias("skipped"), paths.is_scanned(F.col("path")).alias("scanned"))


@query("u03_map_roles", f"""SELECT file_id, CASE WHEN contains(lower(path), '/tests/') OR starts_with(lower(path), 'tests/') THEN 'test' WHEN {IS_SCANNED.format(IS_SKIPPED.format(SKIPPED + ", 'target'"), EXTENSIONS)} THEN 'source' END AS role
FROM (SELECT file_id, {FILE_PATH} AS path FROM files)""")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return src.files(spark, d).select("file_id", paths.map_role(file_path()).alias("role"))


@query("u12_line_marks", r"""SELECT conv_id, turn, 'sig_' || left(sha1('turn:' || conv_id || ':' || turn || ':' || regexp_replace(text, '^\s+|\s+$', '', 'g')), 12) AS signal_id, regexp_matches(text, '(^|\s)(?:#|//|/\*|\*)\s*(?:TODO|FIXME|BUG|HACK|XXX)\b') AS annotated FROM conversations""")
def u12(spark: SparkSession, d: str) -> DataFrame:
    mark = F.sha1(F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), paths.strip(F.col("text"))))
    return said(spark, d).select("conv_id", "turn", F.concat(F.lit("sig_"), F.left(mark, F.lit(12))).alias("signal_id"), F.col("text").rlike(paths.SIGNAL_RULES[0][3][0]).alias("annotated"))


@query("u19_path_tokens", "SELECT file_id, len(list_distinct(regexp_extract_all(lower(path), '[a-z0-9_]{3,}'))) AS n FROM files")
def u19(spark: SparkSession, d: str) -> DataFrame:
    return src.files(spark, d).select("file_id", F.size(paths.path_tokens(F.col("path"), 1000)).cast("long").alias("n"))


@query("u22_matched_terms", "SELECT conv_id, turn, array_to_string(list_filter(['the', 'and', 'ing', 'xyz'], lambda t: contains(lower(text), t)), ',') AS found FROM conversations")
def u22(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "and", "ing", "xyz")))
    return said(spark, d).select("conv_id", "turn", F.array_join(text.matched(terms, F.col("text")), ",").alias("found"))


@query("u25_draft_summary", r"SELECT conv_id, turn, left(regexp_replace(trim(string_split(text, chr(10))[1]), '^[-*0-9.)]+\s*', ''), 160) AS summary FROM conversations")
def u25(spark: SparkSession, d: str) -> DataFrame:
    first = F.regexp_replace(F.trim(F.split("text", "\n")[0]), r"^[-*0-9.)]+\s*", "")
    return said(spark, d).select("conv_id", "turn", F.left(first, F.lit(160)).alias("summary"))


@query("u29_git_status", """SELECT p_partkey, CASE WHEN starts_with(code, 'A') THEN 'added' WHEN starts_with(code, 'D') THEN 'deleted' WHEN starts_with(code, 'R') THEN 'renamed' WHEN starts_with(code, 'C') THEN 'copied'
WHEN contains(code, 'M') THEN 'modified' WHEN contains(code, '?') THEN 'untracked' ELSE 'unknown' END AS status FROM (SELECT p_partkey, upper(p_name) AS code FROM part)""")
def u29(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "part").select("p_partkey", paths.git_status(F.upper("p_name")).alias("status"))


@query("u31_taxonomy_ids", r"""SELECT p_partkey, array_to_string(list_distinct(regexp_extract_all(upper(p_name || ' cwe-' || p_size || ' x'), 'CWE-\d+')), ',') AS cwe_ids,
array_to_string(list_distinct(regexp_extract_all(upper('cve-20' || (p_size % 90 + 10) || '-1' || p_partkey || ' ' || p_name), 'CVE-\d{4}-\d+')), ',') AS cve_ids FROM part""")
def u31(spark: SparkSession, d: str) -> DataFrame:
    cwe = F.array("p_name", F.concat(F.lit("cwe-"), F.col("p_size").cast("string")))
    cve = F.array(F.concat(F.lit("cve-20"), (F.col("p_size") % 90 + 10).cast("string"), F.lit("-1"), F.col("p_partkey").cast("string")), F.col("p_name"))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(paths.taxonomy_ids(cwe, "cwe"), ",").alias("cwe_ids"), F.array_join(paths.taxonomy_ids(cve, "cve"), ",").alias("cve_ids"))


@query("u32_scanner_severity", "SELECT p_partkey, CASE WHEN p_size >= 4 THEN 'critical' WHEN p_size = 3 THEN 'high' WHEN p_size = 2 THEN 'medium' WHEN p_size = 1 THEN 'low' ELSE 'info' END AS by_number, CASE CAST(p_size AS VARCHAR) WHEN '4' THEN 'critical' WHEN '3' THEN 'high' WHEN '2' THEN 'medium' WHEN '1' THEN 'low' ELSE 'info' END AS by_text FROM part")
def u32(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return src.table(spark, d, "part").select("p_partkey", scanner.severity(size, F.lit(True)).alias("by_number"), scanner.severity(size).alias("by_text"))


@query("u36_coalesced_blanks", "SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN ' ' ELSE role END), ''), 'none') AS role FROM conversations")
def u36(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("role"))
    return said(spark, d).select("conv_id", "turn", F.coalesce(text.blank_to_null(role), F.lit("none")).alias("role"))


DDL = r"""'CREATE TABLE IF NOT EXISTS s.t' || p_partkey || ' (a INT); create table s.t' || (p_size % 10) || ' (d tsvector);' || chr(10) || ' ; CREATE TABLE IF NOT EXISTS s.t' || p_partkey || ' (a INT)'"""


@query("u40_table_names", rf"""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(sql, '(?i)create table (?:if not exists )?(?:[a-z_][a-z0-9_]*\.)?([a-z_][a-z0-9_]*)', 1))), ',') AS names,
len(list_filter(string_split(sql, ';'), lambda x: trim(x, ' ' || chr(10)) <> '')) AS statements FROM (SELECT p_partkey, {DDL} AS sql FROM part)""")
def u40(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("p_partkey").cast("string")
    sql = F.concat(F.lit("CREATE TABLE IF NOT EXISTS s.t"), id_, F.lit(" (a INT); create table s.t"), (F.col("p_size") % 10).cast("string"), F.lit(" (d tsvector);\n ; CREATE TABLE IF NOT EXISTS s.t"), id_, F.lit(" (a INT)"))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(text.table_names(sql), ",").alias("names"), F.size(text.statements(sql)).alias("statements"))


@query("m02_truncated_percent", "SELECT run_id, CAST(trunc(CAST(estimated_cost AS DOUBLE) * -10 + 0.5) AS BIGINT)::DOUBLE / 10 AS delta FROM run_metrics")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return src.run_metrics(spark, d).select("run_id", ((F.col("estimated_cost").cast("double") * -10 + 0.5).cast("long").cast("double") / 10).alias("delta"))


@query("m03_rates", "SELECT issue_id, CASE WHEN count(*) FILTER (status <> 'running') = 0 THEN 0.0 ELSE floor(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*) FILTER (status <> 'running') * 10 + 0.5) / 10 END AS rate FROM runs GROUP BY issue_id")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return src.runs(spark, d).groupBy("issue_id").agg(numbers.rate(F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") != "running")).alias("rate"))


@query("m04_durations", "SELECT run_id, date_diff('day', created_at, calculated_at) * 86400000 AS duration_ms FROM runs JOIN run_metrics USING (run_id)")
def m04(spark: SparkSession, d: str) -> DataFrame:
    joined = src.runs(spark, d).join(src.run_metrics(spark, d), "run_id")
    return joined.select("run_id", numbers.duration_ms(F.col("created_at"), F.col("calculated_at")).alias("duration_ms"))


@query("m07_parsed_times", "SELECT activity_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM activity")
def m07(spark: SparkSession, d: str) -> DataFrame:
    return src.activity(spark, d).select("activity_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("m08_clamps", "SELECT o_orderkey, least(greatest(o_totalprice, 1000), 50000) AS price FROM orders")
def m08(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "orders").select("o_orderkey", numbers.clamp(F.col("o_totalprice"), 1000.0, 50000.0).alias("price"))


@query("c02_run_text", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.text'), ''), json_extract_string(props, '$.k')) AS said, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def c02(spark: SparkSession, d: str) -> DataFrame:
    own = lambda p: F.get_json_object("props", p)
    return src.table(spark, d, "events").select("event_id", F.coalesce(text.blank_to_null(own("$.text")), own("$.k")).alias("said"), own("$.k").try_cast("bigint").alias("k"))


@query("c03_flat_details", "SELECT event_id, 'k ' || json_extract_string(props, '$.k') AS details FROM events")
def c03(spark: SparkSession, d: str) -> DataFrame:
    entries = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    return src.table(spark, d, "events").select("event_id", F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])), " ").alias("details"))


@query("c05_counts_in_order", "SELECT action, n, row_number() OVER (ORDER BY n DESC, action) AS place FROM (SELECT action, count(*) AS n FROM activity GROUP BY action)")
def c05(spark: SparkSession, d: str) -> DataFrame:
    counted = src.activity(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "action")))


@query("c07_confidence", "SELECT run_id, profile_id, CASE WHEN NOT success THEN 'low' WHEN NOT item_passed OR attempt_count > 1 THEN 'medium' ELSE 'high' END AS confidence, count(*) AS n FROM profile_history GROUP BY ALL")
def c07(spark: SparkSession, d: str) -> DataFrame:
    label = reviews.confidence(F.col("success"), (~F.col("item_passed")).cast("int"), F.col("attempt_count"))
    return src.profile_history(spark, d).groupBy("run_id", "profile_id", label.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("c09_runbook_steps", r"""SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^[0-9]+[.)]\s*', '')), lambda x: x <> '')) AS steps FROM conversations""")
def c09(spark: SparkSession, d: str) -> DataFrame:
    steps = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[0-9]+[.)]\s*", "")), lambda x: x != "")
    return said(spark, d).select("conv_id", "turn", F.size(steps).cast("long").alias("steps"))


@query("c10_summary_text", "SELECT run_id, coalesce(CASE WHEN status = 'completed' THEN runtime END, CASE WHEN model < '3' THEN model END, 'Run ' || run_id || ' was not summarised') AS summary FROM runs")
def c10(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("Run "), F.col("run_id").cast("string"), F.lit(" was not summarised"))
    return src.runs(spark, d).select("run_id", F.coalesce(F.when(F.col("status") == "completed", F.col("runtime")), F.when(F.col("model") < "3", F.col("model")), made).alias("summary"))


JACCARD = "(CASE WHEN len({0}) + len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END)"


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> ''))"


@query("q02_duplicate_score", f"""WITH w AS (SELECT bug_id, severity, evidence_path, labels, {WORDS.format("title")} AS t, {WORDS.format("summary")} AS s FROM issues),
o AS (SELECT bug_id, unnest(t) AS word FROM w), asked AS (SELECT * FROM o WHERE bug_id % 100 = 0),
pairs AS (SELECT DISTINCT x.bug_id AS a, y.bug_id AS b FROM asked x JOIN o y ON x.word = y.word AND x.bug_id <> y.bug_id),
j AS (SELECT a, b, {JACCARD.format("p.t", "q.t")} AS tj, {JACCARD.format("p.s", "q.s")} AS sj, p.severity = q.severity AS same, (p.evidence_path = q.evidence_path)::INT::DOUBLE AS ej, {JACCARD.format("p.labels", "q.labels")} AS lj
FROM pairs JOIN w p ON p.bug_id = a JOIN w q ON q.bug_id = b)
SELECT a, b, floor(least(CASE WHEN tj > 0.5 THEN tj * 0.35::DOUBLE ELSE 0 END + CASE WHEN sj > 0.4 THEN sj * 0.25::DOUBLE ELSE 0 END + 0.1::DOUBLE * same::INT + ej * 0.2::DOUBLE + lj * 0.1::DOUBLE, 1) * 1000 + 0.5) / 1000 AS score FROM j WHERE tj >= 0.3""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the issues whose id is divisible by 100; they meet all whose
    titles are like theirs, and each pair is scored by all its parts."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    issues = src.issues(spark, d).select("bug_id", words(F.col("title")).alias("t"), words(F.col("summary")).alias("s"), "severity", F.col("evidence_path").alias("path"), "labels")
    both = duplicates.alike(issues, issues.where("bug_id % 100 = 0"), 0.3, more=True)
    return both.select("a", "b", reviews.similarity(F.col("score"), F.col("s"), F.col("severity"), F.col("path").cast("double"), F.col("labels")).alias("score"))


@query("q03_triage", """SELECT bug_id, CASE WHEN e AND w THEN 'critical' WHEN e AND b THEN 'high' END AS suggested_severity, round(0.3 * (e AND w)::INT + 0.25 * (e AND NOT w AND b)::INT, 2)::DOUBLE AS confidence FROM (
SELECT bug_id, bug_id % 3 = 0 AS e, regexp_matches(lower(summary), 'crash|data loss|security|rce|injection') AS w, regexp_matches(lower(summary), 'break|fail|error|wrong') AS b FROM issues)""")
def q03(spark: SparkSession, d: str) -> DataFrame:
    issues = src.issues(spark, d).select("bug_id", F.when(F.col("bug_id") % 3 == 0, "medium").otherwise("P1").alias("severity"), F.col("summary").alias("impact"), "labels", "drift_flags", "source", F.array("evidence_path").alias("evidence_paths"))
    return reviews.triage(issues).select("bug_id", "suggested_severity", "confidence")


CRITIQUE = r"""SELECT run_id, greatest(0, 1::DOUBLE - 0.3::DOUBLE * (code <> 0)::INT - 0.15::DOUBLE * contains(low, 'traceback')::INT - 0.15::DOUBLE * (contains(low, 'exception') AND NOT contains(low, 'caught'))::INT) AS correctness,
0.3::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE * (tools > 0)::INT + 0.2::DOUBLE * (n > 3)::INT AS completeness, n FROM (SELECT run_id, string_agg(text, chr(10) ORDER BY pos) AS own, lower(string_agg(text, chr(10) ORDER BY pos)) AS low,
count(*) AS n, count(*) FILTER (type = 'assistant') AS tools, run_id % 3 AS code FROM output_lines GROUP BY run_id)"""


def outputs(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return src.output_lines(spark, d).groupBy("run_id").agg(F.array_join(ordered, "\n").alias("text"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "assistant").alias("tool_events")).withColumns(
        {"exit_code": F.col("run_id") % 3, "error": F.lit(None).cast("string"), "excerpt": F.left("text", F.lit(50))})


@query("q04_critique", f"SELECT run_id, correctness, completeness FROM ({CRITIQUE})")
def q04(spark: SparkSession, d: str) -> DataFrame:
    return reviews.critiques(outputs(spark, d)).select("run_id", "correctness", "completeness")


@query("q07_style", """SELECT conv_id, turn, CASE WHEN trim(text, ' ' || chr(10) || chr(13) || chr(9)) = '' THEN 0.3 ELSE 0.7::DOUBLE - 0.1::DOUBLE * (list_avg(own) > 200)::INT - 0.15::DOUBLE * (len(list_filter(own, lambda n: n > 500)) > 5)::INT END AS style
FROM (SELECT conv_id, turn, text, list_transform(string_split_regex(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, '\\r?\\n'), lambda x: length(x)) AS own FROM conversations)""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("conv_id", "turn", reviews.style(F.col("text")).alias("style"))


@query("q09_line_rules", r"""SELECT run_id, line_no, found FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no, list_position(['TODO', 'FIXME', 'HACK', 'XXX', 'secret'], found)) AS place FROM (
SELECT run_id, line_no, unnest(list_filter([CASE WHEN contains(line, 'TODO') THEN 'TODO' END, CASE WHEN contains(line, 'FIXME') THEN 'FIXME' END, CASE WHEN contains(line, 'HACK') THEN 'HACK' END, CASE WHEN contains(line, 'XXX') THEN 'XXX' END,
CASE WHEN regexp_matches(lower(line), 'password|secret|api_key|token') AND NOT regexp_matches(line, 'env\(|os\.environ|getenv') THEN 'secret' END], lambda x: x IS NOT NULL)) AS found
FROM (SELECT doc_id AS run_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))) WHERE place <= 20""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    lines = src.table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    return reviews.improvements(lines).select("run_id", "line_no", "found")


@query("q10_patch_issues", """SELECT conv_id, turn, (turn % 3 <> 0)::INT + contains(lower(text), 'traceback')::INT + (contains(lower(text), 'exception') AND NOT contains(lower(text), 'caught'))::INT + contains(lower(text), 'panic')::INT
+ (contains(lower(text), 'segmentation fault') OR contains(lower(text), 'segfault'))::INT + (trim(text) = '')::INT AS n FROM conversations""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("conv_id", "turn", F.size(reviews.patch_issues(F.col("text"), F.col("turn") % 3, F.lit(None).cast("string"))).alias("n"))


@query("q12_scope_warnings", """SELECT bug_id, array_to_string(list_filter([evidence_path, './src/src1', './other'], lambda p: NOT (p = './src/src1' OR starts_with(p, './src/src1/') OR starts_with('./src/src1', p || '/'))), ',') AS outside FROM issues""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.array(F.col("evidence_path"), F.lit("./src/src1"), F.lit("./other"))
    return src.issues(spark, d).select("bug_id", F.array_join(reviews.out_of_scope(dirty, F.array(F.lit("./src/src1"))), ",").alias("outside"))


@query("q14_test_suggestions", """SELECT bug_id, regexp_replace(evidence_path, '\\.py$', '.test.py') AS file, CASE WHEN lower(severity) IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS priority FROM issues""")
def q14(spark: SparkSession, d: str) -> DataFrame:
    tests = reviews.test_files(F.array("evidence_path"), F.col("severity"))
    return src.issues(spark, d).select("bug_id", F.inline(tests))


@query("q15_related_paths", """WITH s AS (SELECT source, evidence_path AS path, max(CASE WHEN contains(lower(title), 'the') THEN 6 ELSE 0 END + 2 * len(list_filter(['en', 'de', 'src'], lambda t: contains(evidence_path, t)))) AS score FROM issues GROUP BY ALL)
SELECT source, path, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, path) AS place FROM s) WHERE place <= 8""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("en", "de", "src")))
    score = F.when(F.lower("title").contains("the"), 6).otherwise(0) + F.size(F.filter(terms, lambda t: F.contains(F.col("evidence_path"), t))) * 2
    best = src.issues(spark, d).groupBy("source", F.col("evidence_path").alias("path")).agg(F.max(score).alias("score"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "path")))
    return placed.where("place <= 8").select("source", "path", F.col("score").cast("long").alias("score"))
