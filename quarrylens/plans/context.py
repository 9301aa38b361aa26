"""Context of issues and changes: links, criteria, related artifacts and extracted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import arrays, paths, text
from quarrylens.operators import context, reviews
from quarrylens.plans.rules import FILE_PATH, LISTS, file_path, lists, said
from quarrylens.registry import query
from quarrylens.sources import adapters as src
from quarrylens.sources import git, trees


@query("f12_pinned_runs", """SELECT issue_id, run_id, row_number() OVER (PARTITION BY issue_id ORDER BY list_position(own, run_id), run_id) AS place FROM (
SELECT issue_id, run_id, CASE WHEN issue_id % 2 = 0 THEN [] ELSE [issue_id * 5, issue_id * 3, issue_id * 2] END AS own FROM runs) WHERE issue_id % 2 = 0 OR list_contains(own, run_id)""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("c_custkey")
    own = F.when(id_ % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array(id_ * 5, id_ * 3, id_ * 2))
    scenarios = src.table(spark, d, "customer").select(id_.alias("issue_id"), own.alias("pinned"))
    return context.pinned(src.runs(spark, d).select("issue_id", "run_id"), scenarios, "issue_id", "pinned", "run_id")


@query("j11_linked_plans", """SELECT run_id, n, n + 8 AS score FROM (SELECT l_orderkey AS run_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1)
ORDER BY score DESC, run_id LIMIT 8""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    steps = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.array("l_partkey").alias("files"))
    return context.linked_plans(steps, src.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("path")))


@query("j12_linked_activity", """SELECT activity_id, summary FROM (SELECT * FROM activity ORDER BY created_at DESC, activity_id DESC LIMIT 80) WHERE contains(lower(summary), '7') OR contains(lower(summary), 'click')
ORDER BY created_at DESC, activity_id DESC LIMIT 8""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return context.linked_activity(src.activity(spark, d), ["7", "Click"]).select("activity_id", "summary")


@query("j14_batch_runs", """SELECT batch_id, scenario_id, run_id FROM (SELECT issue_id AS batch_id, model AS scenario_id, run_id, row_number() OVER (PARTITION BY issue_id, model ORDER BY run_id) AS p FROM runs WHERE model IN ('1-URGENT', '2-HIGH')) WHERE p = 1""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    runs = src.runs(spark, d).select("run_id", "issue_id", F.col("model").alias("scenario_id"))
    queue = runs.select(F.col("issue_id").alias("batch_id"), F.col("run_id").alias("pos"), "run_id")
    asked = queue.select("batch_id").distinct().select("batch_id", F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("scenario_id"))
    return context.batch_runs(queue, asked, runs.drop("issue_id"))


@query("s21_worktree", """SELECT count(*) AS dirty_files, count(*) FILTER (p_size % 3 = 0) AS untracked_files, count(*) FILTER (p_size % 3 = 1) AS staged_files FROM part""")
def s21(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("? src/"), name)).otherwise(F.concat(F.when(F.col("p_size") % 3 == 1, "1 M. ").otherwise("1 .M "), F.lit("N... 1 1 1 a b src/"), name))
    return git.worktree(src.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), line.alias("line"))).select("dirty_files", "untracked_files", "staged_files")


@query("s22_directory", f"SELECT name, max(deep) AS is_dir FROM (SELECT string_split(path, '/')[1] AS name, contains(path, '/') AS deep FROM (SELECT {FILE_PATH} AS path FROM files)) GROUP BY name ORDER BY is_dir DESC, lower(name), name LIMIT 80")
def s22(spark: SparkSession, d: str) -> DataFrame:
    return trees.directory(src.files(spark, d).select(file_path().alias("path"))).select("name", "is_dir")


@query("s02_candidates", f"SELECT path FROM (SELECT {FILE_PATH} AS path FROM files) WHERE (starts_with(path, 'src/') OR starts_with(path, 'tests/') OR NOT contains(path, '/')) AND regexp_matches(path, '\\.(py|ts)$') ORDER BY path LIMIT 180")
def s02(spark: SparkSession, d: str) -> DataFrame:
    own = src.files(spark, d).select(file_path().alias("path"))
    return own.where(paths.is_scanned(F.col("path"))).orderBy("path").limit(180)


@query("d03_bounded_push", f"SELECT bug_id, least(3, len(list_distinct(list_concat(a, ['new'])))) AS n FROM {LISTS}")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("bug_id", F.size(arrays.ordered_distinct(F.concat("a", F.array(F.lit("new"))), 3)).cast("long").alias("n"))


@query("d11_variant_diff", f"SELECT bug_id, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' ') AS added, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS removed FROM {LISTS}")
def d11(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return lists(spark, d).select("bug_id", F.array_join(arrays.ordered_difference(b, a), " ").alias("added"), F.array_join(arrays.ordered_difference(a, b), " ").alias("removed"))


@query("u08_evidence", "SELECT bug_id, evidence_path AS path, CASE WHEN bug_id % 2 = 0 THEN bug_id::INT END AS line FROM issues")
def u08(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("bug_id") % 2 == 0, F.concat(F.lit(":"), F.col("bug_id").cast("string"))).otherwise("")
    said_ = F.concat(F.lit("see `"), "evidence_path", place, F.lit("`, `pytest -q`, `pytest/x.py` and `word`"))
    return src.issues(spark, d).select("bug_id", F.inline(paths.evidence_of(said_)))


@query("u17_import_lines", r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(ltrim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' '), '^(import |from |use |mod |require\()') OR starts_with(ltrim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' '), 'const ') AND contains(x, 'require('))) AS n
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'const a = require("b")' || chr(10) || ' use c' || chr(10) || text ELSE text END AS text FROM documents)""")
def u17(spark: SparkSession, d: str) -> DataFrame:
    said_ = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('const a = require("b")\n use c\n'), "text")).otherwise(F.col("text"))
    return src.table(spark, d, "documents").select("doc_id", paths.import_lines(paths.text_lines(said_)).cast("long").alias("n"))


@query("u21_context_tokens", r"""SELECT bug_id, len(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || summary || ' ' || array_to_string(labels, ' ')), '[a-z0-9_]{3,}'), lambda t: t NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this')))) AS n FROM issues""")
def u21(spark: SparkSession, d: str) -> DataFrame:
    return src.issues(spark, d).select("bug_id", F.size(text.query_tokens(F.concat_ws(" ", "title", "summary", F.array_join("labels", " ")))).cast("long").alias("n"))


@query("u23_test_commands", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pytest tests/' || p_size || '|npm run build' ELSE 'cargo test' END AS commands FROM part")
def u23(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    even = F.concat(F.lit("ran `pytest   tests/"), size, F.lit("` and `npm run build`, then `pytest tests/"), size, F.lit("` again"))
    commands = context.test_commands(F.when(F.col("p_size") % 2 == 0, even).otherwise("`cargo test`"))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(commands, "|").alias("commands"))


@query("u24_named_files", "SELECT p_partkey, 'src/a' || p_size || '.py,lib/b.ts' AS files FROM part")
def u24(spark: SparkSession, d: str) -> DataFrame:
    said_ = F.concat(F.lit("changed src/a"), F.col("p_size").cast("string"), F.lit(".py: and lib/b.ts | lib/b.ts, no file here"))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(context.named_files(said_), ",").alias("files"))


@query("u26_criteria", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a ' || p_name || '|b' ELSE 'x|y' END AS criteria FROM part")
def u26(spark: SparkSession, d: str) -> DataFrame:
    even = F.concat(F.lit("- x\n## Acceptance criteria\n- a "), "p_name", F.lit("\n2. b\n## Other\n- c"))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(context.criteria(F.when(F.col("p_size") % 2 == 0, even).otherwise("text\n- [ ] x\n- [x] y")), "|").alias("criteria"))


@query("c01_json_in_text", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{"v":' || p_size || '}' WHEN 1 THEN '{"w":' || p_size || '}' END AS found, CASE p_size % 2 WHEN 0 THEN 'no' ELSE 'yes' END AS verdict FROM part""")
def c01(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    said_ = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('so:\n```json\n{"v":'), size, F.lit("}\n```\nand {more}"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit('so {"w":'), size, F.lit("} it is"))).otherwise("nothing {here")
    verdict = context.verdict_of(F.when(F.col("p_size") % 2 == 0, "It is NOT fixed").otherwise("Fixed now"))
    return src.table(spark, d, "part").select("p_partkey", context.json_in(said_).alias("found"), verdict.alias("verdict"))


@query("c06_checklist", "SELECT run_id, profile_id, count(*) AS n, CAST(sum((success)::INT + (item_passed)::INT) AS BIGINT) AS passed FROM profile_history GROUP BY ALL")
def c06(spark: SparkSession, d: str) -> DataFrame:
    items = context.checklist(F.array(F.lit("Tests pass"), F.lit("Has Coverage")), F.col("success"), F.when(F.col("item_passed"), 1))
    passed = F.size(F.filter(items, lambda x: x["passed"]))
    return src.profile_history(spark, d).groupBy("run_id", "profile_id").agg(F.count(F.lit(1)).alias("n"), F.sum(passed).alias("passed"))


@query("q11_acceptance", """SELECT p_partkey, CASE WHEN n >= 2 THEN 'met' WHEN n = 1 THEN 'partial' ELSE 'not_met' END AS state FROM (SELECT p_partkey, len(list_filter(['alpha', 'gamma', 'delta'], lambda t: contains(CASE p_size % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'alpha delta' ELSE 'none' END, t))) AS n FROM part)""")
def q11(spark: SparkSession, d: str) -> DataFrame:
    corpus = src.case(F.col("p_size") % 3, {0: "Alpha", 1: "alpha delta"}, "none")
    return src.table(spark, d, "part").select("p_partkey", reviews.acceptance(F.lit("the alpha and gamma, delta"), corpus).alias("state"))


@query("q13_session_insights", """SELECT run_id, array_to_string(list_filter([CASE WHEN status = 'completed' THEN 'finished' END, CASE WHEN status = 'failed' THEN 'failed' END, CASE WHEN run_id % 3 <> 0 THEN 'non-zero exit' END,
CASE WHEN run_id % 2 = 1 THEN 'used tools' END, CASE WHEN run_id % 2 = 0 THEN 'used no tools' END, CASE WHEN status = 'completed' AND runtime <> 'BUILDING' THEN 'needs review' END], lambda x: x IS NOT NULL), ',') AS insights FROM runs""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    own = context.insights(F.col("status"), F.col("run_id") % 3, F.col("run_id") % 2, F.col("runtime") == "BUILDING")
    return src.runs(spark, d).select("run_id", F.array_join(own, ",").alias("insights"))


ARTIFACT = "SELECT '{0}' AS kind, CAST({1} AS VARCHAR) AS id, least(4, len(list_filter(['the', 'blue', 'a1'], lambda t: contains(lower({2}), t)))) * 2 + {3} AS score FROM {4} WHERE len(list_filter(['the', 'blue', 'a1'], lambda t: contains(lower({2}), t))) > 0"


@query("q17_related_artifacts", f"""SELECT kind, id, score FROM ({ARTIFACT.format("fix", "p_partkey", "p_name", 2, "part")} UNION ALL {ARTIFACT.format("turn", "conv_id * 100 + turn", "text", 1, "conversations")} UNION ALL {ARTIFACT.format("item", "item_id", "text", 0, "benchmark")})
ORDER BY score DESC, kind, id LIMIT 8""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "blue", "a1")))
    table = lambda name, id_, c: src.table(spark, d, name).select(id_.alias("id"), F.col(c).alias("text"))
    return context.ranked_artifacts({
        "fix": (table("part", F.col("p_partkey"), "p_name"), 2), "turn": (table("conversations", F.col("conv_id") * 100 + F.col("turn"), "text"), 1), "item": (table("benchmark", F.col("item_id"), "text"), 0)}, terms)


@query("u38_labels", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS labels FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def u38(spark: SparkSession, d: str) -> DataFrame:
    named = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "system", " ").otherwise(F.col("role")).alias("name")))), lambda x: x["name"])
    grouped = said(spark, d).groupBy("conv_id").agg(F.filter(named, lambda x: F.trim(x) != "").alias("own"))
    return grouped.where(F.size("own") > 0).select("conv_id", F.array_join("own", ",").alias("labels"))
