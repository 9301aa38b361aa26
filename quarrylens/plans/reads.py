"""Filters, orders, joins and sets over the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import arrays
from quarrylens.functions.text import plain_path
from quarrylens.operators import joins, selection
from quarrylens.registry import query
from quarrylens.sources import adapters as src

ISSUE = ("bug_id", "severity", "issue_status", "source")


@query("f01_issue_filter", """SELECT bug_id, severity, issue_status, source FROM issues
WHERE severity IN ('P1', 'P2') AND issue_status IN ('open', 'triaged') AND source IN ('src0', 'src1', 'src2')
AND len(list_filter(labels, lambda x: lower(x) IN ('good', 'toxic'))) > 0 AND len(drift_flags) > 0
AND (contains(lower(CAST(bug_id AS VARCHAR)), 'the') OR contains(lower(title), 'the') OR contains(lower(summary), 'the'))""")
def f01(spark: SparkSession, d: str) -> DataFrame:
    found = selection.issue_filter(src.issues(spark, d), "The", ["P1", " P2 "], ["open", "triaged"], ["src0", "src1", "src2"], ["good", "TOXIC"], drift_only=True)
    return found.select(*ISSUE)


@query("f02_signal_filter", """SELECT activity_id, entity_id, issue_id IS NOT NULL AS promoted FROM activity
WHERE entity_type = 'signal' AND issue_id IS NOT NULL AND contains(lower(summary), '7')""")
def f02(spark: SparkSession, d: str) -> DataFrame:
    signals = src.activity(spark, d).where("entity_type = 'signal'")
    promoted = F.col("issue_id").isNotNull()
    return signals.where(promoted & F.lower("summary").contains("7")).select("activity_id", "entity_id", promoted.alias("promoted"))


@query("f03_activity_filter", "SELECT activity_id, action, actor_key FROM activity WHERE issue_id = '7'")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return selection.activity_filter(src.activity(spark, d), issue_id="7").select("activity_id", "action", "actor_key")


@query("f04_activity_search", """SELECT activity_id, action FROM activity WHERE action = 'click'
AND contains(lower(concat_ws(' ', summary, action, entity_type, entity_id, actor_label, issue_id, run_id)), 'user 1')""")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return selection.activity_search(src.activity(spark, d), "User 1", action="click").select("activity_id", "action")


@query("f05_saved_view", """SELECT bug_id, severity FROM issues WHERE severity IN ('P0') AND needs_followup""")
def f05(spark: SparkSession, d: str) -> DataFrame:
    stored = {"severities": ["P0"], "needs_followup": True}
    return selection.issue_filter(src.issues(spark, d), **stored).select("bug_id", "severity")


@query("f06_queue_presets", """SELECT
count(*) FILTER (severity IN ('P0', 'P1') AND issue_status IN ('open', 'triaged', 'investigating', 'in_progress')) AS critical_open,
count(*) FILTER (issue_status = 'verification') AS verification,
count(*) FILTER (len(drift_flags) > 0 AND needs_followup) AS followup_drift,
count(*) FILTER (len(drift_flags) > 0 AND source IN ('src0', 'src1')) AS source_drift FROM issues""")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return selection.queue_presets(src.issues(spark, d))


@query("f07_point_lookup", "SELECT bug_id, title FROM issues WHERE bug_id = 77")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return src.issues(spark, d).where("bug_id = 77").select("bug_id", "title")


@query("f08_missing_evidence", """SELECT bug_id, evidence_path FROM issues
WHERE ltrim(evidence_path, './') NOT IN (SELECT ltrim(evidence_path, './') FROM issues WHERE doc_status = 'fixed')""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    issues = src.issues(spark, d).withColumn("path", plain_path(F.col("evidence_path")))
    known = issues.where("doc_status = 'fixed'").select("path").distinct()
    return issues.join(known, "path", "left_anti").select("bug_id", "evidence_path")


@query("f11_fixes_of_issue", "SELECT fix_id, run_id, strftime(recorded_at, '%Y-%m-%d') AS recorded FROM fixes WHERE issue_id BETWEEN 100 AND 200")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return src.fixes(spark, d).where("issue_id BETWEEN 100 AND 200").select("fix_id", "run_id", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded"))


@query("f13_workspace_list", "SELECT r_regionkey AS workspace_id, r_name AS name, row_number() OVER (ORDER BY lower(r_name), r_regionkey) AS place FROM region")
def f13(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.orderBy(F.lower("r_name"), "r_regionkey"))
    return src.table(spark, d, "region").select(F.col("r_regionkey").alias("workspace_id"), F.col("r_name").alias("name"), place.alias("place"))


@query("j01_review_queue", """SELECT r.run_id, r.issue_id, i.title FROM runs r JOIN issues i ON r.issue_id = i.bug_id
WHERE r.status = 'completed' AND r.run_id NOT IN (SELECT run_id FROM fixes) AND r.run_id NOT IN (SELECT run_id FROM reviews)""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    runs = src.runs(spark, d).where("status = 'completed'")
    ready = runs.join(src.fixes(spark, d), "run_id", "left_anti").join(src.reviews(spark, d), "run_id", "left_anti")
    return ready.join(src.issues(spark, d), F.col("issue_id") == F.col("bug_id")).select("run_id", "issue_id", "title")


@query("j02_review_ready", """SELECT issue_id, count(*) AS n, string_agg(CASE WHEN place <= 8 THEN CAST(run_id AS VARCHAR) END, ',' ORDER BY place) AS run_ids
FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, run_id DESC) AS place FROM runs r
WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM fixes f WHERE f.run_id = r.run_id) AND NOT EXISTS (SELECT 1 FROM reviews v WHERE v.run_id = r.run_id))
GROUP BY issue_id""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    found = joins.review_ready(src.runs(spark, d), src.fixes(spark, d), src.reviews(spark, d))
    return found.withColumn("run_ids", F.array_join(F.transform("run_ids", lambda x: x.cast("string")), ","))


@query("j03_verdict_enrich", """SELECT bug_id, code_status, CASE WHEN doc_status = 'fixed' AND code_status <> 'fixed' THEN 'doc_fixed_code_not_fixed'
WHEN code_status = 'fixed' AND doc_status <> 'fixed' THEN 'code_fixed_doc_not_fixed' END AS flag
FROM (SELECT bug_id, doc_status, coalesce(verdict, code_status) AS code_status FROM issues LEFT JOIN
(SELECT issue_id, arg_max(status, run_id) AS verdict FROM runs GROUP BY issue_id) ON bug_id = issue_id)""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    verdicts = src.runs(spark, d).select(F.col("issue_id").alias("bug_id"), F.col("run_id").alias("pos"), F.col("status").alias("verdict"))
    return joins.with_verdicts(src.issues(spark, d), verdicts).select("bug_id", "code_status", "flag")


@query("j04_tracker_merge", """SELECT coalesce(i.bug_id, t.bug_id) AS bug_id, coalesce(nullif(trim(t.title), ''), i.title) AS title,
CASE WHEN t.bug_id IS NOT NULL THEN t.issue_status ELSE i.issue_status END AS issue_status,
list_aggregate(list_sort(list_distinct(list_concat(coalesce(i.labels, []), coalesce(t.labels, [])))), 'string_agg', ',') AS labels
FROM (SELECT * FROM issues WHERE severity <> 'P3') i FULL OUTER JOIN
(SELECT bug_id, CASE WHEN source = 'src1' THEN ' ' ELSE title || '!' END AS title, 'tracked' AS issue_status, ['Tracked'] AS labels FROM issues WHERE severity IN ('P2', 'P3')) t
ON i.bug_id = t.bug_id""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    issues = src.issues(spark, d)
    tracked = issues.where("severity IN ('P2', 'P3')").select(
        "bug_id", F.when(F.col("source") == "src1", " ").otherwise(F.concat(F.col("title"), F.lit("!"))).alias("title"), F.lit("tracked").alias("issue_status"), F.array(F.lit("Tracked")).alias("labels"))
    imported = issues.where("severity <> 'P3'").select("bug_id", "title", "issue_status", "labels")
    merged = joins.tracker_merge(imported, tracked, ["title"], ["issue_status"])
    return merged.withColumn("labels", F.when(F.size("labels") > 0, F.array_join("labels", ",")))


@query("j05_override_patch", """SELECT i.bug_id, coalesce(nullif(trim(p.severity), ''), i.severity) AS severity, coalesce(nullif(trim(p.source), ''), i.source) AS source
FROM issues i LEFT JOIN (SELECT doc_id AS bug_id, CASE WHEN toxic = 1 THEN 'P0' ELSE '' END AS severity, CASE WHEN quality = 0 THEN 'junk' END AS source FROM labels) p ON i.bug_id = p.bug_id""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    patch = src.table(spark, d, "labels").select(F.col("doc_id").alias("bug_id"), F.when(F.col("toxic") == 1, "P0").otherwise("").alias("severity"), F.when(F.col("quality") == 0, "junk").alias("source"))
    return joins.patched(src.issues(spark, d).select("bug_id", "severity", "source"), patch, ["severity", "source"])


@query("j06_history_runs", """SELECT profile_id, coalesce(runtime, 'manual') AS runtime, count(*) AS n, count(*) FILTER (success) AS succeeded
FROM profile_history h LEFT JOIN (SELECT run_id, runtime FROM runs WHERE status <> 'failed') r USING (run_id) GROUP BY ALL""")
def j06(spark: SparkSession, d: str) -> DataFrame:
    runs = src.runs(spark, d).where("status <> 'failed'").select("run_id", "runtime")
    joined = src.profile_history(spark, d).join(runs, "run_id", "left").withColumn("runtime", F.coalesce("runtime", F.lit("manual")))
    return joined.groupBy("profile_id", "runtime").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("succeeded"))


@query("j07_threat_models", """SELECT finding_id, string_agg(n_name, ',' ORDER BY pos) AS models FROM
(SELECT finding_id, unnest(threat_model_ids) AS id, generate_subscripts(threat_model_ids, 1) AS pos FROM findings) JOIN nation ON n_nationkey = id GROUP BY finding_id""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    found = src.findings(spark, d).select("finding_id", "threat_model_ids")
    out = joins.array_membership(found, "threat_model_ids", src.table(spark, d, "nation"), "n_nationkey", "n_name")
    return out.select("finding_id", F.array_join("values", ",").alias("models"))


@query("j08_vulnerability_join", """SELECT finding_id, coalesce(title, CAST(issue_id AS VARCHAR)) AS issue_title, coalesce(severity, 'unknown') AS issue_severity
FROM (SELECT finding_id, issue_id FROM findings) LEFT JOIN (SELECT bug_id, title, severity FROM issues WHERE source <> 'src2') ON issue_id = bug_id""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    issues = src.issues(spark, d).where("source <> 'src2'").select(F.col("bug_id").alias("issue_id"), F.col("title").alias("issue_title"), F.col("severity").alias("issue_severity"))
    joined = src.findings(spark, d).select("finding_id", F.col("issue_id").cast("long")).join(issues, "issue_id", "left")
    return joined.select("finding_id", F.coalesce("issue_title", F.col("issue_id").cast("string")).alias("issue_title"), F.coalesce("issue_severity", F.lit("unknown")).alias("issue_severity"))


@query("j09_duplicate_titles", r"""WITH words AS (SELECT bug_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda x: x <> '')) AS own FROM issues),
opened AS (SELECT bug_id, len(own) AS n, unnest(own) AS word FROM words)
SELECT a.bug_id AS a, b.bug_id AS b, count(*) AS common, count(*) / (a.n + b.n - count(*)) AS score
FROM opened a JOIN opened b ON a.word = b.word AND a.bug_id <> b.bug_id WHERE a.bug_id % 100 = 0 GROUP BY a.bug_id, b.bug_id, a.n, b.n
HAVING count(*) / (a.n + b.n - count(*)) >= 0.3""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the issues whose id is divisible by 100; they meet all."""
    issues = src.issues(spark, d).select("bug_id", "title")
    return joins.similar_titles(issues, issues.where("bug_id % 100 = 0"))


@query("j13_latest_fix", """SELECT issue_id, arg_max(fix_id, (recorded_at, run_id)) AS fix_id FROM fixes GROUP BY issue_id""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return src.fixes(spark, d).groupBy("issue_id").agg(F.max_by("fix_id", F.struct("recorded_at", "run_id")).alias("fix_id"))


@query("j15_profile_delta", """SELECT coalesce(a.profile_id, b.profile_id) AS profile_id, coalesce(a.n, 0) AS a_n, coalesce(b.n, 0) AS b_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta_n
FROM (SELECT profile_id, count(*) AS n FROM profile_history WHERE success AND profile_id < 6 GROUP BY 1) a
FULL OUTER JOIN (SELECT profile_id, count(*) AS n FROM profile_history WHERE NOT success AND profile_id > 2 GROUP BY 1) b ON a.profile_id = b.profile_id""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df: df.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    history = src.profile_history(spark, d)
    return joins.full_delta(count(history.where("success AND profile_id < 6")), count(history.where("NOT success AND profile_id > 2")), "profile_id", ["n"])


@query("j16_scenario_runs", """SELECT s.c_custkey AS issue_id, r.run_id FROM customer s JOIN runs r ON r.issue_id = s.c_custkey
WHERE s.c_nationkey < 5 OR list_contains([s.c_custkey * 3, s.c_custkey * 5], r.run_id)""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    pinned = F.when(F.col("c_nationkey") < 5, F.array().cast("array<bigint>")).otherwise(F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 5))
    scenarios = src.table(spark, d, "customer").select(F.col("c_custkey").alias("issue_id"), pinned.alias("pinned"))
    joined = src.runs(spark, d).join(scenarios, "issue_id")
    return joined.where((F.size("pinned") == 0) | F.expr("array_contains(pinned, run_id)")).select("issue_id", "run_id")


@query("j17_prior_head", """SELECT issue_id, coalesce(arg_max(runtime, (created_at, run_id)) FILTER (status <> 'failed'), 'HEAD') AS head FROM runs GROUP BY issue_id""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("status") != "failed", F.struct("created_at", "run_id"))
    return src.runs(spark, d).groupBy("issue_id").agg(F.coalesce(F.max_by("runtime", order), F.lit("HEAD")).alias("head"))


@query("k04_upsert", """SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def k04(spark: SparkSession, d: str) -> DataFrame:
    old = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return joins.upserted(old, src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("k05_partition_replace", """SELECT p_brand AS path, p_partkey AS symbol, p_name AS kind FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)
UNION ALL SELECT p_brand, p_partkey, 'new' FROM part WHERE p_size > 49""")
def k05(spark: SparkSession, d: str) -> DataFrame:
    part = src.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("symbol"), F.col("p_name").alias("kind"), "p_size")
    new = part.where("p_size > 49").select("path", "symbol", F.lit("new").alias("kind"))
    return part.select("path", "symbol", "kind").join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


@query("w01_latest_run", """SELECT issue_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, run_id DESC) AS p FROM runs) WHERE p = 1""")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return selection.latest_per(src.runs(spark, d), ["issue_id"], [F.desc("created_at"), F.desc("run_id")], "run_id").select("issue_id", "run_id", "status")


@query("w03_fresh_runs", """SELECT issue_id, run_id, previous, strftime(created_at, '%Y-%m-%d') AS created FROM (SELECT *, row_number() OVER w AS p, lead(run_id) OVER w AS previous FROM runs
WINDOW w AS (PARTITION BY issue_id ORDER BY created_at DESC, run_id DESC)) WHERE p = 1""")
def w03(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("issue_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    placed = src.runs(spark, d).withColumns({"p": F.row_number().over(w), "previous": F.lead("run_id").over(w)})
    return placed.where("p = 1").select("issue_id", "run_id", "previous", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("t01_top_by_class", """SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS p FROM part) WHERE p <= 10""")
def t01(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return src.table(spark, d, "part").withColumn("p", place).where("p <= 10").select("p_type", "p_partkey", "p_retailprice")


@query("t02_ranked_findings", """SELECT finding_id, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END AS rank
FROM findings ORDER BY rank, lower(title), finding_id""")
def t02(spark: SparkSession, d: str) -> DataFrame:
    ranked = src.findings(spark, d).withColumn("rank", selection.severity_rank(F.col("severity")))
    return ranked.orderBy("rank", F.lower("title"), "finding_id").select("finding_id", "severity", "rank")


@query("t05_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def t05(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("d01_sets", """SELECT bug_id, array_to_string(list_sort(list_distinct(list_transform(drift_flags, lambda x: split_part(x, ':', 1)))), ',') AS distinct_flags,
array_to_string(list_sort(list_filter(drift_flags, lambda x: NOT list_contains(['doc_fixed_code_not_fixed', 'code_fixed_doc_not_fixed'], x))), ',') AS left_over FROM issues""")
def d01(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.transform("drift_flags", lambda x: F.substring_index(x, ":", 1))
    known = F.array(F.lit("doc_fixed_code_not_fixed"), F.lit("code_fixed_doc_not_fixed"))
    return src.issues(spark, d).select("bug_id", F.array_join(arrays.sorted_distinct(kinds), ",").alias("distinct_flags"), F.array_join(arrays.difference(F.col("drift_flags"), known), ",").alias("left_over"))


@query("d05_two_way_difference", """SELECT finding_id, array_to_string(list_filter(threat_model_ids, lambda x: NOT list_contains([1, 2, 3, 4, 5, 99], x)), ',') AS added,
array_to_string(list_filter([1, 2, 3, 4, 5, 99], lambda x: NOT list_contains(threat_model_ids, x)), ',') AS removed FROM findings""")
def d05(spark: SparkSession, d: str) -> DataFrame:
    base = F.array(*map(F.lit, (1, 2, 3, 4, 5, 99)))
    joined = lambda x: F.array_join(x.cast("array<string>"), ",")
    ids = F.col("threat_model_ids")
    return src.findings(spark, d).select("finding_id", joined(arrays.ordered_difference(ids, base)).alias("added"), joined(arrays.ordered_difference(base, ids)).alias("removed"))


@query("d08_profile_union", """SELECT id, name, built_in FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY built_in, name) AS p FROM
(SELECT n_nationkey AS id, n_name AS name, true AS built_in FROM nation UNION ALL SELECT s_suppkey, s_name, false FROM supplier)) WHERE p = 1""")
def d08(spark: SparkSession, d: str) -> DataFrame:
    built_in = src.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("built_in"))
    saved = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(False).alias("built_in"))
    return selection.latest_per(built_in.unionByName(saved), ["id"], [F.col("built_in"), F.col("name")], "name")


@query("d10_best_target", """SELECT p_brand AS kind, p_type AS command, p_retailprice AS confidence, p_partkey AS target FROM
(SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS p FROM part) WHERE p = 1""")
def d10(spark: SparkSession, d: str) -> DataFrame:
    targets = src.table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("command"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("target"))
    return selection.latest_per(targets, ["kind", "command"], [F.desc("confidence"), F.col("target")], "target")
