"""Rollups, rankings, scores and retrieval over the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import arrays, numbers, text
from quarrylens.operators import reviews, rollups, selection
from quarrylens.registry import query
from quarrylens.sources import adapters as src

TOUCHED = "coalesce(nullif(trim({0}_id), ''), CASE WHEN entity_type = '{0}' THEN entity_id END)"


@query("a01_activity_totals", f"""SELECT count(*) AS total, count(DISTINCT actor_key) AS actors, count(DISTINCT action) AS actions,
count(*) FILTER (actor_kind = 'agent') AS by_agents, count(*) FILTER (actor_kind = 'operator') AS by_operators,
count(DISTINCT {TOUCHED.format("issue")}) AS issues, count(DISTINCT {TOUCHED.format("run")}) AS runs,
strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM activity""")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return rollups.activity_totals(src.activity(spark, d)).withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


@query("a02_activity_overview", """WITH actors AS (SELECT 'actors' AS section, actor_key AS key, arg_min(actor_label, (created_at, activity_id)) AS label, count(*) AS n FROM activity GROUP BY 2 ORDER BY n DESC, key LIMIT 5),
actions AS (SELECT 'actions' AS section, action AS key, action AS label, count(*) AS n FROM activity GROUP BY 2 ORDER BY n DESC, key LIMIT 5),
entities AS (SELECT 'entities' AS section, entity_type AS key, entity_type AS label, count(*) AS n FROM activity GROUP BY 2 ORDER BY n DESC, key LIMIT 5)
SELECT * FROM actors UNION ALL SELECT * FROM actions UNION ALL SELECT * FROM entities""")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return rollups.activity_overview(src.activity(spark, d))


for _by in ("runtime", "model", "status"):

    @query(f"a03_cost_by_{_by}", f"""SELECT {_by} AS key, count(*) AS runs, coalesce(sum(input_tokens), 0) AS input_tokens, CAST(coalesce(sum(estimated_cost), 0) AS DOUBLE) AS cost,
coalesce(sum(duration_ms), 0) AS duration_ms FROM runs LEFT JOIN run_metrics USING (run_id) GROUP BY {_by}""")
    def a03(spark: SparkSession, d: str, by: str = _by) -> DataFrame:
        return rollups.cost_summary(src.runs(spark, d), src.run_metrics(spark, d), by)


@query("a04_repo_map", """SELECT regexp_extract(path, '^([^/]+)', 1) AS top, count(*) AS files, sum(size) AS bytes, count(*) FILTER (contains(path, '.html')) AS pages FROM files GROUP BY 1""")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return src.files(spark, d).groupBy(F.regexp_extract("path", "^([^/]+)", 1).alias("top")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("path").contains(".html")).alias("pages"))


@query("a05_drift_summary", "SELECT split_part(flag, ':', 1) AS bucket, count(*) AS n FROM (SELECT unnest(drift_flags) AS flag FROM issues) GROUP BY 1")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return rollups.drift_summary(src.issues(spark, d))


@query("a06_snapshot_summary", """SELECT count(*) AS issues_total, count(*) FILTER (doc_status = 'fixed' OR code_status = 'fixed') AS fixed_total,
count(*) FILTER (issue_status IN ('open', 'partial')) AS open_total, count(*) FILTER (needs_followup) AS followup_total, CAST(sum(len(drift_flags)) AS BIGINT) AS drift_total FROM issues""")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return rollups.snapshot_summary(src.issues(spark, d))


@query("a07_source_inventory", """SELECT 'issues' AS kind, source AS label, count(*) AS n FROM issues GROUP BY source UNION ALL SELECT 'signals', entity_type, count(*) FROM activity GROUP BY entity_type""")
def a07(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    return count(src.issues(spark, d), "issues", "source").unionByName(count(src.activity(spark, d), "signals", "entity_type"))


@query("a08_tree_totals", "SELECT count(*) AS files, count(DISTINCT regexp_extract(path, '^(.*)/', 1)) AS dirs, count(DISTINCT regexp_extract(path, '^([^/]+)', 1)) AS roots FROM files")
def a08(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.count_distinct(F.regexp_extract("path", p, 1))
    return src.files(spark, d).agg(F.count(F.lit(1)).alias("files"), part("^(.*)/").alias("dirs"), part("^([^/]+)").alias("roots"))


@query("a09_profile_report", """SELECT p.profile_id, count(run_id) AS total, count(*) FILTER (success) AS succeeded,
CASE WHEN count(run_id) = 0 THEN 0.0 ELSE floor(count(*) FILTER (success) * 100.0::DOUBLE / count(run_id) * 10 + 0.5) / 10 END AS success_rate,
coalesce(floor(sum(attempt_count)::DOUBLE / nullif(count(run_id), 0) * 100 + 0.5) / 100, 0.0) AS avg_attempts,
CASE WHEN count(run_id) = 0 THEN 0.0 ELSE floor(count(*) FILTER (item_passed) * 100.0::DOUBLE / count(run_id) * 10 + 0.5) / 10 END AS checklist_rate,
count(*) FILTER (success AND attempt_count <= 1 AND item_passed) AS high, count(*) FILTER (success AND NOT (attempt_count <= 1 AND item_passed)) AS medium,
count(*) FILTER (NOT success) AS low FROM (SELECT unnest(range(0, 10)) AS profile_id) p LEFT JOIN profile_history h ON p.profile_id = h.profile_id GROUP BY p.profile_id""")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return rollups.profile_report(src.profile_history(spark, d), spark.range(10).withColumnRenamed("id", "profile_id"))


@query("a10_dimension_breakdown", """SELECT runtime, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) - count(*) FILTER (success) AS failed,
floor(count(*) FILTER (success) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS success_rate, strftime(max(created_at), '%Y-%m-%d') AS newest
FROM (SELECT h.*, runtime FROM profile_history h JOIN runs r USING (run_id)) GROUP BY runtime""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    joined = src.profile_history(spark, d).join(src.runs(spark, d).select("run_id", "runtime"), "run_id")
    return rollups.breakdown(joined, "runtime").withColumn("newest", F.date_format("newest", "yyyy-MM-dd"))


@query("a11_run_breakdown", """SELECT model, count(*) AS total, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY model""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("status")
    return src.runs(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("total"), F.count_if(status == "completed").alias("succeeded"), F.count_if(status == "failed").alias("failed"))


@query("a13_scenario_report", """SELECT issue_id, count(*) AS runs, count(*) FILTER (status = 'completed') AS succeeded, CAST(coalesce(sum(estimated_cost), 0) AS DOUBLE) AS cost,
CAST(floor(sum(duration_ms) / count(duration_ms)) AS BIGINT) AS avg_duration_ms FROM runs LEFT JOIN run_metrics USING (run_id) GROUP BY issue_id""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return src.runs(spark, d).join(src.run_metrics(spark, d), "run_id", "left").groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("succeeded"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("double").alias("cost"), F.floor(F.sum("duration_ms") / F.count("duration_ms")).alias("avg_duration_ms"))


@query("a15_vulnerability_report", "SELECT severity, status, count(*) AS n FROM findings GROUP BY severity, status")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return src.findings(spark, d).groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))


@query("a16_vulnerability_rollup", """SELECT issue_id, count(*) AS total, count(*) FILTER (status NOT IN ('fixed', 'verified', 'closed')) AS open,
min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END) AS worst,
count(DISTINCT scanner) AS n_scanners, string_agg(DISTINCT scanner, ',' ORDER BY scanner) AS scanners FROM findings GROUP BY issue_id""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return rollups.vulnerability_rollup(src.findings(spark, d))


@query("a18_import_lifecycle", """SELECT CASE WHEN o.finding_id IS NULL THEN 'new' WHEN n.closed AND NOT o.closed THEN 'resolved' WHEN NOT n.closed AND o.closed THEN 'regressed' ELSE 'existing' END AS change, count(*) AS n
FROM (SELECT finding_id, status IN ('fixed', 'verified', 'closed') AS closed FROM findings) n
LEFT JOIN (SELECT finding_id + 1 AS finding_id, status IN ('fixed', 'verified', 'closed') AS closed FROM findings WHERE severity <> 'info') o ON n.finding_id = o.finding_id GROUP BY 1""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    closed = F.col("status").isin("fixed", "verified", "closed")
    now = src.findings(spark, d).select("finding_id", closed.alias("closed"))
    old = src.findings(spark, d).where("severity <> 'info'").select((F.col("finding_id") + 1).alias("finding_id"), closed.alias("was_closed"))
    change = F.when(F.col("was_closed").isNull(), "new").when(F.col("closed") & ~F.col("was_closed"), "resolved").when(~F.col("closed") & F.col("was_closed"), "regressed").otherwise("existing")
    return now.join(old, "finding_id", "left").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_consensus", """SELECT issue_id, count(*) FILTER (vote = 'yes') AS yes, count(*) FILTER (vote = 'no') AS no,
CASE WHEN count(*) FILTER (vote = 'yes') >= 2 THEN 'yes' WHEN count(*) FILTER (vote = 'no') >= 2 THEN 'no' ELSE 'unknown' END AS consensus
FROM (SELECT issue_id, CASE status WHEN 'completed' THEN 'yes' WHEN 'failed' THEN 'no' ELSE 'unknown' END AS vote FROM runs) GROUP BY issue_id""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    votes = src.runs(spark, d).select("issue_id", src.case(F.col("status"), {"completed": "yes", "failed": "no"}, "unknown").alias("vote"))
    return rollups.consensus(votes, "issue_id", "vote")


@query("a20_coverage_totals", """SELECT result_id, CAST(sum(total) AS BIGINT) AS lines_total, CAST(sum(hit) AS BIGINT) AS lines_covered, count(*) AS files_total, count(*) FILTER (hit > 0) AS files_covered,
floor(sum(hit) * 100.0::DOUBLE / sum(total) * 100 + 0.5) / 100 AS line_coverage FROM
(SELECT result_id, file, count(*) AS total, count(*) FILTER (hits > 0) AS hit FROM coverage_lines GROUP BY ALL) GROUP BY result_id""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return rollups.coverage_totals(src.coverage_lines(spark, d))


@query("a21_coverage_delta", """WITH days AS (SELECT result_id, created_at, count(*) FILTER (hits > 0) AS covered, count(*) AS total FROM coverage_lines GROUP BY ALL)
SELECT result_id, arg_min(covered, created_at) AS first_covered, arg_max(covered, created_at) AS last_covered,
greatest(0, arg_max(covered, created_at) - arg_min(covered, created_at)) AS lines_added, greatest(0, arg_min(covered, created_at) - arg_max(covered, created_at)) AS lines_lost FROM days GROUP BY result_id""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    days = src.coverage_lines(spark, d).groupBy("result_id", "created_at").agg(F.count_if(F.col("hits") > 0).alias("covered"))
    ends = days.groupBy("result_id").agg(F.min_by("covered", "created_at").alias("first_covered"), F.max_by("covered", "created_at").alias("last_covered"))
    change = F.col("last_covered") - F.col("first_covered")
    return ends.withColumns({"lines_added": F.greatest(F.lit(0), change), "lines_lost": F.greatest(F.lit(0), -change)})


@query("a22_symbol_summary", "SELECT p_brand AS path, p_type AS kind, count(*) AS n, min(p_name) AS first_symbol FROM part GROUP BY p_brand, p_type")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "part").groupBy(F.col("p_brand").alias("path"), F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_symbol"))


@query("a23_output_summary", """SELECT run_id, count(*) AS events, count(*) FILTER (type = 'assistant') AS tool_events, arg_min(type, pos) AS first_type, arg_max(type, pos) AS last_type,
CAST(length(string_agg(text, chr(10) ORDER BY pos)) AS INTEGER) AS text_chars FROM output_lines GROUP BY run_id""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return rollups.output_summary(src.output_lines(spark, d))


@query("a28_next_id", "SELECT 'TRK_' || lpad(CAST(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS VARCHAR), 6, '0') AS next_id FROM customer")
def a28(spark: SparkSession, d: str) -> DataFrame:
    number = F.max(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long")) + 1
    return src.table(spark, d, "customer").agg(F.concat(F.lit("TRK_"), F.lpad(number.cast("string"), 6, "0")).alias("next_id"))


@query("w02_baseline", """SELECT issue_id, arg_min(run_id, (CASE WHEN runtime = 'BUILDING' THEN 0 ELSE 1 END, created_at, run_id)) AS baseline FROM runs GROUP BY issue_id""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(F.when(F.col("runtime") == "BUILDING", 0).otherwise(1), "created_at", "run_id")
    return src.runs(spark, d).groupBy("issue_id").agg(F.min_by("run_id", order).alias("baseline"))


@query("w04_pairwise_ranks", """WITH v AS (SELECT issue_id, model AS variant, max(CASE status WHEN 'completed' THEN 4 WHEN 'running' THEN 3 ELSE 0 END) AS status_rank,
CAST(sum(estimated_cost) AS DOUBLE) AS cost FROM runs JOIN run_metrics USING (run_id) GROUP BY ALL),
p AS (SELECT a.issue_id, a.variant, a.status_rank, a.cost, count(*) FILTER (a.status_rank > b.status_rank OR (a.status_rank = b.status_rank AND a.cost < b.cost)) AS wins,
count(*) FILTER (a.status_rank < b.status_rank OR (a.status_rank = b.status_rank AND a.cost > b.cost)) AS losses
FROM v a JOIN v b ON a.issue_id = b.issue_id AND a.variant <> b.variant GROUP BY ALL)
SELECT issue_id, variant, wins, losses, row_number() OVER (PARTITION BY issue_id ORDER BY wins DESC, losses, status_rank DESC, cost, variant) AS place FROM p""")
def w04(spark: SparkSession, d: str) -> DataFrame:
    joined = src.runs(spark, d).join(src.run_metrics(spark, d), "run_id")
    rank = src.case(F.col("status"), {"completed": 4, "running": 3}, 0)
    variants = joined.groupBy("issue_id", F.col("model").alias("variant")).agg(F.max(rank).alias("status_rank"), F.sum("estimated_cost").cast("double").alias("cost"))
    return rollups.pairwise_ranks(variants).select("issue_id", "variant", "wins", "losses", "place")


@query("w06_rank_movement", """WITH q AS (SELECT issue_id, year(created_at) AS batch, model, count(*) AS n FROM runs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY issue_id, batch ORDER BY n DESC, model) AS place FROM q)
SELECT issue_id, model, batch, place, before, CASE WHEN before IS NULL THEN 'new' WHEN place < before THEN 'up' WHEN place > before THEN 'down' ELSE 'same' END AS movement
FROM (SELECT *, lag(place) OVER (PARTITION BY issue_id, model ORDER BY batch) AS before FROM r)""")
def w06(spark: SparkSession, d: str) -> DataFrame:
    counted = src.runs(spark, d).groupBy("issue_id", F.year("created_at").cast("long").alias("batch"), "model").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("issue_id", "batch").orderBy(F.desc("n"), "model")))
    moved = placed.withColumn("before", F.lag("place").over(Window.partitionBy("issue_id", "model").orderBy("batch")))
    movement = F.when(F.col("before").isNull(), "new").when(F.col("place") < F.col("before"), "up").when(F.col("place") > F.col("before"), "down").otherwise("same")
    return moved.select("issue_id", "model", "batch", "place", "before", movement.alias("movement"))


@query("w09_block_assignment", """SELECT run_id, pos, last_value(CASE WHEN type = 'user' THEN pos END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM output_lines""")
def w09(spark: SparkSession, d: str) -> DataFrame:
    carried = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return src.output_lines(spark, d).select("run_id", "pos", F.last(F.when(F.col("type") == "user", F.col("pos")), ignorenulls=True).over(carried).alias("block"))


@query("m01_rounding", """SELECT o_orderkey, floor(o_totalprice * 10 + 0.5) / 10 AS rounded, CAST(trunc(-o_totalprice * 10 + 0.5) AS BIGINT)::DOUBLE / 10 AS cut FROM orders""")
def m01(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return src.table(spark, d, "orders").select("o_orderkey", numbers.rounded(price, 1).alias("rounded"), numbers.truncated_round(-price, 1).alias("cut"))


@query("m05_token_estimate", "SELECT conv_id, turn, greatest(1, strlen(text) // 4) AS tokens FROM conversations")
def m05(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "conversations").select("conv_id", "turn", numbers.token_estimate(F.col("text")).alias("tokens"))


@query("m06_cost_model", """SELECT run_id, floor((input_tokens * CASE model WHEN '1-URGENT' THEN 0.015::DOUBLE WHEN '2-HIGH' THEN 0.003::DOUBLE WHEN '3-MEDIUM' THEN 0.0005::DOUBLE ELSE 0.01::DOUBLE END / 1000
+ output_tokens * CASE model WHEN '1-URGENT' THEN 0.075::DOUBLE WHEN '2-HIGH' THEN 0.015::DOUBLE WHEN '3-MEDIUM' THEN 0.0015::DOUBLE ELSE 0.03::DOUBLE END / 1000) * 1000000 + 0.5) / 1000000 AS cost
FROM runs JOIN run_metrics USING (run_id)""")
def m06(spark: SparkSession, d: str) -> DataFrame:
    joined = src.runs(spark, d).join(src.run_metrics(spark, d), "run_id")
    return joined.select("run_id", numbers.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("cost"))


@query("u05_language", """SELECT path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS extension, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript'
WHEN 'jsx' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'sh' THEN 'bash' WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'json' THEN 'json' END AS language
FROM (SELECT path FROM tree_files UNION ALL SELECT 'x' || p_partkey || ['.JS', '.jsx', '.java', '.css', '.yml', '.HTML', '.rb', ''][CAST(p_size % 8 AS INT) + 1] FROM part)""")
def u05(spark: SparkSession, d: str) -> DataFrame:
    endings = F.array(*map(F.lit, (".JS", ".jsx", ".java", ".css", ".yml", ".HTML", ".rb", "")))
    more = src.table(spark, d, "part").select(F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.element_at(endings, (F.col("p_size") % 8).cast("int") + 1)).alias("path"))
    return src.tree_files(spark, d).select("path").unionByName(more).select("path", text.extension(F.col("path")).alias("extension"), text.language(F.col("path")).alias("language"))


@query("u07_plain_path", "SELECT bug_id, ltrim(evidence_path, './') AS path FROM issues")
def u07(spark: SparkSession, d: str) -> DataFrame:
    return src.issues(spark, d).select("bug_id", text.plain_path(F.col("evidence_path")).alias("path"))


@query("u10_fix_status", """SELECT bug_id, CASE WHEN contains(lower(summary), 'already fixed') OR starts_with(lower(trim(summary)), 'fixed') THEN 'fixed'
WHEN contains(lower(summary), 'partial') THEN 'partial' WHEN contains(lower(summary), 'resolved') THEN 'resolved' ELSE 'open' END AS status FROM issues""")
def u10(spark: SparkSession, d: str) -> DataFrame:
    return src.issues(spark, d).select("bug_id", text.fix_status(F.col("summary")).alias("status"))


@query("u13_stable_id", "SELECT bug_id, 'iss_' || left(sha1(concat_ws('|', lower(trim(CAST(bug_id AS VARCHAR))), lower(trim(source)), lower(trim(severity)))), 12) AS stable_id FROM issues")
def u13(spark: SparkSession, d: str) -> DataFrame:
    return src.issues(spark, d).select("bug_id", text.stable_id("iss_", F.col("bug_id"), F.col("source"), F.col("severity")).alias("stable_id"))


@query("u14_content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def u14(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@query("u20_query_tokens", """SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{3,})', 1)),
lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this'))), ' ') AS tokens FROM benchmark""")
def u20(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(text.query_tokens(F.col("text"))), " ").alias("tokens"))


@query("u28_target_kind", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'test') THEN 'test' WHEN contains(lower(p_name), 'lint') THEN 'lint' WHEN contains(lower(p_name), 'build') THEN 'build'
WHEN contains(lower(p_name), 'dev') OR contains(lower(p_name), 'serve') THEN 'dev' WHEN contains(lower(p_name), 'check') OR contains(lower(p_name), 'verify') THEN 'verify' ELSE 'other' END AS kind FROM part""")
def u28(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "part").select("p_partkey", text.target_kind(F.col("p_name")).alias("kind"))


@query("u30_severity", """SELECT p_partkey, CASE CAST(p_size AS VARCHAR) WHEN '4' THEN 'critical' WHEN '3' THEN 'high' WHEN '2' THEN 'medium' WHEN '1' THEN 'low' ELSE 'info' END AS severity FROM part""")
def u30(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "part").select("p_partkey", text.severity(F.col("p_size").cast("string")).alias("severity"))


@query("u35_truncation", "SELECT bug_id, CASE WHEN length(title) > 60 THEN left(title, 60) || '... [' || (length(title) - 60) || ' more]' ELSE title END AS title FROM issues")
def u35(spark: SparkSession, d: str) -> DataFrame:
    return src.issues(spark, d).select("bug_id", text.truncated(F.col("title"), 60).alias("title"))


@query("c08_tree_focus", """SELECT source, string_agg(DISTINCT ltrim(evidence_path, './'), ',' ORDER BY ltrim(evidence_path, './')) AS focus FROM issues GROUP BY source""")
def c08(spark: SparkSession, d: str) -> DataFrame:
    paths = F.collect_set(text.plain_path(F.col("evidence_path")))
    return src.issues(spark, d).groupBy("source").agg(F.array_join(F.array_sort(paths), ",").alias("focus"))


@query("q01_quality_score", """WITH s AS (SELECT bug_id, 0.2::DOUBLE * (severity <> '')::INT + 0.25::DOUBLE * (length(summary) > 20)::INT + 0.25::DOUBLE * (len(labels) > 0)::INT + 0.15::DOUBLE * (len(drift_flags) > 0)::INT + 0.15::DOUBLE * (summary <> '')::INT AS completeness,
CASE WHEN length(title) >= 10 THEN 0.3::DOUBLE WHEN length(title) >= 5 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN length(summary) >= 50 THEN 0.4::DOUBLE WHEN length(summary) >= 20 THEN 0.2::DOUBLE ELSE 0 END
+ 0.15::DOUBLE * (title <> lower(title) AND title <> upper(title))::INT + 0.15::DOUBLE * (len(labels) > 0)::INT AS clarity, least(0.4::DOUBLE, 0.1::DOUBLE * len(drift_flags)) + 0.3::DOUBLE AS evidence FROM issues)
SELECT bug_id, floor((completeness * 0.4::DOUBLE + clarity * 0.35::DOUBLE + evidence * 0.25::DOUBLE) * 100 * 10 + 0.5) / 10 AS score FROM s""")
def q01(spark: SparkSession, d: str) -> DataFrame:
    def given(weight: float, condition) -> F.Column:
        return F.lit(weight) * condition.cast("int")

    title, summary, labels, flags = F.col("title"), F.col("summary"), F.size("labels") > 0, F.size("drift_flags")
    complete = given(0.2, F.col("severity") != "") + given(0.25, F.length(summary) > 20) + given(0.25, labels) + given(0.15, flags > 0) + given(0.15, summary != "")
    clear = (
        F.when(F.length(title) >= 10, 0.3).when(F.length(title) >= 5, 0.15).otherwise(0.0) + F.when(F.length(summary) >= 50, 0.4).when(F.length(summary) >= 20, 0.2).otherwise(0.0)
        + given(0.15, (title != F.lower(title)) & (title != F.upper(title))) + given(0.15, labels)
    )
    evidence = F.least(F.lit(0.4), F.lit(0.1) * flags) + F.lit(0.3)
    return src.issues(spark, d).select("bug_id", numbers.rounded((complete * 0.4 + clear * 0.35 + evidence * 0.25) * 100, 1).alias("score"))


@query("q08_safety", r"""SELECT conv_id, turn, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.4::DOUBLE * regexp_matches(low, 'rm -rf|del /s|format c:|drop table|delete from')::INT - 0.2::DOUBLE * regexp_matches(low, 'os\.system|subprocess\.call|exec\(|eval\(')::INT
- 0.3::DOUBLE * contains(low, 'panic')::INT) AS safety FROM (SELECT conv_id, turn, lower(CASE turn WHEN 1 THEN 'rm -RF / ' || text WHEN 2 THEN text || ' exec(x) panic' WHEN 3 THEN 'segfault' ELSE text END) AS low FROM conversations)""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") == 1, F.concat(F.lit("rm -RF / "), "text")).when(F.col("turn") == 2, F.concat("text", F.lit(" exec(x) panic"))).when(F.col("turn") == 3, "segfault").otherwise(F.col("text"))
    return src.table(spark, d, "conversations").select("conv_id", "turn", reviews.safety(said).alias("safety"))


@query("q19_path_score", """SELECT file_id, 2 * len(list_filter(['the', 'ther', 'html', 'example', 'blog'], lambda t: contains(lower(path), t))) + contains(lower(path), 'page')::INT AS score FROM files""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "ther", "html", "example", "blog")))
    path = F.col("path")
    return src.files(spark, d).select("file_id", (F.size(text.matched(terms, path)) * 2 + F.lower(path).contains("page").cast("int")).cast("long").alias("score"))


@query("m09_title_jaccard", r"""WITH w AS (SELECT bug_id, source, list_distinct(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(evidence_path || ' ' || title), '\s+'), lambda x: x <> '')) AS b FROM issues)
SELECT bug_id, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS similarity FROM w""")
def m09(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    return src.issues(spark, d).select("bug_id", arrays.jaccard(words(F.col("title")), words(F.concat_ws(" ", "evidence_path", "title"))).alias("similarity"))


@query("x01_activity_per_minute", "SELECT strftime(time_bucket(INTERVAL '10 minutes', created_at), '%Y-%m-%d %H:%M') AS opened, action, count(*) AS n FROM activity GROUP BY ALL")
def x01(spark: SparkSession, d: str) -> DataFrame:
    counted = src.activity(spark, d).groupBy(F.window("created_at", "10 minutes").alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("opened"), "action", "n")
