"""The engine's entities as projections of the star-schema tables.

Each view exists twice, as a DataFrame function and as the SQL of ``registry.VIEWS``,
so operators and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.registry import VIEWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(value: Column, cases: dict, otherwise=None) -> Column:
    """CASE value WHEN ... END."""
    out = None
    for k, v in cases.items():
        out = F.when(value == F.lit(k), F.lit(v)) if out is None else out.when(value == F.lit(k), F.lit(v))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kind = case(F.col("event_type"), {"view": "issue", "click": "run", "error": "signal", "purchase": "fix"}, "workspace")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("activity_id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor_key"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" / "), F.col("event_type")).alias("actor_label"),
        F.when(F.col("user_id") % 3 == 0, "agent").otherwise("operator").alias("actor_kind"),
        F.col("event_type").alias("action"),
        kind.alias("entity_type"),
        k.alias("entity_id"),
        F.when(F.col("event_type").isin("click", "error"), k).alias("issue_id"),
        F.when(F.col("event_type") == "purchase", k).alias("run_id"),
        F.concat_ws(" ", "event_type", F.lit("on"), k).alias("summary"),
    )


VIEWS["activity"] = """
SELECT event_id AS activity_id, ts AS created_at, 'user:' || user_id AS actor_key, 'User ' || user_id || ' / ' || event_type AS actor_label,
  CASE WHEN user_id % 3 = 0 THEN 'agent' ELSE 'operator' END AS actor_kind, event_type AS action,
  CASE event_type WHEN 'view' THEN 'issue' WHEN 'click' THEN 'run' WHEN 'error' THEN 'signal' WHEN 'purchase' THEN 'fix' ELSE 'workspace' END AS entity_type,
  json_extract_string(props, '$.k') AS entity_id,
  CASE WHEN event_type IN ('click', 'error') THEN json_extract_string(props, '$.k') END AS issue_id,
  CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k') END AS run_id,
  concat_ws(' ', event_type, 'on', json_extract_string(props, '$.k')) AS summary
FROM events"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("issue_id"),
        case(F.col("o_orderstatus"), {"F": "completed", "O": "running"}, "failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("c_mktsegment").alias("runtime"),
        F.col("o_orderpriority").alias("model"),
    )


VIEWS["runs"] = """
SELECT o_orderkey AS run_id, o_custkey AS issue_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderdate AS created_at, c_mktsegment AS runtime, o_orderpriority AS model
FROM orders JOIN customer ON o_custkey = c_custkey"""


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(5,2)"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("input_tokens"),
        (F.count(F.lit(1)) * 100).alias("output_tokens"),
        F.sum(cost).cast("decimal(18,4)").alias("estimated_cost"),
        (F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("long") * 1000).alias("duration_ms"),
        F.max("l_shipdate").alias("calculated_at"),
    )


VIEWS["run_metrics"] = """
SELECT l_orderkey AS run_id, sum(CAST(l_quantity AS BIGINT)) AS input_tokens, count(*) * 100 AS output_tokens,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(5,2)))) AS DECIMAL(18,4)) AS estimated_cost,
  date_diff('day', min(l_shipdate), max(l_shipdate)) * 1000 AS duration_ms, max(l_shipdate) AS calculated_at
FROM lineitem GROUP BY l_orderkey"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc = case(F.col("doc_id") % 3, {0: "open", 1: "fixed"}, "partial")
    code = case(F.col("doc_id") % 4, {0: "fixed", 1: "open", 2: "unknown"}, "fixed")
    n = F.col("n_chars")
    flags = F.array_compact(F.array(
        F.when((doc == "fixed") & (code != "fixed"), "doc_fixed_code_not_fixed"),
        F.when((code == "fixed") & (doc != "fixed"), "code_fixed_doc_not_fixed"),
        F.when(F.col("quality").isNull(), F.concat(F.lit("missing_evidence:"), F.col("source"))),
    ))
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "Good"), F.when(F.col("quality") == 0, "Poor"), F.when(F.col("toxic") == 1, "Toxic")))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("bug_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("summary"),
        F.when(n >= 8000, "P0").when(n >= 3000, "P1").when(n >= 1000, "P2").otherwise("P3").alias("severity"),
        "source",
        case(F.col("doc_id") % 6, {1: "partial", 2: "triaged", 3: "verification", 4: "resolved"}, "open").alias("issue_status"),
        doc.alias("doc_status"),
        code.alias("code_status"),
        flags.alias("drift_flags"),
        tags.alias("labels"),
        (F.size(flags) > 0).alias("needs_followup"),
        F.concat(F.lit("./src/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py")).alias("evidence_path"),
    )


VIEWS["issues"] = """
SELECT doc_id AS bug_id, string_split(text, chr(10))[1] AS title, text AS summary,
  CASE WHEN n_chars >= 8000 THEN 'P0' WHEN n_chars >= 3000 THEN 'P1' WHEN n_chars >= 1000 THEN 'P2' ELSE 'P3' END AS severity, source,
  CASE doc_id % 6 WHEN 1 THEN 'partial' WHEN 2 THEN 'triaged' WHEN 3 THEN 'verification' WHEN 4 THEN 'resolved' ELSE 'open' END AS issue_status,
  doc_status, code_status,
  list_filter([CASE WHEN doc_status = 'fixed' AND code_status <> 'fixed' THEN 'doc_fixed_code_not_fixed' END,
    CASE WHEN code_status = 'fixed' AND doc_status <> 'fixed' THEN 'code_fixed_doc_not_fixed' END,
    CASE WHEN quality IS NULL THEN 'missing_evidence:' || source END], lambda x: x IS NOT NULL) AS drift_flags,
  list_filter([CASE WHEN quality = 1 THEN 'Good' END, CASE WHEN quality = 0 THEN 'Poor' END, CASE WHEN toxic = 1 THEN 'Toxic' END], lambda x: x IS NOT NULL) AS labels,
  (doc_status = 'fixed' AND code_status <> 'fixed') OR (code_status = 'fixed' AND doc_status <> 'fixed') OR quality IS NULL AS needs_followup,
  './src/' || source || '/' || lang || '.py' AS evidence_path
FROM (SELECT d.*, quality, toxic, CASE d.doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' ELSE 'partial' END AS doc_status,
  CASE d.doc_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'open' WHEN 2 THEN 'unknown' ELSE 'fixed' END AS code_status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.col("role").alias("type"), "text")


VIEWS["output_lines"] = "SELECT conv_id AS run_id, turn AS pos, role AS type, text FROM conversations"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://([^?#]+)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), path.alias("path"), F.length("html").cast("long").alias("size"), F.col("html").alias("content"))


VIEWS["files"] = "SELECT page_id AS file_id, regexp_extract(url, '^https?://([^?#]+)', 1) AS path, length(html) AS size, html AS content FROM pages"


def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = case(F.col("l_returnflag"), {"R": 0, "A": 1}, 2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("result_id"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), hits.alias("hits"), F.col("l_shipdate").alias("created_at"))


VIEWS["coverage_lines"] = """
SELECT l_suppkey AS result_id, l_partkey AS file, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS hits, l_shipdate AS created_at
FROM lineitem"""


def profile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("profile_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_linestatus") == "O").alias("success"),
        (F.col("l_linenumber") % 3 + 1).alias("attempt_count"), F.col("l_shipdate").alias("created_at"), (F.col("l_quantity") > 25).alias("item_passed"),
    )


VIEWS["profile_history"] = """
SELECT l_linenumber AS profile_id, l_orderkey AS run_id, l_linestatus = 'O' AS success, l_linenumber % 3 + 1 AS attempt_count, l_shipdate AS created_at,
  l_quantity > 25 AS item_passed FROM lineitem"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("finding_id"), size.alias("issue_id"), F.col("p_brand").alias("scanner"), F.col("p_name").alias("title"),
        F.when(size >= 45, "critical").when(size >= 35, "high").when(size >= 20, "medium").when(size >= 8, "low").otherwise("info").alias("severity"),
        case(F.col("p_partkey") % 6, {0: "open", 1: "triaged", 2: "fixing", 3: "fixed", 4: "verified"}, "closed").alias("status"),
        F.array((size % 25).cast("int"), ((size + 7) % 25).cast("int"), F.lit(99)).alias("threat_model_ids"),
    )


VIEWS["findings"] = """
SELECT p_partkey AS finding_id, p_size AS issue_id, p_brand AS scanner, p_name AS title,
  CASE WHEN p_size >= 45 THEN 'critical' WHEN p_size >= 35 THEN 'high' WHEN p_size >= 20 THEN 'medium' WHEN p_size >= 8 THEN 'low' ELSE 'info' END AS severity,
  CASE p_partkey % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'triaged' WHEN 2 THEN 'fixing' WHEN 3 THEN 'fixed' WHEN 4 THEN 'verified' ELSE 'closed' END AS status,
  [CAST(p_size % 25 AS INTEGER), CAST((p_size + 7) % 25 AS INTEGER), 99] AS threat_model_ids
FROM part"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted fixes: the cheaper completed runs' own record."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice < 200000").select(
        F.concat(F.lit("fix_"), F.col("o_orderkey").cast("string")).alias("fix_id"), F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("issue_id"), F.col("o_orderdate").alias("recorded_at"))


VIEWS["fixes"] = """
SELECT 'fix_' || o_orderkey AS fix_id, o_orderkey AS run_id, o_custkey AS issue_id, o_orderdate AS recorded_at FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice < 200000"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("run_id"), F.lit("dismissed").alias("disposition"))


VIEWS["reviews"] = "SELECT o_orderkey AS run_id, 'dismissed' AS disposition FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000"


#: A source tree over the pages: each path holds its file's number at the mark.
TREE = (
    "backend/m{}/cli.py", "src/app{}/main.ts", "README{}.md", "frontend/src/v{}/App.tsx", "tests/test_{}.py", "api/server{}/handler.go",
    "m{}/package.json", "docs/guide{}.md", "web/ui{}/page.spec.ts", "scripts/run_agent{}.sh", "lib/p{}.rs", "cmd/t{}/config.yaml",
)


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, content): pages as source files whose first lines define something."""
    id_, n = F.col("file_id").cast("string"), (F.col("file_id") % 40).cast("string")
    path = None
    for k, one in enumerate(TREE):
        before, after = one.split("{}")
        made = F.concat(F.lit(before), id_, F.lit(after))
        path = F.when(F.col("file_id") % len(TREE) == k, made) if path is None else path.when(F.col("file_id") % len(TREE) == k, made)
    head = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("import os\ndef run_"), n, F.lit("(x):\n  return x\nclass Page"), n, F.lit(":\n"))).when(F.col("file_id") % 3 == 1, F.concat(F.lit("export class View"), n, F.lit(" {\n"))).otherwise("")
    return files(spark, sf_dir).select("file_id", path.alias("path"), F.concat(head, "content").alias("content"))


VIEWS["tree_files"] = f"""
SELECT file_id, CASE file_id % {len(TREE)} {" ".join(f"WHEN {k} THEN '{one.replace('{}', "' || file_id || '")}'" for k, one in enumerate(TREE))} END AS path,
  CASE file_id % 3 WHEN 0 THEN 'import os' || chr(10) || 'def run_' || (file_id % 40) || '(x):' || chr(10) || '  return x' || chr(10) || 'class Page' || (file_id % 40) || ':' || chr(10)
    WHEN 1 THEN 'export class View' || (file_id % 40) || ' {{' || chr(10) ELSE '' END || content AS content
FROM files"""


def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, status, scope): every 25th file of the tree has changed."""
    id_ = F.col("file_id")
    status = F.when(id_ % 100 == 3, "deleted").when(id_ % 100 == 28, "added").otherwise("modified")
    return tree_files(spark, sf_dir).where(id_ % 25 == 3).select("path", status.alias("status"), F.when(id_ % 2 == 0, "staged").otherwise("working_tree").alias("scope"))


VIEWS["tree_changes"] = """
SELECT path, CASE file_id % 100 WHEN 3 THEN 'deleted' WHEN 28 THEN 'added' ELSE 'modified' END AS status, CASE WHEN file_id % 2 = 0 THEN 'staged' ELSE 'working_tree' END AS scope
FROM tree_files WHERE file_id % 25 = 3"""
