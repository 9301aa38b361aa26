"""Trees, stored collections, reports and appends, each through the engine's own reader.

Queries over files write a table's rows to a folder that driver and executors share, in
the form in which they are stored, and read them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import paths
from quarrylens.plans.semantic import ROLE, SCANNED, texts, tree
from quarrylens.registry import query
from quarrylens.sources import adapters as src
from quarrylens.sources import artifacts, coverage, git, sinks, trees
from quarrylens.sources.shared import folder
from quarrylens.streaming import activity as stream


@query("s01_repo_map", f"SELECT path, {ROLE} AS role, length(content) AS size FROM tree_files WHERE {ROLE} IS NOT NULL")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return trees.repo_map(tree(spark, d).select("path", F.length("content").cast("long").alias("size")))


@query("s04_line_scan", f"SELECT path, line_no, line FROM (SELECT path, unnest(string_split_regex(content, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line_no FROM tree_files WHERE {SCANNED}) WHERE regexp_matches(line, 'class (Page|View)')")
def s04(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned files that a pattern fits."""
    return trees.lines(texts(spark, d).where(paths.is_scanned(F.col("path")))).where(F.col("line").rlike("class (Page|View)"))


@query("s16_coverage_dispatch", """SELECT CASE result_id % 5 WHEN 0 THEN 'cobertura' WHEN 1 THEN 'istanbul' WHEN 2 THEN 'unknown' ELSE 'lcov' END AS format, count(*) AS reports, sum(CASE WHEN result_id % 5 = 2 THEN 0 ELSE n END) AS lines_total, sum(CASE WHEN result_id % 5 = 2 THEN 0 ELSE hit END) AS lines_covered
FROM (SELECT result_id, count(*) AS n, count(*) FILTER (hits > 0) AS hit FROM (SELECT result_id, line, max(hits) AS hits FROM coverage_lines GROUP BY ALL) GROUP BY result_id) GROUP BY 1""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """One report for each result, in the format that its ending names."""
    lines = src.coverage_lines(spark, d).groupBy("result_id", "line").agg(F.max("hits").alias("hits"))
    listed = lambda c, between: F.array_join(F.array_sort(F.collect_list(c)), between)
    line, hits = F.col("line").cast("string"), F.col("hits").cast("string")
    body = lines.groupBy("result_id").agg(
        listed(F.concat(F.lit('<line number="'), line, F.lit('" hits="'), hits, F.lit('"/>')), "").alias("xml"),
        listed(F.concat(F.lit('"'), line, F.lit('":'), hits), ",").alias("json"), listed(F.concat(F.lit("DA:"), line, F.lit(","), hits), "\n").alias("info"))
    kind = F.col("result_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit('<coverage line-rate="1"><packages><package><classes><class filename="a"><lines>'), "xml", F.lit("</lines></class></classes></package></packages></coverage>")))
        .when(kind == 1, F.concat(F.lit('{"coverage":{"a":{"s":{'), "json", F.lit("}}}}"))).otherwise(F.concat(F.lit("SF:a\n"), "info", F.lit("\nend_of_record")))
    )
    path = F.concat(F.lit("r"), F.col("result_id").cast("string"), src.case(kind, {0: ".xml", 1: ".json", 2: ".bin", 3: ".info"}, ""))
    found = coverage.results(body.select(path.alias("path"), text.alias("text")))
    return found.groupBy("format").agg(F.count(F.lit(1)).alias("reports"), F.sum("lines_total").alias("lines_total"), F.sum("lines_covered").alias("lines_covered"))


#: Guidance places: path or folder, kind, always on, priority.
GUIDANCE = [("README0.md", "readme", True, 3), ("docs/", "doc", False, 2), ("README2.md", "agent_instructions", True, 1), ("m6/", "index", False, 4)]


@query("s23_guidance", """SELECT path, kind, always_on, priority FROM (SELECT path, CASE WHEN path = 'README2.md' THEN 'agent_instructions' WHEN starts_with(path, 'docs/') THEN 'doc' ELSE 'index' END AS kind, path = 'README2.md' AS always_on,
CASE WHEN path = 'README2.md' THEN 1 WHEN starts_with(path, 'docs/') THEN 2 ELSE 4 END AS priority FROM tree_files WHERE path = 'README2.md' OR starts_with(path, 'docs/') AND ends_with(path, '.md') OR starts_with(path, 'm6/') AND ends_with(path, '.json')) ORDER BY priority, lower(path), path LIMIT 6""")
def s23(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame(GUIDANCE, "path string, kind string, always_on boolean, priority int")
    return trees.guidance(tree(spark, d).select("path"), known)


_places = [(path, kind, on, k) for path, kind, on, k in trees.GUIDANCE]
_fixed = [x[0] for x in _places if not x[0].endswith("/")]
_walked = [x[0] for x in _places if x[0].endswith("/")]
_endings = (".md", ".mdc", ".JSON", ".txt")
_given = f"CASE WHEN file_id < {len(_fixed)} THEN {_fixed}[file_id + 1] ELSE {_walked}[file_id % {len(_walked)} + 1] || 'a/' || file_id || {list(_endings)}[file_id // 4 % {len(_endings)} + 1] END"


@query("s23_guidance_places", f"""SELECT path, kind, always_on, priority FROM (SELECT t.path, k.kind, k.always_on, k.priority, row_number() OVER (PARTITION BY lower(t.path) ORDER BY k.priority, t.path) AS place FROM (SELECT {_given} AS path FROM tree_files) t
JOIN (VALUES {", ".join(f"('{p}', '{k}', {str(on).lower()}, {n})" for p, k, on, n in _places)}) AS k(path, kind, always_on, priority) ON t.path = k.path OR ends_with(k.path, '/') AND starts_with(t.path, k.path) AND regexp_matches(lower(t.path), '\\.(md|mdc|json)$'))
WHERE place = 1 ORDER BY priority, lower(path), path LIMIT 40""")
def s23_places(spark: SparkSession, d: str) -> DataFrame:
    """Files at the fixed places and below the walked folders."""
    id_ = F.col("file_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    below = F.concat(pick(_walked, id_ % len(_walked)), F.lit("a/"), id_.cast("string"), pick(_endings, F.floor(id_ / 4) % len(_endings)))
    path = F.when(id_ < len(_fixed), F.try_element_at(F.array(*map(F.lit, _fixed)), (id_ + 1).cast("int"))).otherwise(below)
    return trees.guidance(tree(spark, d).select(path.alias("path")), trees.guidance_places(spark), 40)


def project(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): manifests of packages, make files and compose files, one for each part."""
    id_, size = F.col("p_partkey").cast("string"), F.col("p_size")
    path = F.when(size % 4 == 0, F.concat(F.lit("a"), id_, F.lit("/Makefile"))).when(size % 4 == 1, F.concat(F.lit("a"), id_, F.lit("/b/package.json"))).when(size % 4 == 2, F.concat(F.lit("c"), id_, F.lit("/docker-compose.yml"))).otherwise(F.concat(F.lit("x/y/z"), id_, F.lit("/package.json")))
    text = F.when(size % 4 == 0, F.concat(F.lit("test"), id_, F.lit(": dep\n\trun\nX := 1\n.PHONY: a\nbuild:\n"))).when(size % 4 == 2, "services:\n").otherwise(F.concat(F.lit('{"scripts": {"lint'), id_, F.lit('": "x"}}')))
    return src.table(spark, d, "part").select(path.alias("path"), text.alias("text"))


@query("s25_targets", """SELECT 'test' AS kind, 'make test' || p_partkey AS command, 'test' || p_partkey AS label, 'a' || p_partkey || '/Makefile' AS source_path, 80 AS confidence FROM part WHERE p_size % 4 = 0
UNION ALL SELECT 'build', 'make build', 'build', max('a' || p_partkey || '/Makefile'), 80 FROM part WHERE p_size % 4 = 0 HAVING count(*) > 0
UNION ALL SELECT 'lint', 'npm run lint' || p_partkey, 'lint' || p_partkey, CASE WHEN p_size % 4 = 1 THEN 'a' || p_partkey || '/b/package.json' ELSE 'x/y/z' || p_partkey || '/package.json' END, 85 FROM part WHERE p_size % 4 IN (1, 3)
UNION ALL SELECT 'other', 'docker compose -f c' || p_partkey || '/docker-compose.yml up', 'compose', 'c' || p_partkey || '/docker-compose.yml', 75 FROM part WHERE p_size % 4 = 2""")
def s25(spark: SparkSession, d: str) -> DataFrame:
    return trees.targets(project(spark, d))


@query("s26_manifests", "SELECT 'a' || p_partkey || '/b/package.json' AS path FROM part WHERE p_size % 4 = 1")
def s26(spark: SparkSession, d: str) -> DataFrame:
    return trees.manifests(project(spark, d))


@query("s27_structural_matches", "SELECT 'src/' || p_brand AS path, p_size + 1 AS line_start, p_size + 3 AS line_end, p_name AS matched_text FROM part WHERE p_size % 5 > 0")
def s27(spark: SparkSession, d: str) -> DataFrame:
    place = lambda n: F.struct((F.col("p_size") + n).cast("int").alias("line"), F.lit(0).alias("column"))
    match = F.struct(F.concat(F.lit("src/"), "p_brand").alias("file"), F.col("p_name").alias("text"), F.lit("python").alias("language"), F.struct(place(0).alias("start"), place(2).alias("end")).alias("range"))
    line = F.when(F.col("p_size") % 5 > 0, F.to_json(match)).otherwise("not JSON")
    return artifacts.structural_matches(src.table(spark, d, "part").select(line.alias("line"))).select("path", "line_start", "line_end", "matched_text")


@query("s28_symbols", "SELECT path, symbol, kind, line AS line_start FROM tree_symbols")
def s28(spark: SparkSession, d: str) -> DataFrame:
    return trees.symbols(texts(spark, d)).select("path", "symbol", "kind", "line_start")


@query("s32_change_summary", """SELECT scope, status, count(*) AS n, min(path) AS first FROM (SELECT 'src/' || p_partkey AS path, CASE p_size % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' ELSE 'deleted' END AS status, 'since_ref' AS scope FROM part
UNION ALL SELECT 'src/' || p_partkey, 'untracked', 'working_tree' FROM part WHERE p_size % 2 = 0) GROUP BY ALL""")
def s32(spark: SparkSession, d: str) -> DataFrame:
    part = src.table(spark, d, "part")
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"))
    diff = part.select(F.col("p_partkey").alias("pos"), F.concat(src.case(F.col("p_size") % 3, {0: "M", 1: "A"}, "D"), F.lit("\t"), path).alias("line"))
    status = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("?? "), path).alias("line"))
    return git.changes(diff, status).groupBy("scope", "status").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


def run_id() -> Column:
    return F.concat(F.lit("run_"), F.col("run_id").cast("string")).alias("run_id")


def stored_runs(spark: SparkSession, d: str) -> DataFrame:
    workspace = F.concat(F.lit("w"), (F.col("run_id") % 3).cast("string"))
    return src.runs(spark, d).select(run_id(), workspace.alias("workspace_id"), F.col("issue_id").cast("string").alias("issue_id"), "status", "runtime", "model", F.col("created_at").cast("timestamp").alias("created_at"))


@query("s10_run_records", "SELECT 'run_' || run_id AS run_id, status FROM runs WHERE run_id % 3 = 1 ORDER BY created_at DESC, run_id DESC")
def s10(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    sinks.overwrite_json(stored_runs(spark, d), at)
    return artifacts.run_records(spark, at, "w1").select("run_id", "status")


@query("s11_run_metrics", "SELECT 'run_' || run_id AS run_id, input_tokens, output_tokens, duration_ms FROM run_metrics WHERE run_id % 3 = 2")
def s11(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    workspace = F.concat(F.lit("w"), (F.col("run_id") % 3).cast("string")).alias("workspace_id")
    stored = src.run_metrics(spark, d).select(run_id(), workspace, "input_tokens", "output_tokens", "duration_ms", F.col("calculated_at").cast("timestamp").alias("calculated_at"))
    sinks.overwrite_json(stored, at)
    return artifacts.metrics(spark, at, "w2").select("run_id", "input_tokens", "output_tokens", "duration_ms")


@query("s12_coverage_results", "SELECT 'cov_' || result_id AS result_id, lines_total FROM (SELECT result_id, count(*) AS lines_total FROM coverage_lines GROUP BY result_id) WHERE result_id % 2 = 0 AND result_id % 5 = 1")
def s12(spark: SparkSession, d: str) -> DataFrame:
    at, id_ = folder(spark), F.col("result_id")
    counted = src.coverage_lines(spark, d).groupBy("result_id").agg(F.count(F.lit(1)).cast("int").alias("lines_total"))
    sinks.overwrite_json(counted.select(F.concat(F.lit("cov_"), id_.cast("string")).alias("result_id"), F.concat(F.lit("w"), (id_ % 2).cast("string")).alias("workspace_id"), (id_ % 5).cast("string").alias("issue_id"), "lines_total"), at)
    return artifacts.coverage_results(spark, at, "w0", "1").select("result_id", "lines_total")


@query("s08_collections", "SELECT 'v' || c_custkey AS view_id, c_name AS name FROM customer")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection, and one that isn't there."""
    at = folder(spark)
    sinks.overwrite_json(src.table(spark, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("view_id"), F.col("c_name").alias("name")), at)
    return artifacts.collection(spark, at, "saved_views").unionByName(artifacts.collection(spark, f"{at}-none", "saved_views")).select("view_id", "name")


@query("k01_collection_write", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def k01(spark: SparkSession, d: str) -> DataFrame:
    """The second write takes the place of the first as a whole."""
    at = folder(spark)
    supplier = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    sinks.overwrite(supplier.limit(1), at)
    sinks.overwrite(supplier, at)
    return spark.read.schema(supplier.schema).parquet(at)


@query("k02_activity_append", "SELECT 'a' || activity_id AS activity_id, action FROM activity WHERE entity_type IN ('fix', 'signal')")
def k02(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    rows = src.activity(spark, d).select(F.concat(F.lit("a"), F.col("activity_id").cast("string")).alias("activity_id"), "action", "entity_type")
    for kind in ("fix", "signal"):
        sinks.append_activity(rows.where(F.col("entity_type") == kind), at)
    return artifacts.activity_log(spark, at).select("activity_id", "action")


@query("k03_schema_tables", "SELECT * FROM (VALUES ('activity'), ('coverage_results'), ('changes'), ('findings'), ('fixes'), ('issues'), ('run_metrics'), ('run_reviews'), ('runs'), ('saved_views'), ('signals'), ('symbols'), ('workspaces')) AS t(name)")
def k03(spark: SparkSession, d: str) -> DataFrame:
    """The tables that the rendered statements create, read from their text."""
    from quarrylens.functions.text import table_names

    text = spark.createDataFrame([(";\n".join(sinks.ddl("ledger")),)], "sql string")
    return text.select(F.explode(table_names(F.col("sql"))).alias("name"))


@query("k06_search_rows", "SELECT p_type AS pattern, count(*) AS n FROM part GROUP BY p_type")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """Queries and their matches, appended apart and joined by their reference."""
    at = folder(spark)
    part = src.table(spark, d, "part")
    asked = [F.lit("w").alias("workspace_id"), F.lit("cli").alias("surface"), F.col("p_type").alias("pattern"), F.lit("python").alias("language"), F.lit("**/*.py").alias("path_glob")]
    sinks.append_search(part.select(*asked).distinct(), part.select(*asked, F.col("p_name").alias("path")), f"{at}/queries", f"{at}/matches")
    queries, matches = spark.read.parquet(f"{at}/queries"), spark.read.parquet(f"{at}/matches")
    return queries.join(matches.select("query_ref"), "query_ref").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("k10_markdown", """SELECT '# Regions' || chr(10) || chr(10) || '| r_name | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name) AS markdown
FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)""")
def k10(spark: SparkSession, d: str) -> DataFrame:
    joined = src.table(spark, d, "region").join(src.table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return sinks.markdown(joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n")), "Regions", ["r_name"])


def marked(column: str) -> Column:
    id_ = F.col("file_id")
    return F.concat(F.when(id_ % 4 == 0, "x = 1 # TODO: later\n").when(id_ % 4 == 1, "  except Exception: pass\n    raise NotImplementedError\n").when(id_ % 4 == 2, "url#TODO\n@pytest.mark.skip\n").otherwise(""), column)


_rules = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(line, '{p}')" for p in patterns) + f" THEN '{kind}' END" for kind, _, _, patterns in paths.SIGNAL_RULES)


@query("u11_signals", f"""SELECT file_path, line, kind FROM (SELECT path AS file_path, line_no AS line, unnest(list_filter([{_rules}], lambda x: x IS NOT NULL)) AS kind FROM (
SELECT path, unnest(own) AS line, generate_subscripts(own, 1) AS line_no FROM (SELECT path, string_split_regex(CASE file_id % 4 WHEN 0 THEN 'x = 1 # TODO: later' || chr(10) WHEN 1 THEN '  except Exception: pass' || chr(10) || '    raise NotImplementedError' || chr(10)
WHEN 2 THEN 'url#TODO' || chr(10) || '@pytest.mark.skip' || chr(10) ELSE '' END || content, '\\r?\\n') AS own FROM tree_files WHERE {SCANNED})))""")
def u11(spark: SparkSession, d: str) -> DataFrame:
    return trees.signals(tree(spark, d).select("path", marked("content").alias("text"))).select("file_path", "line", "kind")


IMPORTS = r"len(list_filter(string_split_regex(content, '\r?\n'), lambda x: regexp_matches(x, '^\s*(import |from |use |mod |require\()') OR regexp_matches(x, '^\s*const ') AND contains(x, 'require(')))"


@query("u18_path_explanations", rf"""SELECT path, path || ' is a ' || role || ' file with ' || lines || ' lines, ' || imports || ' import-like lines and ' || symbols || ' symbols.' AS summary, imports > 0 AS has_imports FROM (
SELECT path, coalesce({ROLE}, 'source') AS role, len(string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n')) AS lines, {IMPORTS} AS imports, (SELECT count(*) FROM tree_symbols s WHERE s.path = f.path) AS symbols FROM tree_files f)""")
def u18(spark: SparkSession, d: str) -> DataFrame:
    own = trees.explained(texts(spark, d))
    counted = trees.symbols(texts(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    joined = own.join(counted, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    return joined.select("path", trees.explanation().alias("summary"), (F.col("import_count") > 0).alias("has_imports"))


@query("x04_legal_steps", """SELECT run_id, old, new FROM (SELECT o_orderkey AS run_id, ['queued', 'planning', 'running', 'completed', 'failed'][CAST(o_orderkey % 5 AS INT) + 1] AS old, ['running', 'completed', 'failed', 'queued'][CAST(o_custkey % 4 AS INT) + 1] AS new FROM orders)
WHERE (old || '>' || new) IN ('queued>running', 'queued>failed', 'planning>queued', 'planning>running', 'planning>failed', 'running>completed', 'running>failed')""")
def x04(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int") + 1)
    steps = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), pick(["queued", "planning", "running", "completed", "failed"], "o_orderkey").alias("old"), pick(["running", "completed", "failed", "queued"], "o_custkey").alias("new"))
    return stream.legal_steps(steps)


def stored_activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity in the form of the log."""
    return src.activity(spark, d).select(F.concat(F.lit("a"), F.col("activity_id").cast("string")).alias("activity_id"), "action", "entity_type", "issue_id", "created_at")


@query("x02_log_lines", "SELECT conv_id || ':' || turn || ':' || role AS line FROM conversations")
def x02(spark: SparkSession, d: str) -> DataFrame:
    """Lines of run logs, read as a stream in two turns: the second sees what is new."""
    at = folder(spark)
    lines = src.output_lines(spark, d).select(F.concat_ws(":", "run_id", "pos", "type").alias("value"), (F.col("run_id") % 2).alias("turn"))
    for turn in (0, 1):
        lines.where(F.col("turn") == turn).select("value").write.mode("append").text(f"{at}/logs")
        sink = stream.output_lines(spark, f"{at}/logs").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file string, line string").parquet(f"{at}/out").select("line")


@query("s30_log_tail", "SELECT strftime(time_bucket(INTERVAL '10 minutes', created_at), '%Y-%m-%d %H:%M') AS opened, action, count(*) AS n FROM activity GROUP BY ALL")
def s30(spark: SparkSession, d: str) -> DataFrame:
    """The activity log as a stream, counted by window once all of it is read."""
    at = folder(spark)
    sinks.append_activity(stored_activity(spark, d), f"{at}/log")
    counted = stream.per_window(stream.log(spark, f"{at}/log"), late="3650 days")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("opened timestamp, action string, n bigint, batch bigint").parquet(f"{at}/out")
    last = rows.groupBy("opened", "action").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("opened", "yyyy-MM-dd HH:mm").alias("opened"), "action", "n")


@query("x03_streamed_review_queue", """SELECT issue_id, count(*) AS n, string_agg(CASE WHEN place <= 8 THEN CAST(run_id AS VARCHAR) END, ',' ORDER BY place) AS run_ids
FROM (SELECT CAST(issue_id AS VARCHAR) AS issue_id, run_id, row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, CAST(run_id AS VARCHAR) DESC) AS place FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT run_id FROM fixes) AND run_id NOT IN (SELECT run_id FROM reviews))
WHERE issue_id IN (SELECT issue_id FROM activity) GROUP BY issue_id""")
def x03(spark: SparkSession, d: str) -> DataFrame:
    """The review queue of the issues that the activity log touches, kept by a stream."""
    at = folder(spark)
    sinks.append_activity(stored_activity(spark, d), f"{at}/log")
    said = lambda df, *ids: df.withColumns({c: F.col(c).cast("string") for c in ids})
    stream.keep_review_queue(
        stream.log(spark, f"{at}/log"), lambda: said(src.runs(spark, d), "run_id", "issue_id"), lambda: said(src.fixes(spark, d), "run_id"), lambda: said(src.reviews(spark, d), "run_id"), f"{at}/queue", f"{at}/checkpoint").awaitTermination()
    return stream.review_queue(spark, f"{at}/queue").select("issue_id", "n", F.array_join("run_ids", ",").alias("run_ids"))
