"""Impact, retrieval, context packets and the semantic index over the source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import paths, text
from quarrylens.operators import context, semantic
from quarrylens.plans.rules import EXTENSIONS, IS_SCANNED, IS_SKIPPED, SKIPPED
from quarrylens.registry import VIEWS, query
from quarrylens.sources import adapters as src
from quarrylens.sources import scopes, structural, trees

SCANNED = IS_SCANNED.format(IS_SKIPPED.format(SKIPPED), EXTENSIONS)
MAPPED = IS_SCANNED.format(IS_SKIPPED.format(SKIPPED + ", 'target'"), EXTENSIONS)
ROLE = f"(CASE WHEN contains(lower(path), '/tests/') OR starts_with(lower(path), 'tests/') OR starts_with(regexp_extract(lower(path), '([^/]*)$', 1), 'test_') THEN 'test' WHEN {MAPPED} THEN 'source' END)"
GO_ROLE = r"""(CASE WHEN ends_with(lower(path), '.md') THEN 'guide' WHEN contains(lower(path), 'test') OR ends_with(lower(path), '.spec.ts') THEN 'test' WHEN regexp_matches(lower(path), '\.(json|toml|yaml|yml)$') THEN 'config'
WHEN contains(lower(path), 'main.') OR contains(lower(path), 'app.') THEN 'entry' WHEN regexp_matches(lower(path), '\.(py|go|rs|ts|tsx|js|jsx)$') THEN 'source' ELSE 'unknown' END)"""
NAME = "regexp_extract(lower(path), '([^/]*)$', 1)"
TEST_LIKE = f"(regexp_matches('/' || lower(path) || '/', '/(tests|__tests__)/') OR starts_with({NAME}, 'test_') OR contains({NAME}, '.test.') OR contains({NAME}, '.spec.'))"
SCORE = rf"""(CASE {GO_ROLE} WHEN 'entry' THEN 80 WHEN 'source' THEN 60 WHEN 'config' THEN 30 WHEN 'guide' THEN 20 WHEN 'test' THEN -80 ELSE 0 END + 35 * regexp_matches(lower(path), '^(backend|api|cmd|cli|scripts|src)/')::INT
+ 25 * regexp_matches(lower(path), 'cli\.py|__main__\.py|/main\.py|/service\.py|/commands/|/command/|/bin/')::INT + 12 * regexp_matches(lower(path), 'cli|terminal|runtime|server|agent|command')::INT
+ 18 * ({NAME} IN ('pyproject.toml', 'package.json', 'cargo.toml', 'makefile', 'justfile', 'readme.md', 'agents.md'))::INT - 60 * (contains('/' || lower(path) || '/', '/tests/') OR starts_with({NAME}, 'test_') OR contains({NAME}, '.test.') OR contains({NAME}, '.spec.'))::INT
+ 5 * regexp_matches(lower(path), '\.(md|json|toml|yaml|yml)$')::INT)"""
CLI = "12 * regexp_matches(lower(path), 'cli|terminal|runtime|server|agent|command')::INT"
WEB = "32 * regexp_matches(lower(path), 'frontend/|web/|ui/|src/app|src/pages|src/components')::INT"

_symbol = ", ".join(f"CASE WHEN regexp_extract(line, '{p}', 1) <> '' THEN {{'symbol': regexp_extract(line, '{p}', 1), 'kind': '{k}'}} END" for p, k in paths.SYMBOL_RULES)
VIEWS["tree_symbols"] = f"""
SELECT path, s.symbol AS symbol, s.kind AS kind, line_no AS line FROM (SELECT path, line_no, coalesce({_symbol}) AS s FROM (
SELECT path, unnest(string_split_regex(content, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line_no FROM tree_files WHERE {MAPPED})) WHERE s IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 48"""
VIEWS["changed_symbols"] = """
SELECT s.path, s.symbol, s.kind, min(s.line) AS line, any_value(c.scope) AS scopes, any_value(c.status) AS statuses FROM tree_symbols s JOIN tree_changes c ON s.path = c.path AND c.status <> 'deleted' GROUP BY s.path, s.symbol, s.kind"""
VIEWS["impact_terms"] = r"""
SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(path), '[a-z0-9_]{3,}'))) AS term FROM tree_changes WHERE status <> 'deleted') GROUP BY term)
UNION ALL SELECT term, 1 FROM (SELECT lower(symbol) AS term, min((path, line, symbol)) AS first FROM changed_symbols GROUP BY 1) x
WHERE term NOT IN (SELECT unnest(regexp_extract_all(lower(path), '[a-z0-9_]{3,}')) FROM tree_changes WHERE status <> 'deleted')
QUALIFY row_number() OVER (ORDER BY first) <= 64 - (SELECT count(*) FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(path), '[a-z0-9_]{3,}'))) FROM tree_changes WHERE status <> 'deleted'))"""
VIEWS["affected_paths"] = f"""
SELECT path, is_test, score FROM (SELECT path, is_test, CAST(2 * coalesce((SELECT sum(n) FROM impact_terms WHERE contains(lower(c.path), term) AND length(term) >= 3), 0) + marked::INT AS BIGINT) AS score FROM (
SELECT path, coalesce({ROLE} = 'test', false) AS marked, coalesce({ROLE} = 'test', false) OR contains(lower(path), 'test') OR ends_with(lower(path), '.spec.ts') AS is_test FROM (SELECT path FROM tree_files WHERE {SCANNED} ORDER BY path LIMIT 180)) c
WHERE path NOT IN (SELECT path FROM tree_changes WHERE status <> 'deleted')) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY is_test ORDER BY score DESC, path) <= 10"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    return src.tree_files(spark, d)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("path", F.col("content").alias("text"))


def impact(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes, changed symbols and affected paths."""
    changes = src.tree_changes(spark, d)
    symbols = semantic.changed_symbols(texts(spark, d), changes)
    return changes, symbols, semantic.affected(tree(spark, d), changes, symbols)


@query("u04_other_roles", rf"""SELECT file_id, {GO_ROLE} AS go_role, CASE WHEN {NAME} IN ('agents.md', 'conventions.md', 'readme.md') THEN 'guide' WHEN starts_with(path, 'docs/') OR ends_with({NAME}, '.md') THEN 'doc'
WHEN {NAME} IN ('package.json', 'pyproject.toml', 'cargo.toml', 'makefile', 'dockerfile') OR regexp_matches({NAME}, '\.(yaml|yml|json|toml)$') THEN 'config' WHEN list_has_any(string_split(path, '/'), ['test', 'tests', '__tests__']) OR contains({NAME}, 'test_') THEN 'test'
WHEN list_has_any(string_split(path, '/'), ['src', 'app', 'api']) THEN 'source' WHEN regexp_matches({NAME}, '\.(png|jpg|jpeg|gif|svg)$') THEN 'asset' ELSE 'unknown' END AS explained_role, {TEST_LIKE} AS test_like FROM tree_files""")
def u04(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return tree(spark, d).select("file_id", paths.go_role(path).alias("go_role"), paths.explained_role(path).alias("explained_role"), paths.is_test_like(path).alias("test_like"))


@query("u06_normal_paths", """SELECT file_id, CASE file_id % 5 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '^[^/]*/', '') WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE regexp_extract(path, '([^/]*)$', 1) END AS path
FROM tree_files WHERE contains(path, '/')""")
def u06(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    first = F.split(path, "/")[0]
    up = F.regexp_replace(path, "[^/]+", "..")
    given = (
        F.when(F.col("file_id") % 5 == 0, F.concat(F.lit(" ./"), path)).when(F.col("file_id") % 5 == 1, F.concat(first, F.lit("/./../"), F.regexp_replace(path, "^[^/]*/", "")))
        .when(F.col("file_id") % 5 == 2, F.concat(F.lit("../"), path)).when(F.col("file_id") % 5 == 3, F.concat(path, F.lit("/"), up)).otherwise(F.concat(path, F.lit("//"), up, F.lit("/"), paths.file_name(path)))
    )
    return tree(spark, d).where(path.contains("/")).select("file_id", paths.normal_path(given).alias("path"))


@query("u34_normalisers", """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'fresh' WHEN 1 THEN ' stale ' WHEN 2 THEN 'dirty_provisional' WHEN 3 THEN 'no_baseline' WHEN 4 THEN 'blocked' END AS status,
CASE p_size % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'structural' WHEN 2 THEN 'structural' ELSE 'lexical' END AS source, CASE WHEN p_size % 4 < 3 THEN ['cli', 'web', 'all'][p_size % 4 + 1] END AS surface FROM part""")
def u34(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    status = src.case(size % 7, {0: "fresh", 1: " stale ", 2: "dirty_provisional", 3: "no_baseline", 4: "blocked", 5: "other"}, " ")
    source = src.case(size % 5, {0: "hybrid", 1: "tree_sitter", 2: "regex", 3: "lexical"}, "else")
    return src.table(spark, d, "part").select(
        "p_partkey", text.known_status(status).alias("status"), text.derivation(source).alias("source"), text.surface(src.case(size % 4, {0: "CLI ", 1: "web", 2: "all"}, "tv")).alias("surface"))


@query("c04_dynamic_numbers", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size END AS number, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.75' WHEN 2 THEN 'n' || p_size END AS said FROM part")
def c04(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 4 == 0, size).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit(".75"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit('"n'), size, F.lit('"'))).otherwise("null")
    payload = F.concat(F.lit('{"v": '), value, F.lit("}"))
    return src.table(spark, d, "part").select("p_partkey", text.json_number(payload, "$.v").alias("number"), F.get_json_object(payload, "$.v").alias("said"))


@query("u39_guards", """SELECT p_partkey, p_size % 3 <> 2 AS valid, CASE p_size % 4 WHEN 0 THEN 'postgres://u' || p_partkey || ':***@host:5432/db' WHEN 1 THEN 'postgres://user:***@host/db' WHEN 2 THEN '<configured>' END AS dsn FROM part""")
def u39(spark: SparkSession, d: str) -> DataFrame:
    id_, size = F.col("p_partkey").cast("string"), F.col("p_size")
    name = F.when(size % 3 == 0, F.concat(F.lit(" s_"), id_)).when(size % 3 == 1, F.concat(F.lit("_"), id_)).otherwise(F.concat(id_, F.lit("-x")))
    dsn = F.when(size % 4 == 0, F.concat(F.lit("postgres://u"), id_, F.lit(":secret@host:5432/db"))).when(size % 4 == 1, "postgres://host/db").when(size % 4 == 2, "host=here").otherwise("  ")
    return src.table(spark, d, "part").select("p_partkey", text.is_schema_name(name).alias("valid"), text.redacted_dsn(dsn).alias("dsn"))


@query("q18_index_scores", f"SELECT file_id, {SCORE} + {CLI} AS cli, {SCORE} + {WEB} AS web FROM tree_files")
def q18(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("file_id", paths.index_score(F.col("path"), "cli").alias("cli"), paths.index_score(F.col("path"), "web").alias("web"))


PLAN = f"SELECT path, {SCORE} + {CLI} AS score, sha256(content) AS sha256, row_number() OVER (ORDER BY {SCORE} + {CLI} DESC, path) AS place FROM tree_files WHERE ({SCANNED} OR {ROLE} IS NOT NULL AND {ROLE} <> 'test') QUALIFY place <= 100"


@query("r08_index_plan", PLAN)
def r08(spark: SparkSession, d: str) -> DataFrame:
    return semantic.index_plan(tree(spark, d), "cli").select("path", "score", "sha256", "place")


@query("u15_index_mark", f"""SELECT sha256('{{"workspace_id":"w","surface":"cli","head_sha":"h1","paths":[' || string_agg('{{"path":"' || path || '","sha256":"' || sha256 || '"}}', ',' ORDER BY place) || ']}}') AS fingerprint FROM ({PLAN})""")
def u15(spark: SparkSession, d: str) -> DataFrame:
    return semantic.fingerprint(semantic.index_plan(tree(spark, d), "cli"), "w", "cli", "h1")


#: Workspaces: the seven remainders of a file's number.
WORKSPACE = "SELECT file_id % 7 AS workspace, path, sha256(content) AS sha256, file_id FROM tree_files"


@query("r10_freshness", f"""WITH p AS ({WORKSPACE}), b AS (SELECT workspace, bool_and(file_id % 7 <> 3 OR file_id % 2 = 0) AS covers FROM p GROUP BY workspace)
SELECT workspace, CASE WHEN workspace = 0 THEN 'blocked' WHEN workspace = 6 THEN 'no_baseline' WHEN (workspace = 5 OR workspace <> 4 AND covers) AND workspace IN (1, 5) THEN 'dirty_provisional' WHEN workspace = 5 OR workspace <> 4 AND covers THEN 'fresh' ELSE 'stale' END AS state FROM b""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Workspace 3 has changed files, 4 another head, 5 another head and the same mark; 1
    and 5 are dirty, 6 was never indexed, 0 can't be."""
    own = F.col("file_id") % 7
    planned = tree(spark, d).select(own.alias("workspace"), "file_id", "path", F.sha2("content", 256).alias("sha256"))
    stored = planned.withColumn("sha256", F.when((F.col("workspace") == 3) & (F.col("file_id") % 2 == 1), "old").otherwise(F.col("sha256")))
    w = F.col("workspace")
    workspaces = planned.select("workspace").distinct().select(w, (w != 0).alias("ready"), F.lit("H1").alias("head"), w.isin(1, 5).cast("int").alias("dirty"), F.concat(F.lit("m"), (w % 5).cast("string")).alias("mark"))
    pairs = F.map_from_entries(F.collect_list(F.struct("path", "sha256")))  # a plan has a hundred paths at most
    placed = stored.where("workspace <> 6").groupBy("workspace").agg(pairs.alias("paths"))
    baselines = placed.select(w, F.when(w.isin(4, 5), "h0").otherwise("h1").alias("head"), F.when(w == 5, "m0").otherwise("mx").alias("mark"), "paths")
    return semantic.freshness(planned.select("workspace", "path", "sha256"), workspaces, baselines)


@query("k07_index_baseline", f"""SELECT run, mark, n FROM (SELECT 1 AS run, sha256(string_agg(sha256, '' ORDER BY place)) AS mark, count(*) AS n FROM ({PLAN}) UNION ALL SELECT 2, sha256(string_agg(sha256, '' ORDER BY place)), count(*) FROM ({PLAN}) WHERE place <= 10)""")
def k07(spark: SparkSession, d: str) -> DataFrame:
    """A run's baseline is appended behind those before it."""
    plan = semantic.index_plan(tree(spark, d), "cli")
    mark = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sha256"))), lambda x: x["sha256"]), ""), 256)
    baseline = lambda run, df: df.agg(F.lit(run).alias("run"), mark.alias("mark"), F.count(F.lit(1)).alias("n"))
    return baseline(1, plan).unionByName(baseline(2, plan.where("place <= 10")))


@query("k08_symbol_batch", f"""SELECT path, status, n FROM (SELECT p.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN NOT {MAPPED.replace('path', 'p.path')} THEN 'skipped' ELSE 'stored' END AS status,
(SELECT count(*) FROM tree_symbols s WHERE s.path = p.path) AS n FROM (SELECT CASE WHEN file_id % 10 = 9 THEN path || '.gone' ELSE path END AS path FROM tree_files) p LEFT JOIN tree_files f ON f.path = p.path)""")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """All asked paths in one job, each with what became of it."""
    asked = tree(spark, d).select(F.when(F.col("file_id") % 10 == 9, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"))
    counted = trees.symbols(texts(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    there = tree(spark, d).select("path", F.lit(True).alias("there"))
    joined = asked.join(there, "path", "left").join(counted, "path", "left")
    status = F.when(F.col("there").isNull(), "missing").when(~paths.is_scanned(F.col("path"), "target"), "skipped").otherwise("stored")
    return joined.select("path", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query("d09_changed_symbols", "SELECT path, symbol, kind, line, scopes, statuses FROM changed_symbols")
def d09(spark: SparkSession, d: str) -> DataFrame:
    symbols = impact(spark, d)[1]
    return symbols.select("path", "symbol", "kind", "line", F.array_join("scopes", ",").alias("scopes"), F.array_join("statuses", ",").alias("statuses"))


@query("r02_semantic_impact", "SELECT path, is_test, score FROM affected_paths")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return impact(spark, d)[2]


@query("r03_impact_confidence", """SELECT changed, symbols, affected, CASE WHEN symbols > 0 AND affected > 0 THEN 'high' WHEN changed > 0 THEN 'medium' ELSE 'low' END AS confidence FROM (
SELECT (SELECT count(*) FROM tree_changes WHERE status <> 'deleted') AS changed, (SELECT count(*) FROM changed_symbols) AS symbols, (SELECT count(*) FROM affected_paths) AS affected)""")
def r03(spark: SparkSession, d: str) -> DataFrame:
    return semantic.impact_confidence(*impact(spark, d))


@query("r05_path_symbols", "SELECT path, symbol, kind, line FROM tree_symbols QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 32")
def r05(spark: SparkSession, d: str) -> DataFrame:
    return trees.symbols(texts(spark, d), 32).select("path", "symbol", "kind", F.col("line_start").alias("line"))


TERMS = ["page1", "view", "main", "cli", "tion"]
FOUND = "len(list_filter(['page1', 'view', 'main', 'cli', 'tion'], lambda t: contains(lower({0}), t)))"


@query("r01_retrieval", f"""WITH lexical AS (SELECT path, arg_max(n + points, points) AS score FROM (SELECT path, {FOUND.format(f"path || ' ' || {ROLE}")} AS n, 6 AS points FROM tree_files WHERE {ROLE} IS NOT NULL
UNION ALL SELECT path, {FOUND.format("path || ' ' || left(content, 30000)")}, 4 FROM tree_files WHERE {ROLE} IS NOT NULL OR {SCANNED}) WHERE n > 0 GROUP BY path),
first AS (SELECT path FROM lexical ORDER BY score DESC, path LIMIT 24)
SELECT source_type, path, title, score FROM (SELECT 'lexical_hit' AS source_type, path, path AS title, score FROM lexical UNION ALL SELECT DISTINCT 'structural_hit', path, kind || ' ' || symbol, {FOUND.format("symbol || ' ' || kind")} + 9 FROM tree_symbols
WHERE path IN (SELECT path FROM first) AND {FOUND.format("symbol || ' ' || kind")} > 0) ORDER BY score DESC, source_type, path || title LIMIT 12""")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return semantic.retrieval(tree(spark, d), TERMS)


@query("q16_symbol_context", f"""SELECT path, symbol, s.kind AS kind, s.line AS line, 2 * {FOUND.format("path || ' ' || symbol")} + 2 * (path IN ('backend/m0/cli.py', 'src/app1/main.ts'))::INT AS score
FROM (SELECT path, symbol, min({{'line': line, 'kind': kind}}) AS s FROM tree_symbols GROUP BY path, symbol) WHERE score > 0 ORDER BY score DESC, path, symbol LIMIT 8""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return semantic.symbol_context(tree(spark, d), TERMS, ["backend/m0/cli.py", "src/app1/main.ts"])


@query("r11_semantic_search", f"""SELECT path, line, symbol, greatest(3, 2 * {FOUND.format("path || ' ' || symbol")} + 2 * (path = 'backend/m0/cli.py')::INT) AS score FROM tree_symbols WHERE kind = 'function' AND ends_with(path, '.py') ORDER BY score DESC, path, line LIMIT 8""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Matches of a pattern (function definitions of Python files), scored for a context."""
    found = trees.symbols(texts(spark, d)).where("kind = 'function' AND endswith(path, '.py')").select("path", F.col("line_start").alias("line"), "symbol").distinct()
    return context.scored_matches(found, F.concat_ws(" ", "path", "symbol"), TERMS, ["backend/m0/cli.py"]).select("path", "line", "symbol", "score")


VIEWS["source_lines"] = f"""
SELECT path, line_no, line, coalesce({_symbol}) AS s, length(line) - length(ltrim(line, ' ' || chr(9))) AS margin FROM (
SELECT path, unnest(own) AS line, generate_subscripts(own, 1) AS line_no FROM (SELECT path, string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') AS own FROM tree_files WHERE {MAPPED}))"""
VIEWS["source_braces"] = """
SELECT *, sum(step) OVER (PARTITION BY path ORDER BY line_no, pos) AS depth FROM (SELECT path, line_no, unnest(own) AS brace, generate_subscripts(own, 1) AS pos, CASE unnest(own) WHEN '{' THEN 1 ELSE -1 END AS step
FROM (SELECT path, line_no, regexp_extract_all(regexp_replace(line, '"(?:\\\\.|[^"\\\\])*"|''(?:\\\\.|[^''\\\\])*''|//.*$', '', 'g'), '[{}]') AS own FROM source_lines WHERE path NOT LIKE '%.py'))"""
VIEWS["spanned_symbols"] = f"""
SELECT d.path, d.line_no, d.s, d.margin AS level, coalesce((SELECT max(b.line_no) FROM source_lines b WHERE b.path = d.path AND regexp_matches(b.line, '\\S') AND b.line_no < coalesce((SELECT min(c.line_no) FROM source_lines c
  WHERE c.path = d.path AND c.line_no > d.line_no AND regexp_matches(c.line, '\\S') AND c.margin <= d.margin AND NOT regexp_matches(c.line, '^\\s*[)\\]}}]')), 1e9)), d.line_no) AS line_end, true AS has_body
FROM source_lines d WHERE d.s IS NOT NULL AND d.path LIKE '%.py'
UNION ALL SELECT path, line_no, s, level, CASE WHEN has_body THEN coalesce((SELECT min((b.line_no, b.pos)) FROM source_braces b WHERE b.path = o.path AND (b.line_no, b.pos) > (o.first.line_no, o.first.pos) AND b.depth <= o.level)[1],
  (SELECT max(line_no) FROM source_lines c WHERE c.path = o.path)) ELSE line_no END AS line_end, has_body FROM (
SELECT *, first IS NOT NULL AND first.brace = '{{' AND (SELECT count(*) FROM source_lines c WHERE c.path = e.path AND c.s IS NOT NULL AND c.line_no > e.line_no AND c.line_no <= e.first.line_no) = 0 AS has_body FROM (
SELECT path, line_no, s, coalesce((SELECT sum(step) FROM source_braces b WHERE b.path = d.path AND b.line_no < d.line_no), 0) AS level,
  (SELECT min({{'line_no': b.line_no, 'pos': b.pos, 'brace': b.brace}}) FROM source_braces b WHERE b.path = d.path AND b.line_no >= d.line_no) AS first FROM source_lines d WHERE s IS NOT NULL AND path NOT LIKE '%.py') e) o"""


@query("s28_scoped_symbols", """SELECT path, s.symbol AS symbol, s.kind AS kind, line_no AS line_start, line_end, (SELECT max_by(c.s.symbol, c.line_no) FROM spanned_symbols c WHERE c.path = d.path AND c.has_body AND c.s.kind IN ('class', 'type') AND c.line_no < d.line_no AND c.line_end >= d.line_no
AND c.level < d.level) AS enclosing_scope FROM spanned_symbols d QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 32""")
def s28_scoped(spark: SparkSession, d: str) -> DataFrame:
    return scopes.symbols(texts(spark, d))


@query("r11_structural_search", r"""SELECT path, 'python' AS language, line_no AS line_start, line_no + 1 AS line_end, regexp_extract(line, 'def .*') || chr(10) || next AS matched_text, 'NAME' AS meta_variables FROM (
SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line_no) AS next FROM source_lines) WHERE path LIKE 'backend/%.py' AND regexp_matches(line, '^def run_\d+\(x\):$') AND next = '  return x'
UNION ALL SELECT path, 'python', line_no, line_no, 'return x', '' FROM source_lines WHERE path LIKE '%.py' AND line = '  return x'
UNION ALL SELECT path, 'typescript', line_no, line_no, line, 'NAME' FROM source_lines WHERE path LIKE '%.ts' AND regexp_matches(line, '^export class \w+ \{$')""")
def r11_structural(spark: SparkSession, d: str) -> DataFrame:
    """Three patterns: definitions below a glob, a statement, and the heads of classes."""
    own = texts(spark, d)
    heads = own.select("path", F.regexp_replace("text", r"(?m)^(export class \w+ \{)$", "$1}").alias("text"))
    found = structural.search(own, "def $NAME($$$ARGS): $$$BODY", "python", "backend/**/*.py")
    found = found.unionByName(structural.search(own, "return x", "python")).unionByName(structural.search(heads, "export class $NAME {}", "typescript").withColumn("matched_text", F.regexp_replace("matched_text", r"\}$", "")))
    return found.withColumn("meta_variables", F.array_join("meta_variables", ","))


@query("r04_repo_context", """WITH refs AS (SELECT path AS ref FROM tree_changes UNION SELECT path FROM affected_paths),
plans AS (SELECT file_id // 3 AS run_id, count(DISTINCT path) AS n FROM tree_files WHERE path IN (SELECT ref FROM refs) GROUP BY 1),
newest AS (SELECT file_id, 'edited ' || upper(path) AS summary, CASE WHEN file_id % 2 = 0 THEN 'edit' ELSE 'view' END AS action FROM tree_files ORDER BY file_id DESC LIMIT 80)
(SELECT 'lexical_hit' AS source_type, 'change:' || path AS source_id, status || ' ' || path AS title, 8 AS score FROM tree_changes ORDER BY path LIMIT 10)
UNION ALL (SELECT 'structural_hit', 'symbol:' || path || ':' || symbol, kind || ' ' || symbol, 10 FROM changed_symbols ORDER BY path, line, symbol LIMIT 10)
UNION ALL (SELECT 'artifact', 'run_plan:' || run_id, 'Run plan ' || run_id, n + 8 FROM (SELECT * FROM plans ORDER BY n DESC, run_id LIMIT 8) ORDER BY n DESC, run_id LIMIT 5)
UNION ALL (SELECT 'artifact', 'activity:' || action, summary, 5 FROM newest WHERE EXISTS (SELECT 1 FROM refs WHERE contains(lower(newest.summary), lower(ref))) ORDER BY file_id DESC LIMIT 5)
UNION ALL (SELECT 'artifact', 'fix:fix_' || file_id, 'Fixed ' || path, 9 FROM tree_files f WHERE file_id % 3 = 1 AND EXISTS (SELECT 1 FROM refs WHERE contains(lower(f.path), lower(ref)) OR contains(lower(ref), lower(f.path))) ORDER BY file_id DESC, 'fix_' || file_id LIMIT 1)""")
def r04(spark: SparkSession, d: str) -> DataFrame:
    changes, symbols, found = impact(spark, d)
    files, id_ = tree(spark, d), F.col("file_id")
    refs = changes.select("path").union(found.select("path"))
    plans = context.linked_plans(files.select(F.floor(id_ / 3).alias("run_id"), F.array("path").alias("files")), refs)
    activity = files.select(id_.alias("activity_id"), id_.alias("created_at"), F.when(id_ % 2 == 0, "edit").otherwise("view").alias("action"), F.concat(F.lit("edited "), F.upper("path")).alias("summary"))
    fixes = files.where(id_ % 3 == 1).select(F.concat(F.lit("fix_"), id_.cast("string")).alias("fix_id"), id_.alias("recorded_at"), F.concat(F.lit("Fixed "), "path").alias("summary"), "path")
    return semantic.repo_context(changes, symbols, found, plans, activity, fixes)


@query("j10_reference_paths", """SELECT DISTINCT f.path, r.ref FROM tree_files f JOIN (SELECT CASE file_id % 3 WHEN 0 THEN path WHEN 1 THEN upper(regexp_extract(path, '^[^/]*')) ELSE 'x/' || path || '/y' END AS ref FROM tree_files WHERE file_id % 9 < 3) r
ON contains(lower(f.path), lower(r.ref)) OR contains(lower(r.ref), lower(f.path))""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    ref = F.when(F.col("file_id") % 3 == 0, path).when(F.col("file_id") % 3 == 1, F.upper(F.split(path, "/")[0])).otherwise(F.concat(F.lit("x/"), path, F.lit("/y")))
    return semantic.references(tree(spark, d), tree(spark, d).where("file_id % 9 < 3").select(ref.alias("ref")))


@query("r06_issue_packets", """WITH asked AS (SELECT * FROM issues WHERE bug_id % 100 = 0),
f AS (SELECT issue_id, list(fix_id ORDER BY place) AS own FROM (SELECT issue_id, fix_id, row_number() OVER (PARTITION BY issue_id ORDER BY recorded_at DESC, fix_id) AS place FROM fixes) WHERE place <= 5 GROUP BY issue_id),
a AS (SELECT issue_id, list(activity_id ORDER BY place) AS own FROM (SELECT CAST(issue_id AS BIGINT) AS issue_id, activity_id, row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, activity_id) AS place FROM activity WHERE issue_id IS NOT NULL) WHERE place <= 8 GROUP BY issue_id),
r AS (SELECT issue_id, count(*) AS n FROM runs GROUP BY issue_id)
SELECT bug_id, title, severity, ltrim(evidence_path, './') AS focus, array_to_string(drift_flags, ',') AS evidence, coalesce(array_to_string(f.own, ','), '') AS fixes, coalesce(array_to_string(a.own, ','), '') AS activity, coalesce(r.n, 0) AS n_runs
FROM asked LEFT JOIN f ON f.issue_id = bug_id LEFT JOIN a ON a.issue_id = bug_id LEFT JOIN r ON r.issue_id = bug_id""")
def r06(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the issues whose id is divisible by 100."""
    issues = src.issues(spark, d).where("bug_id % 100 = 0").select("bug_id", "title", "severity", F.array("evidence_path").alias("paths"), F.col("drift_flags").alias("evidence"))
    activity = src.activity(spark, d).where("issue_id IS NOT NULL").select(F.col("issue_id").cast("long").alias("issue_id"), "activity_id", "created_at")
    runs = src.runs(spark, d).groupBy("issue_id").agg(F.count(F.lit(1)).alias("n"))
    packets = semantic.issue_packets(issues, src.fixes(spark, d), activity, runs)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return packets.select("bug_id", "title", "severity", *(joined(c) for c in ("focus", "evidence", "fixes", "activity")), "n_runs")


@query("q20_fix_drafts", """SELECT run_id, CASE WHEN status = 'completed' THEN 'verification' ELSE 'in_progress' END AS issue_status, 'Done ' || run_id AS summary, CASE WHEN run_id % 2 = 0 THEN 'pytest tests/' || run_id ELSE '' END AS tests,
CASE WHEN run_id % 3 = 0 THEN 'src/a' || run_id || '.py' ELSE 'd1,d2,d3,d4,d5,d6,d7,d8' END AS files FROM runs""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("run_id").cast("string")
    excerpt = F.concat(F.lit("- Done "), id_, F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("\nran `pytest tests/"), id_, F.lit("`"))).otherwise(""), F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("\nchanged src/a"), id_, F.lit(".py"))).otherwise(""))
    dirty = F.array(*(F.lit(f"d{k}") for k in range(1, 11)))
    drafts = context.fix_drafts(src.runs(spark, d).select("run_id", "status", excerpt.alias("excerpt"), dirty.alias("dirty")))
    return drafts.select("run_id", "issue_status", "summary", F.array_join("tests", ",").alias("tests"), F.array_join("files", ",").alias("files"))


@query("u27_guidance_summaries", """SELECT p_partkey, 'Rules for ' || p_brand AS title, 'use ' || p_type || ' Write tests ' || p_name AS summary, 'use ' || p_type || chr(10) || 'Write tests' || chr(10) || p_name || chr(10) || 'last' AS excerpt, 'alpha,' || p_size AS keywords FROM part""")
def u27(spark: SparkSession, d: str) -> DataFrame:
    said = F.format_string("---\nname: x\nkeywords: ['alpha', \"%d\", ]\n---\n# Rules for %s\n\n- use %s\n```\ncode\n```\n1. Write tests\n1. Write tests\n* %s\n## More\nlast\nnever seen\n", "p_size", "p_brand", "p_type", "p_name")
    own = context.guidance_summary(said, F.lit("docs/AGENTS.md"))
    # the table's file is small for its rows: dealt out, as the rows are many times larger once they are texts
    part = src.table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select("p_partkey", own.alias("g")).select("p_partkey", "g.title", "g.summary", "g.excerpt", F.array_join("g.keywords", ",").alias("keywords"))


@query("u33_semantic_patterns", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'def low' || p_size || '($$$ARGS): $$$BODY|class Big: $$$BODY' ELSE 'function low' || p_size || '($$$ARGS) { $$$BODY }|const low' || p_size || ' = ($$$ARGS) => $$$BODY|class Big { $$$BODY }' END AS patterns,
CASE WHEN p_size % 2 = 0 THEN '**/*.py' ELSE '**/*.ts' END AS glob FROM part""")
def u33(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(F.lit("error"), F.concat(F.lit("low"), F.col("p_size").cast("string")), F.lit("a"), F.lit("Big"), F.lit("no-name"))
    path = F.when(F.col("p_size") % 2 == 0, "src/a.py").otherwise("src/b.ts")
    own = context.semantic_patterns(terms, F.array(path, F.lit("README")))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(own, lambda x: x["pattern"]), "|").alias("patterns"), own[0]["glob"].alias("glob"))


@query("k13_plan_versions", """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version, CASE c_custkey % 4 WHEN 0 THEN 'a:manual,b:plan,c:manual' WHEN 2 THEN 'c:manual,a:manual' ELSE 'a:plan,b:plan' END AS attached, CASE WHEN c_custkey % 2 = 0 THEN 24 ELSE 0 END AS dirty FROM customer""")
def k13(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("c_custkey")
    plans = src.table(spark, d, "customer").select(id_.alias("run_id"), F.lit(1).alias("version"), F.array(*(F.struct(F.lit(p).alias("path"), F.lit("plan").alias("source")) for p in "ab")).alias("attached"))
    updates = src.table(spark, d, "customer").where(id_ % 2 == 0).select(id_.alias("run_id"), F.array(F.lit(" ./c"), F.lit("/a"), F.lit("c"), F.lit(" ")).alias("paths"), (id_ % 4 == 2).alias("replace"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: x.cast("string")).alias("dirty"))
    out = context.plan_versions(plans, updates)
    listed = F.array_join(F.transform("attached", lambda x: F.concat_ws(":", x["path"], x["source"])), ",")
    return out.select("run_id", "version", listed.alias("attached"), F.size("dirty").alias("dirty"))


@query("a26_ingestion_phases", """WITH f AS (SELECT source, count(*) > 0 AS files, count(*) FILTER (lang = 'en') > 20 AS symbols, count(*) FILTER (n_chars > 5000) > 5 AS search FROM documents GROUP BY source)
SELECT source, p.phase, CASE WHEN p.own THEN 'ready' WHEN p.before THEN 'next' ELSE 'blocked' END AS state FROM f, LATERAL (SELECT 'files' AS phase, files AS own, true AS before UNION ALL SELECT 'symbols', files AND symbols, files UNION ALL SELECT 'search', files AND symbols AND search, files AND symbols) p""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    given = src.table(spark, d, "documents").groupBy("source").agg((F.count(F.lit(1)) > 0).alias("files"), (F.count_if(F.col("lang") == "en") > 20).alias("symbols"), (F.count_if(F.col("n_chars") > 5000) > 5).alias("search"))
    return context.phases(given, "source", {"files": [], "symbols": ["files"], "search": ["files", "symbols"]})


@query("k13_plan_revisions", """SELECT c_custkey AS run_id, v AS version, CASE v WHEN 1 THEN 'awaiting_approval' ELSE 'modified' END AS phase, 'planrev_' || left(sha256(c_custkey || ':' || v), 12) AS revision_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'main' END AS branch,
CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE least(c_custkey % 40, 24) END AS dirty, 'f' || v AS files FROM customer, (VALUES (1), (2)) AS t(v) WHERE v = 1 OR c_custkey % 2 = 0""")
def k13_revisions(spark: SparkSession, d: str) -> DataFrame:
    """A row is appended for each version of a plan, with the working tree's state."""
    id_ = F.col("c_custkey")
    customer = src.table(spark, d, "customer")
    versions = customer.select(id_.alias("run_id"), F.explode(F.when(id_ % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("version"))
    plans = versions.select("run_id", "version", F.when(F.col("version") == 1, "awaiting_approval").otherwise("modified").alias("phase"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("feedback"), F.array(F.concat(F.lit("f"), F.col("version").cast("string"))).alias("attached"), F.lit(None).cast("timestamp").alias("created_at"))
    count = (id_ % 40).cast("int")
    dirty = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: k.cast("string")))
    worktrees = customer.where(id_ % 3 != 0).select(id_.alias("run_id"), F.lit("main").alias("branch"), F.lit("h1").alias("head_sha"), dirty.alias("dirty"))
    rows = context.plan_revisions(plans, worktrees)
    return rows.select("run_id", "version", "phase", "revision_id", "branch", F.size("dirty_paths").alias("dirty"), F.array_join("attached_files", ",").alias("files"))


def _phase(place: int, name: str, done: str, needs: tuple) -> str:
    lacking = ", ".join(f"CASE WHEN {'true' if need is None else f'NOT {need}'} THEN '{said}' END" for need, said in needs)
    return f"SELECT source, {place} AS place, '{name}' AS phase_id, '{done}' AS done, array_to_string(list_filter([{lacking}], lambda x: x IS NOT NULL), '|') AS blockers FROM f"


@query("a26_ingestion_plan", f"""WITH f AS (SELECT source, count(*) > 0 AS scanned, count(*) FILTER (lang = 'en') > 20 AS mapped, count(*) FILTER (n_chars > 5000) > 2 AS stored, count(*) FILTER (lang = 'fr') > 15 AS parser, count(*) % 2 = 0 AS patterns FROM documents GROUP BY source),
p AS (SELECT source, place, phase_id, CASE WHEN blockers = '' THEN done ELSE 'blocked' END AS delivery_state, blockers FROM ({" UNION ALL ".join(_phase(k, *x) for k, x in enumerate(context.PHASES, 1))}))
SELECT p.*, (SELECT min_by(q.phase_id, q.place) FROM p q WHERE q.source = p.source AND q.delivery_state = 'ready') AS next_phase_id FROM p""")
def a26_plan(spark: SparkSession, d: str) -> DataFrame:
    """All seven phases for each source."""
    lang, n = F.col("lang"), F.count(F.lit(1))
    given = src.table(spark, d, "documents").groupBy("source").agg((n > 0).alias("scanned"), (F.count_if(lang == "en") > 20).alias("mapped"), (F.count_if(F.col("n_chars") > 5000) > 2).alias("stored"), (F.count_if(lang == "fr") > 15).alias("parser"), (n % 2 == 0).alias("patterns"))
    return context.ingestion_plan(given, "source").withColumn("blockers", F.array_join("blockers", "|"))


_reason = f"""{GO_ROLE} || ' file; score ' || score || CASE WHEN regexp_matches(lower(path), 'cli|runtime|server|agent|command|terminal') THEN '; matches CLI/runtime surface markers' ELSE '' END
|| CASE WHEN regexp_matches(lower(path), '\\.test\\.|\\.spec\\.') OR contains('/' || lower(path) || '/', '/tests/') THEN '; test-like path received a ranking penalty' ELSE '' END"""


@query("r08_index_selections", f"""WITH chosen AS ({PLAN}) SELECT path, place, role, reason, array_to_string(list_filter({list(semantic.SELECTION_TERMS)}, lambda t: contains(lower(path || ' ' || reason), t))[1:6], ',') AS matched_terms,
(SELECT count(*) FROM chosen) AS selected, true AS can_run, 'dirty files make the baseline provisional' AS warnings FROM (SELECT path, place, {GO_ROLE} AS role, {_reason} AS reason FROM chosen)""")
def r08_selections(spark: SparkSession, d: str) -> DataFrame:
    """The plan's paths with their reasons, and whether it can run."""
    plan = semantic.index_plan(tree(spark, d), "cli")
    ready = semantic.readiness(plan, True, 3).first()  # one row
    chosen = semantic.selections(plan, "cli").select("path", "place", "role", "reason", F.array_join("matched_terms", ",").alias("matched_terms"))
    return chosen.withColumns({"selected": F.lit(ready.selected), "can_run": F.lit(ready.can_run), "warnings": F.lit(",".join(ready.warnings))})


_own = "coalesce((SELECT array_to_string(list(v ORDER BY k), ',') FROM ({0}) WHERE k <= {1}), '')"


def _first(rows: str, value: str, order: str, most: int = 8) -> str:
    return _own.format(f"SELECT {value} AS v, row_number() OVER (ORDER BY {order}) AS k FROM {rows}", most)


@query("r06_packet_parts", f"""WITH asked AS (SELECT bug_id, severity, ltrim(evidence_path, './') AS path FROM issues WHERE bug_id % 100 = 0),
tickets AS (SELECT (p_partkey % 30) * 100 AS issue_id, p_partkey AS id, p_size AS moment FROM part), threats AS (SELECT (s_suppkey % 20) * 100 AS issue_id, s_suppkey AS id, s_nationkey AS moment FROM supplier),
dumps AS (SELECT (n_nationkey % 10) * 100 AS issue_id, n_nationkey AS id, n_regionkey AS moment FROM nation),
symbols AS (SELECT 'src/src' || c_custkey % 9 || '/' || ['en', 'de', 'fr', 'es'][c_custkey % 4 + 1] || '.py' AS path, c_nationkey AS line, c_name AS symbol FROM customer),
globs AS (SELECT * FROM (VALUES ('src/**/en.py', '^src/(?:.*/)?en\\.py$', 'English first'), ('src/src1/*', '^src/src1/[^/]*$', 'Ask one'), ('docs/**', '^docs/.*$', 'Docs'), ('**', '^.*$', 'Always')) AS g(place, pattern, instruction))
SELECT bug_id, {_first("tickets WHERE issue_id = bug_id", "id", "moment DESC, id")} AS tickets, {_first("threats WHERE issue_id = bug_id", "id", "moment DESC, id")} AS threats, {_first("dumps WHERE issue_id = bug_id", "id", "moment DESC, id")} AS dumps,
{_first("runs WHERE issue_id = bug_id", "run_id || ':' || status", "created_at DESC, run_id")} AS prior_runs, {_first("symbols s WHERE s.path = asked.path", "symbol", "line, symbol")} AS symbols,
coalesce((SELECT array_to_string(list(instruction ORDER BY instruction), ',') FROM globs WHERE regexp_matches(asked.path, pattern)), '') AS instructions, (SELECT array_to_string(list(r_name ORDER BY r_regionkey, r_name), ',') FROM region) AS guidance,
(SELECT array_to_string(list(n_name ORDER BY n_nationkey, n_name), ',') FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 8)) AS profiles, regexp_replace(path, '\\.py$', '.test.py') AS tests FROM asked""")
def r06_parts(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries are the issues whose id is divisible by 100."""
    issues = src.issues(spark, d).where("bug_id % 100 = 0").select("bug_id", "severity", F.array("evidence_path").alias("paths"))
    table = lambda name, id_, n, at: src.table(spark, d, name).select(((F.col(id_) % n) * 100).cast("long").alias("issue_id"), F.col(id_).cast("long").alias("id"), F.col(at).alias("at"))
    key = F.col("c_custkey")
    path = F.concat(F.lit("src/src"), (key % 9).cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (key % 4 + 1).cast("int")), F.lit(".py"))
    tables = {
        "tickets": table("part", "p_partkey", 30, "p_size"), "threats": table("supplier", "s_suppkey", 20, "s_nationkey"), "dumps": table("nation", "n_nationkey", 10, "n_regionkey"),
        "runs": src.runs(spark, d).select("issue_id", F.col("run_id").alias("id"), F.col("created_at").alias("at"), "status"),
        "symbols": src.table(spark, d, "customer").select(path.alias("path"), F.col("c_nationkey").alias("line"), F.col("c_name").alias("symbol")),
    }
    globs = spark.createDataFrame([("src/**/en.py", "English first"), ("src/src1/*", "Ask one"), ("docs/**", "Docs"), ("**", "Always")], "glob string, instruction string")
    workspace = {"guidance": src.table(spark, d, "region").select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("name")), "profiles": src.table(spark, d, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name"))}
    parts = semantic.packet_parts(issues, tables, globs, workspace)
    return parts.select("bug_id", *(F.array_join(c, ",").alias(c) for c in parts.columns[1:]))
