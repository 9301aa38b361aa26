"""Readers of trees, coverage reports, findings, git output, ledgers and artifacts."""

import json

from quarrylens import schemas
from quarrylens.sources import artifacts, coverage, findings, git, ledgers, sinks, trees


def put(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def texts(spark, **reports):
    return spark.createDataFrame([(k.replace("_DOT_", "."), v) for k, v in reports.items()], "path string, text string")


def only(df):
    (row,) = df.collect()
    return row.asDict(recursive=True)


def test_tree_signals_and_symbols(spark, tmp_path):
    code = "# TODO: fix\nclass A(B):\n    def go(self):\n        try:\n            pass\n        except Exception: pass\n        x = 'a#TODO'\n        raise NotImplementedError\n"
    root = put(tmp_path, src__app_DOT_py=code, research__x_DOT_py="# TODO\n", docs__a_DOT_md="# TODO\n", tests__test_x_DOT_py="@pytest.mark.skip\nfunc (a B) Go(x)\r\npub fn f(\n", src__bad_DOT_py=b"# TODO \xff\n", README_DOT_md="hi")
    tree = trees.files(spark, root)
    found = {(r.kind, r.file_path, r.line) for r in trees.signals(tree).collect()}
    assert found == {("annotation", "src/app.py", 1), ("exception_swallow", "src/app.py", 6), ("not_implemented", "src/app.py", 8), ("test_marker", "tests/test_x.py", 1)}
    assert all(r.signal_id == "sig_" + r.fingerprint[:12] for r in trees.signals(tree).collect())
    own = {(r.path, r.symbol, r.kind, r.line_start, r.enclosing_scope) for r in trees.symbols(tree).collect()}
    assert own == {("src/app.py", "A", "class", 2, None), ("src/app.py", "go", "function", 3, "A"), ("tests/test_x.py", "Go", "function", 2, None), ("tests/test_x.py", "f", "function", 3, None)}
    mapped = {r.path: r.role for r in trees.repo_map(trees.files(spark, root, content=False)).collect()}
    assert mapped == {"src/app.py": "source", "src/bad.py": "source", "tests/test_x.py": "test", "README.md": "guide"}
    assert only(trees.repo_map_totals(trees.repo_map(tree)))["total_files"] == 4
    assert [(r.name, r.is_dir) for r in trees.directory(tree).collect()] == [("docs", True), ("research", True), ("src", True), ("tests", True), ("README.md", False)]
    assert {r.path: r.line_count for r in trees.explained(tree).collect()}["src/app.py"] == 8


def test_tree_listings(spark, tmp_path):
    root = put(tmp_path, docs__bugs__Bugs_1_DOT_md="x", docs__bugs__Bugs_2_DOT_md="x", docs__bugs__Bugs_9_status_x_DOT_md="x", package_DOT_json='{"scripts": {"test": "x", "build": "y"}}', a__b__package_DOT_json="{}", a__b__c__package_DOT_json="{}", Makefile="test:\n\techo\nlint: test\nX := 1\n", AGENTS_DOT_md="x", rules__one_DOT_mdc="x", rules__two_DOT_txt="x")
    tree = trees.files(spark, root)
    assert only(trees.latest_ledger(tree))["path"] == "docs/bugs/Bugs_2.md"
    assert {r.path for r in trees.manifests(tree).collect()} == {"package.json", "a/b/package.json"}
    assert {(r.kind, r.command, r.confidence) for r in trees.targets(tree).collect()} == {("test", "npm run test", 85), ("build", "npm run build", 85), ("test", "make test", 80), ("lint", "make lint", 80)}
    known = spark.createDataFrame([("AGENTS.md", "agents", True, 1), ("rules/", "rule", False, 2)], "path string, kind string, always_on boolean, priority int")
    assert [r.path for r in trees.guidance(tree, known).collect()] == ["AGENTS.md", "rules/one.mdc"]


def test_coverage_formats(spark):
    lcov = "SF:src/app.py\nDA:1,1\nDA:2,0\nend_of_record\nSF:src/empty.py\nDA:1,0\nend_of_record\n"
    xml = '<coverage line-rate="0.5" branch-rate="0.25"><packages><package><classes><class filename="src/app.py"><lines><line number="1" hits="1"/><line number="2" hits="0"/></lines></class><class filename="src/empty.py"><lines><line number="1" hits="0"/></lines></class></classes></package></packages></coverage>'
    istanbul = '{"coverage":{"src/app.ts":{"s":{"1":1,"2":0}},"src/empty.ts":{"s":{"1":0}}}}'
    listed = '{"source_files":[{"path":"a","s":{"1":{"executed":true},"2":3}},{"file":"b"}]}'
    rows = {r.raw_report_path: r for r in coverage.results(texts(spark, a_DOT_info=lcov, b_DOT_xml=xml, c_DOT_json=istanbul, d_DOT_json=listed, e_DOT_xml="no", f_DOT_json="no", g_DOT_bin="x")).collect()}
    got = {k: (r.format, r.line_coverage, r.branch_coverage, r.lines_covered, r.lines_total, r.files_covered, r.files_total, r.uncovered_files) for k, r in rows.items()}
    assert got == {
        "a.info": ("lcov", 33.33, None, 1, 3, 1, 2, ["src/empty.py"]),
        "b.xml": ("cobertura", 50.0, 25.0, 1, 3, 1, 2, ["src/empty.py"]),
        "c.json": ("istanbul", 33.33, None, 1, 3, 1, 2, ["src/empty.ts"]),
        "d.json": ("istanbul", 100.0, None, 2, 2, 1, 2, []),
        "e.xml": ("cobertura", 0.0, None, 0, 0, 0, 0, []),
        "f.json": ("istanbul", 0.0, None, 0, 0, 0, 0, []),
        "g.bin": ("unknown", 0.0, None, 0, 0, 0, 0, []),
    }


def test_sarif(spark):
    report = {"runs": [{"tool": {"driver": {"name": "Scan", "rules": [{"id": "R1", "shortDescription": {"text": "Path traversal"}, "helpUri": "https://x", "properties": {"tags": ["external/cwe/cwe-022"], "security-severity": "high"}}]}}, "results": [{"ruleId": "R1", "level": "note", "message": {"text": "Bad path, see CVE-2020-12345"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/a.py"}, "region": {"startLine": 7}}}]}, {"level": "error", "message": {"text": "m"}}]}]}
    rows = findings.sarif(texts(spark, s=json.dumps(report), t="[]", u="bad")).orderBy("severity", "title").collect()
    first = next(r for r in rows if r.rule_id == "R1")
    assert (len(rows), first.severity, first.title, first.cwe_ids, first.cve_ids, first.location_path, first.location_line, first.scanner) == (2, "high", "Path traversal", ["CWE-022"], ["CVE-2020-12345"], "src/a.py", 7, "Scan")
    again = findings.sarif(texts(spark, z=json.dumps(report))).collect()
    assert {r.finding_id for r in again} == {r.finding_id for r in rows}
    other = next(r for r in rows if r.rule_id is None)
    assert (other.severity, other.title) == ("high", "m")


def test_nessus(spark):
    report = {"findings": [{"plugin_id": 1, "name": "A", "risk_factor": "Critical", "cve": ["CVE-2021-1111"], "see_also": "u"}], "ReportHost": [{"name": "h1", "ReportItem": [{"pluginID": 2, "pluginName": "B", "severity": 3, "line": 4, "path": "/x"}]}], "hosts": [{"host": "h2", "items": [{"name": "C", "severity": "2"}, 5]}]}
    rows = {r.title: r for r in findings.nessus(texts(spark, n=json.dumps(report))).collect()}
    assert {k: (r.severity, r.rule_id, r.host, r.location_path, r.location_line, r.cve_ids) for k, r in rows.items()} == {
        "A": ("critical", "plugin-1", None, None, None, ["CVE-2021-1111"]), "B": ("high", "plugin-2", "h1", "/x", 4, []), "C": ("medium", None, "h2", None, None, [])}
    assert rows["A"].references == ["u"]


def test_git(spark):
    lines = lambda text: spark.createDataFrame(list(enumerate(text.split("\n"))), "pos int, line string")
    rows = git.changes(lines("M\ta.py\nR100\told.py\tnew.py\nD\tgone.py\n"), lines(" M a.py\nA  b.py\n?? c.py\nR  x -> y")).collect()
    assert {(r.path, r.scope, r.status, r.previous_path, r.staged, r.unstaged) for r in rows} == {
        ("a.py", "since_ref", "modified", None, False, False), ("new.py", "since_ref", "renamed", "old.py", False, False), ("gone.py", "since_ref", "deleted", None, False, False),
        ("a.py", "working_tree", "modified", None, False, True), ("b.py", "working_tree", "added", None, True, False), ("c.py", "working_tree", "untracked", None, False, True), ("y", "working_tree", "renamed", None, True, False)}
    state = only(git.worktree(lines("# branch.oid abc\n# branch.head main\n# branch.ab +2 -1\n1 .M N... 1 1 1 a b src/a.py\n1 M. N... 1 1 1 a b src/b.py\n? new.py")))
    assert state == {"branch": "main", "head_sha": "abc", "ahead": 2, "behind": 1, "dirty_files": 3, "staged_files": 1, "untracked_files": 1, "dirty_paths": ["src/a.py", "src/b.py", "new.py"]}


def test_ledger_and_verdicts(spark):
    text = "intro\n### P1_01M02_003. Broken thing\n- Summary: It breaks\n- Impact: Bad\n- Evidence:\n  - `src/app.py:12` and `pytest tests/x.py` passes\n  - `backend/a.py`\n- Status (2024-01-02): fixed in main\n- Remaining gap: none\n### P2_01M02_004. Other\n- test/unit added\n"
    rows = {r.bug_id: r for r in ledgers.issues(texts(spark, L=text, M="nothing")).collect()}
    a, b = rows["P1_01M02_003"], rows["P2_01M02_004"]
    assert (a.title, a.summary, a.impact, a.doc_status, a.issue_status, a.verified_at, a.notes, a.severity) == ("Broken thing", "It breaks", "Bad", "fixed", "resolved", "2024-01-02", "Remaining gap: none", "P1")
    assert [(e.path, e.line) for e in a.evidence] == [("src/app.py", 12), ("backend/a.py", None)]
    assert len(a.tests_passed) == 1 and (b.doc_status, b.tests_added, b.evidence) == ("open", ["test/unit added"], [])
    found = ledgers.verdicts(texts(spark, v='{"verdicts":[{"id":"x","verdict":"fixed"},{"id":"y"},3]}', w='[{"id":"z"}]', q="oops")).collect()
    assert {(r.path, r.bug_id, r.verdict) for r in found} == {("v", "x", "fixed"), ("v", "y", None), ("w", "z", None)}


def test_artifacts(spark, tmp_path):
    assert artifacts.collection(spark, str(tmp_path / "none.json"), "issues").count() == 0
    put(tmp_path, log_DOT_jsonl='{"activity_id":"1","workspace_id":"w","created_at":"2024-01-01T00:00:00Z"}\n\nbad\n{"activity_id":"2","workspace_id":"w","issue_id":"i","created_at":"2024-01-02T00:00:00Z"}\n')
    log = artifacts.activity_log(spark, str(tmp_path / "log.jsonl"))
    assert [r.activity_id for r in artifacts.latest_activity(log, "w").collect()] == ["2", "1"]
    assert [r.activity_id for r in artifacts.latest_activity(log, "w", issue_id="i").collect()] == ["2"]
    put(tmp_path, runs__a_DOT_json='{"run_id":"a","workspace_id":"w"}', runs__a_DOT_out_DOT_json='{"run_id":"b","workspace_id":"w"}', runs__c_DOT_json="oops")
    assert [r.run_id for r in artifacts.run_records(spark, str(tmp_path / "runs"), "w").collect()] == ["a"]
    line = json.dumps({"file": "a.py", "text": "x", "language": "py", "range": {"start": {"line": 0, "column": 2}, "end": {"line": 1, "column": 0}}})
    assert only(artifacts.structural_matches(spark.createDataFrame([(line,), ("bad",)], "line string")))["line_start"] == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "symbols")
    rows = lambda *x: spark.createDataFrame(list(x), "symbol string, path string")
    sinks.replace_partitions(rows(("a", "p"), ("b", "q")), path, ["path"])
    sinks.replace_partitions(rows(("c", "q")), path, ["path"])
    assert {(r.symbol, r.path) for r in spark.read.parquet(path).collect()} == {("a", "p"), ("c", "q")}
    assert len(sinks.ddl("own")) == len(schemas.TABLES) + 1
    report = only(sinks.markdown(rows(("b", "q"), ("a", "x|y")), "T", ["symbol"]))["markdown"]
    assert report.split("\n") == ["# T", "", "| symbol | path |", "|---|---|", "| a | x\\|y |", "| b | q |"]
