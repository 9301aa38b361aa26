"""Path predicates, roles and code patterns, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.functions.arrays import let

#: Directories that no scan enters; the repository map also skips ``target``.
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".turbo",
    ".next", "node_modules", "dist", "build", "coverage", ".coverage", "tmp", "vendor", "third_party", "research",
)
#: Skipped below the root only.
SKIPPED_BELOW_ROOT = ("backend/data", "frontend/dist")
#: File names and extensions that are scanned.
SCANNED_NAMES = ("Dockerfile", "Justfile", "Makefile", "Procfile")
SCANNED_EXTENSIONS = (
    "bash", "c", "cc", "cpp", "cjs", "cs", "css", "go", "h", "hpp", "html", "java", "js", "jsx", "kt", "kts", "mjs", "php",
    "py", "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx", "yaml", "yml", "zsh",
)
#: Roles of well-known files.
KEY_FILES = {
    "AGENTS.md": "guide", "CONVENTIONS.md": "guide", "README.md": "guide", "pyproject.toml": "config", "package.json": "config",
    "tsconfig.json": "config", "vite.config.ts": "config", "vite.config.js": "config", "backend/app/main.py": "entry",
    "backend/app/service.py": "entry", "frontend/src/App.tsx": "entry",
}
#: Signals that a line of code may give: kind, severity, title, patterns.
SIGNAL_RULES = (
    ("annotation", "P2", "Backlog annotation in code", (r"(?:^|\s)(?:#|//|/\*|\*)\s*(?:TODO|FIXME|BUG|HACK|XXX)\b", r"(?:^|\s)<!--\s*(?:TODO|FIXME|BUG|HACK|XXX)\b")),
    ("exception_swallow", "P1", "Swallowed generic exception", (r"except Exception:\s*(pass|continue|return None|return)",)),
    ("not_implemented", "P2", "Not implemented code path", (r"^\s*raise\s+NotImplemented(?:Error)?(?:\(|$)", r":\s*raise\s+NotImplemented(?:Error)?(?:\(|$)")),
    ("test_marker", "P3", "Deferred or skipped test coverage", (r"^\s*@?pytest\.mark\.(?:xfail|skip)\b", r"^\s*@unittest\.skip\b", r"\b(?:it|test)\.skip\(")),
)
#: What a line defines, the first that fits counts.
SYMBOL_RULES = (
    (r"^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
    (r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b", "class"),
    (r"^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
    (r"^\s*(?:export\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\b", "function"),
    (r"^\s*(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b", "class"),
    (r"^\s*(?:export\s+)?(?:interface|type)\s+([A-Za-z_][A-Za-z0-9_]*)\b", "type"),
    (r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)\b", "type"),
    (r"^\s*(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return let(F.split(text, r"\r?\n"), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def fed_lines(text: Column) -> Column:
    """Lines less one final line feed, at least one: an empty text is one empty line, and
    a carriage return before that feed belongs to its line."""
    return F.split(F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), r"\r?\n")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_skipped(path: Column, *more: str) -> Column:
    """Whether a part of the path, or its place below the root, is one that scans skip."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    plain = F.array_join(parts, "/")
    below = F.lit(False)
    for one in SKIPPED_BELOW_ROOT:
        below = below | (plain == one) | plain.startswith(one + "/")
    return F.exists(parts, lambda p: p.isin(*SKIPPED_DIRS, *more)) | below


def is_scanned(path: Column, *more: str) -> Column:
    """Whether a scan reads this file; extensions count in lower case only."""
    name = file_name(path)
    # a leading dot opens no extension
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return ~is_skipped(path, *more) & (name.isin(*SCANNED_NAMES) | extension.isin(*SCANNED_EXTENSIONS))


def map_role(path: Column) -> Column:
    """guide, config, entry, test, source or null, as the repository map has them."""
    pairs = [F.lit(x) for item in KEY_FILES.items() for x in item]
    low = F.lower(path)
    test = low.contains("/tests/") | low.startswith("tests/") | file_name(low).startswith("test_")
    return F.coalesce(F.try_element_at(F.create_map(*pairs), path), F.when(test, "test").when(is_scanned(path, "target"), "source"))


def signals_of(path: Column, line_no: Column, line: Column) -> Column:
    """The signals of one line, an array of (kind, severity, title, summary, fingerprint)."""
    said = strip(line)
    found = []
    for kind, severity, title, patterns in SIGNAL_RULES:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | line.rlike(p)
        mark = F.sha1(F.concat_ws(":", F.lit(kind), path, line_no.cast("string"), said))
        found.append(F.when(hit, F.struct(
            F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.left(said, F.lit(280)).alias("summary"), mark.alias("fingerprint"))))
    return F.array_compact(F.array(*found))


def symbol_of(line: Column) -> Column:
    """(symbol, kind) that the line defines, or null."""
    tries = []
    for pattern, kind in SYMBOL_RULES:
        name = F.regexp_extract(line, pattern, 1)
        tries.append(F.when(name != "", F.struct(name.alias("symbol"), F.lit(kind).alias("kind"))))
    return F.coalesce(*tries)


def import_lines(lines: Column) -> Column:
    """How many lines import something, by how they begin."""
    def imports(line: Column) -> Column:
        said = F.regexp_replace(line, r"^\s+", "")
        return said.rlike(r"^(import |from |use |mod |require\()") | said.startswith("const ") & said.contains("require(")

    return F.size(F.filter(lines, imports))


def path_tokens(path: Column, most: int = 16) -> Column:
    """Distinct lower-case identifiers of the path of three letters or more, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(path), F.lit("([a-z0-9_]{3,})"), 1)), 1, most)


def evidence_of(text: Column) -> Column:
    """(path, line) of each back-quoted reference that looks like a file."""
    quoted = F.regexp_extract_all(text, F.lit(r"`([^`:]+(?::\d+)?)`"), 1)

    def split(ref: Column) -> Column:
        return F.struct(F.substring_index(ref, ":", 1).alias("path"), F.regexp_extract(ref, r":(\d+)$", 1).try_cast("int").alias("line"))

    def is_file(ref: Column) -> Column:
        low = strip(F.lower(ref["path"]))
        return ~low.contains(" ") & ~low.rlike("^(python|pytest|npm )") & (low.contains("/") | file_name(low).contains("."))

    return F.filter(F.transform(quoted, split), is_file)


def git_status(code: Column) -> Column:
    """A change's name from git's letters."""
    return (
        F.when(code.startswith("A"), "added").when(code.startswith("D"), "deleted").when(code.startswith("R"), "renamed").when(code.startswith("C"), "copied")
        .when(code.contains("M"), "modified").when(code.contains("?"), "untracked").otherwise("unknown")
    )


def taxonomy_ids(texts: Column, kind: str, most: int = 12) -> Column:
    """Distinct CWE or CVE ids of an array of texts, upper case, first seen first."""
    pattern = {"cwe": r"(CWE-\d+)", "cve": r"(CVE-\d{4}-\d+)"}[kind]
    return F.slice(F.array_distinct(F.regexp_extract_all(F.upper(F.array_join(texts, "\n", "")), F.lit(pattern), 1)), 1, most)


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a path glob: ``**`` crosses directories, ``*`` and ``?`` don't."""
    out = F.regexp_replace(glob, r"([.+^$()|{}\[\]\\])", r"\\$1")
    out = F.regexp_replace(out, r"\*\*/", "\u0001")
    out = F.regexp_replace(out, r"\*\*", "\u0002")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def go_role(path: Column) -> Column:
    """guide, test, config, entry, source or unknown, by the path's letters alone: a ladder
    of its own, beside ``map_role``."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".md"), "guide").when(low.contains("test") | low.endswith(".spec.ts"), "test")
        .when(low.rlike(r"\.(json|toml|yaml|yml)$"), "config").when(low.contains("main.") | low.contains("app."), "entry")
        .when(low.rlike(r"\.(py|go|rs|ts|tsx|js|jsx)$"), "source").otherwise("unknown")
    )


def explained_role(path: Column) -> Column:
    """guide, doc, config, test, source, asset or unknown: the ladder of explanations."""
    name, folders = F.lower(file_name(path)), F.split(path, "/")
    within = lambda *dirs: F.arrays_overlap(folders, F.array(*map(F.lit, dirs)))
    return (
        F.when(name.isin("agents.md", "conventions.md", "readme.md"), "guide").when(path.startswith("docs/") | name.endswith(".md"), "doc")
        .when(name.isin("package.json", "pyproject.toml", "cargo.toml", "makefile", "dockerfile") | name.rlike(r"\.(yaml|yml|json|toml)$"), "config")
        .when(within("test", "tests", "__tests__") | name.contains("test_"), "test").when(within("src", "app", "api"), "source")
        .when(name.rlike(r"\.(png|jpg|jpeg|gif|svg)$"), "asset").otherwise("unknown")
    )


def is_test_like(path: Column) -> Column:
    low = F.lower(path)
    name = file_name(low)
    return F.concat(F.lit("/"), low, F.lit("/")).rlike("/(tests|__tests__)/") | name.startswith("test_") | name.contains(".test.") | name.contains(".spec.")


def normal_path(path: Column) -> Column:
    """The path below its root, ``.`` and ``..`` resolved; null where it is blank, is the
    root itself or escapes from it."""
    parts = F.filter(F.split(F.trim(path), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(done: Column, part: Column) -> Column:
        up, empty = part == "..", F.size(done["kept"]) == 0
        kept = F.when(up & empty, done["kept"]).when(up, F.slice(done["kept"], F.lit(1), F.greatest(F.size(done["kept"]) - 1, F.lit(0)))).otherwise(F.concat(done["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (done["out"] | up & empty).alias("out"))

    done = F.aggregate(parts, start, step)
    return F.when(~done["out"] & (F.size(done["kept"]) > 0), F.array_join(done["kept"], "/"))


def index_score(path: Column, surface: str) -> Column:
    """How worthy a path is of the index, by role, place, name and surface."""
    low = F.lower(path)
    name = file_name(low)
    given = lambda n, c: F.when(c, n).otherwise(0)
    marker = low.rlike("cli|terminal|runtime|server|agent|command")
    role = go_role(path)
    score = (
        F.when(role == "entry", 80).when(role == "source", 60).when(role == "config", 30).when(role == "guide", 20).when(role == "test", -80).otherwise(0)
        + given(35, low.rlike("^(backend|api|cmd|cli|scripts|src)/")) + given(25, low.rlike(r"cli\.py|__main__\.py|/main\.py|/service\.py|/commands/|/command/|/bin/")) + given(12, marker)
        + given(18, name.isin("pyproject.toml", "package.json", "cargo.toml", "makefile", "justfile", "readme.md", "agents.md"))
        + given(-60, F.concat(F.lit("/"), low, F.lit("/")).contains("/tests/") | name.startswith("test_") | name.contains(".test.") | name.contains(".spec."))
        + given(5, low.rlike(r"\.(md|json|toml|yaml|yml)$"))
    )
    if surface in ("cli", "all"):
        score = score + given(12, marker)
    if surface == "web":
        score = score + given(32, low.rlike("frontend/|web/|ui/|src/app|src/pages|src/components"))
    return score
