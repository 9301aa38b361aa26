"""Text, path and token helpers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query does not search for.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this")
#: Directories that are not scanned.
IGNORED_DIRS = (".git", "node_modules", ".venv", "venv", "dist", "build", "target", "__pycache__", "research", "vendor")
#: Languages by file extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust",
    "java": "java", "sh": "bash", "html": "html", "css": "css", "yaml": "yaml", "yml": "yaml", "json": "json",
}


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case identifiers of ``least`` letters or more, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z0-9_]{{{least},}})"), 1))


def query_tokens(text: Column) -> Column:
    """``tokens`` without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def matched(terms: Column, hay: Column) -> Column:
    """The terms that are substrings, in their order."""
    return F.filter(terms, lambda t: F.contains(F.lower(hay), t))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_ignored(path: Column) -> Column:
    """Whether any directory of the path is one of the ignored ones."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRS)))


def plain_path(path: Column) -> Column:
    """Without leading dots and slashes, taken as a set of characters."""
    return F.regexp_replace(path, r"^[./]+", "")


def fix_status(text: Column) -> Column:
    """open, fixed, partial or resolved, by the first words that say so."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.contains("already fixed") | low.startswith("fixed"), "fixed")
        .when(low.contains("partial"), "partial")
        .when(low.contains("resolved"), "resolved")
        .otherwise("open")
    )


def target_kind(name: Column) -> Column:
    """test, lint, build, dev, verify or other, by what the name contains."""
    low = F.lower(name)
    return (
        F.when(low.contains("test"), "test").when(low.contains("lint"), "lint").when(low.contains("build"), "build")
        .when(low.contains("dev") | low.contains("serve"), "dev").when(low.contains("check") | low.contains("verify"), "verify").otherwise("other")
    )


def severity(text: Column) -> Column:
    """A severity from a name or a number; other numbers in words fall to info."""
    low, number = F.lower(F.trim(text)), F.try_cast(text, "int") if hasattr(F, "try_cast") else text.try_cast("int")
    return (
        F.when(low.isin("critical", "blocker", "p0") | (number == 4), "critical")
        .when(low.isin("high", "error", "p1") | (number == 3), "high")
        .when(low.isin("medium", "moderate", "warning", "p2") | (number == 2), "medium")
        .when(low.isin("low", "note", "p3") | (number == 1), "low")
        .otherwise("info")
    )


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters, and how many were left out."""
    rest = (F.length(text) - most).cast("string")
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("... ["), rest, F.lit(" more]"))).otherwise(text)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 12 hex digits of the sha1 of lower-cased, trimmed parts."""
    return F.concat(F.lit(prefix), F.left(F.sha1(F.concat_ws("|", *(F.lower(F.trim(p.cast("string"))) for p in parts))), F.lit(12)))


def known_status(status: Column) -> Column:
    """The status as it is, if it is one of the index; else null."""
    return F.when(F.trim(status).isin("fresh", "stale", "dirty_provisional", "no_baseline", "blocked"), status)


def derivation(source: Column) -> Column:
    """lexical, structural or hybrid; parsers are structural, anything else lexical."""
    own = F.trim(source)
    return F.when(own.isin("lexical", "structural", "hybrid"), source).when(own.isin("rust_semantic_core", "tree_sitter", "regex"), "structural").otherwise("lexical")


def surface(name: Column) -> Column:
    """cli, web or all; null for a surface that isn't known."""
    own = F.lower(F.trim(name))
    return F.when(own.isin("cli", "web", "all"), own)


def json_number(payload: Column, path: str) -> Column:
    """A whole number from a JSON value: fractions are cut, what is no number is null."""
    return F.get_json_object(payload, path).try_cast("double").try_cast("int")


def is_schema_name(name: Column) -> Column:
    return F.trim(name).rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def redacted_dsn(dsn: Column) -> Column:
    """An address with its password masked; ``<configured>`` if it is none, null if blank."""
    own = F.trim(dsn)
    scheme, user, rest = (F.regexp_extract(own, r"^([a-z][a-z0-9+.-]*)://(?:([^:@/]+)(?::[^@/]*)?@)?([^/@]+.*)$", k) for k in (1, 2, 3))
    masked = F.concat(scheme, F.lit("://"), F.when(user == "", "user").otherwise(user), F.lit(":***@"), rest)
    return F.when(own == "", None).when(scheme == "", "<configured>").otherwise(masked)


def statements(sql: Column) -> Column:
    """The statements of an SQL text, split at semicolons as they stand."""
    return F.filter(F.transform(F.split(sql, ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def table_names(sql: Column) -> Column:
    """Sorted distinct names of the tables that an SQL text creates, without schemas."""
    found = F.regexp_extract_all(sql, F.lit(r"(?i)create table (?:if not exists )?(?:[a-z_][a-z0-9_]*\.)?([a-z_][a-z0-9_]*)"), 1)
    return F.array_sort(F.array_distinct(found))
