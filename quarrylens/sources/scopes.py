"""Symbols of source files with the lines they span and the scope that encloses them.

One pass over a file's lines with a stack of open symbols: in languages of indentation a
symbol ends before the first line that isn't indented further, in others where the braces
that it opened are closed.  Braces in strings and line comments don't count.  A symbol
without a body ends on its own line.  Each file is a row of its own, so files of any
number are read by as many tasks; a file's lines pass once, and what is kept is its stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import paths

FIELDS = "symbol string, kind string, line_start int, line_end int, enclosing_scope string"
#: Kinds that are a scope for what stands in them.
SCOPES = ("class", "type", "module")
#: Endings of the languages in which indentation makes a block.
INDENTED = (".py",)
RULES = [(re.compile(pattern), kind) for pattern, kind in paths.SYMBOL_RULES]
#: What hides braces: strings that end on their line, and line comments.
HIDDEN = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$"""
UNSEEN = re.compile(HIDDEN)


def symbol_of(line: str) -> tuple[str, str] | None:
    for pattern, kind in RULES:
        if found := pattern.search(line):
            return found[1], kind
    return None


class Open:
    """A symbol whose end hasn't come: its row, and the depth or indentation around it."""

    def __init__(self, row: list, level: int):
        self.row, self.level, self.has_body = row, level, False


def enclosing(stack: list[Open]) -> str | None:
    return next((x.row[0] for x in reversed(stack) if x.row[1] in SCOPES), None)


def by_indentation(lines: list[str]) -> list[list]:
    rows, stack, last = [], [], 0
    for number, line in enumerate(lines, 1):
        body = line.lstrip(" \t")
        if not body.strip():
            continue
        level = len(line) - len(body)
        # a closing bracket goes on with what its opening line began
        while stack and level <= stack[-1].level and body[0] not in ")]}":
            stack.pop().row[3] = last
        if found := symbol_of(line):
            rows.append([*found, number, number, enclosing(stack)])
            stack.append(Open(rows[-1], level))
        last = number
    for x in stack:
        x.row[3] = last
    return rows


def by_braces(lines: list[str]) -> list[list]:
    rows, stack, depth = [], [], 0
    for number, line in enumerate(lines, 1):
        if found := symbol_of(line):
            if stack and not stack[-1].has_body:
                stack.pop()
            rows.append([*found, number, number, enclosing(stack)])
            stack.append(Open(rows[-1], depth))
        for brace in re.findall("[{}]", UNSEEN.sub("", line)):
            if brace == "{":
                if stack and not stack[-1].has_body and depth == stack[-1].level:
                    stack[-1].has_body = True
                depth += 1
            else:
                depth -= 1
                while stack and (depth < stack[-1].level or (stack[-1].has_body and depth == stack[-1].level)):
                    closed = stack.pop()
                    closed.row[3] = number if closed.has_body else closed.row[3]
    for x in stack:
        x.row[3] = len(lines) if x.has_body else x.row[3]
    return rows


@F.udtf(returnType=FIELDS)
class Scoped:
    """The symbols of a file."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        lines = re.split(r"\r?\n", text)
        if lines[-1] == "":
            lines.pop()
        yield from map(tuple, (by_indentation if path.endswith(INDENTED) else by_braces)(lines))


def symbols(tree: DataFrame, most: int = 32) -> DataFrame:
    """(path, symbol, kind, line_start, line_end, enclosing_scope): the first ``most``
    symbols of each scanned file of (path, text)."""
    own = tree.where(paths.is_scanned(F.col("path"), "target") & F.col("text").isNotNull()).select("path", "text")
    # a file without any defining word has no symbols: no Python for it
    own = own.where(F.col("text").rlike(r"(?m)^\s*(?:export\s+|pub\s+)?(?:def|class|func|function|interface|type|struct|enum|trait|fn)\s"))
    found = own.lateralJoin(Scoped(F.col("path").outer(), F.col("text").outer()))
    listed = found.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("line_start", "symbol", "kind", "line_end", "enclosing_scope"))), 1, most).alias("own"))
    return listed.select("path", F.inline("own")).select("path", "symbol", "kind", "line_start", "line_end", "enclosing_scope")
