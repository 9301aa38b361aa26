"""Structural search: patterns with holes, matched on the bracket tree of source files.

A file becomes a tree of tokens: what stands in brackets is a group, and in Python so is a
block that is indented further.  A pattern is read likewise; ``$X`` stands for one token
or group (the same everywhere it is named), ``$$$X`` for any number of them, as few as
will do; at a pattern's end it stands for the rest of the statement.  White space and
comments don't count.  Files are rows of their own; those whose text lacks a word of the
pattern are passed over by Spark before any is read as tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import paths

MATCHES = "line_start int, line_end int, matched_text string, meta_variables array<string>"
#: The endings of a language's files.
LANGUAGES = {"python": (".py",), "typescript": (".ts",), "tsx": (".tsx",), "javascript": (".js", ".jsx"), "go": (".go",), "rust": (".rs",)}
CLOSERS = {"(": ")", "[": "]", "{": "}"}
TOKEN = re.compile(
    r"(?P<space>[ \t\f\r]+)|(?P<newline>\n)|(?P<hole>\$\$\$[A-Z_][A-Z0-9_]*|\$[A-Z_][A-Z0-9_]*)|(?P<word>[^\W\d]\w*|\d[\w.]*)"
    r"""|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)|(?P<sign>=>|->|::|:=|[-+*/%=!<>&|]=|&&|\|\||\*\*|.)""",
    re.DOTALL,
)


@dataclass(slots=True)
class Node:
    """A token, or a group with its brackets (a block has none)."""

    text: str
    start: int
    end: int
    children: list[Node] | None = None

    def flat(self) -> list[str | None]:
        """The tokens below, each group followed by None."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node and node.text)
            if node and node.children is not None:
                stack += [None, *reversed(visible(node.children))]
        return out


def visible(nodes: list[Node]) -> list[Node]:
    return [x for x in nodes if x.text != "\n"]


def tokens(text: str, comment: str) -> Iterator[tuple[str, str, int]]:
    at = 0
    while at < len(text):
        if text.startswith(comment, at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            continue
        found = TOKEN.match(text, at)
        yield found.lastgroup, found[0], at
        at = found.end()


def parse(text: str, language: str, blocks: bool = True) -> list[Node]:
    """The tree of a text; a closing bracket that none opens is a token."""
    python = language == "python"
    root = Node("", 0, len(text), [])
    stack: list[tuple[Node, int | None]] = [(root, None)]
    margin, indents = 0, [0]
    fresh = True
    for kind, token, at in tokens(text, "#" if python else "//"):
        if kind == "space":
            margin += len(token) if fresh else 0
            continue
        if kind == "newline":
            if not fresh:
                stack[-1][0].children.append(Node("\n", at, at + 1))
            fresh, margin = True, 0
            continue
        if fresh and python and blocks and all(x.text in ("", "block") for x, _ in stack):
            while margin < indents[-1]:
                indents.pop()
                closed, _ = stack.pop()
                closed.end = visible(closed.children)[-1].end
                # the newline that ended the block's last line ends the statement above it, too
                stack[-1][0].children.append(Node("\n", closed.end, closed.end))
            siblings = visible(stack[-1][0].children)
            if margin > indents[-1] and siblings and siblings[-1].text == ":":
                while stack[-1][0].children[-1].text == "\n":
                    stack[-1][0].children.pop()
                block = Node("block", at, at, [])
                stack[-1][0].children.append(block)
                stack.append((block, margin))
                indents.append(margin)
        fresh = False
        if token in CLOSERS:
            group = Node(token, at, at + 1, [])
            stack[-1][0].children.append(group)
            stack.append((group, None))
        elif token in (")", "]", "}") and any(CLOSERS.get(x.text) == token for x, _ in stack):
            while CLOSERS.get(stack[-1][0].text) != token:
                lost, level = stack.pop()
                lost.end = at
                if level is not None:
                    indents.pop()
            stack.pop()[0].end = at + 1
        else:
            stack[-1][0].children.append(Node(token, at, at + len(token)))
    for lost, _ in reversed(stack[1:]):
        inside = visible(lost.children)
        lost.end = inside[-1].end if inside else lost.end
    return root.children


def matched(pattern: list[Node], nodes: list[Node], at: int, whole: bool, bound: dict[str, list[Node]]) -> tuple[int, dict[str, list[Node]]] | None:
    """Where a match that begins at ``at`` ends, and what its holes hold.

    ``whole``: the match must take all nodes, as in a group.
    """
    if not pattern:
        rest = visible(nodes[at:])
        return None if whole and rest else (at, bound)
    first, more = pattern[0], pattern[1:]
    if first.text.startswith("$$$"):
        if not more:
            end = len(nodes) if whole else statement_end(nodes, at)
            return end, bound | {first.text: nodes[at:end]}
        for end in range(at, len(nodes) + 1):
            if found := matched(more, nodes, end, whole, bound | {first.text: nodes[at:end]}):
                return found
        return None
    while at < len(nodes) and nodes[at].text == "\n" and (whole or bound or at):
        at += 1
    if at >= len(nodes):
        return None
    node = nodes[at]
    if first.text.startswith("$") and first.children is None:
        held = bound.get(first.text)
        if held and held[0].flat() != node.flat():
            return None
        return matched(more, nodes, at + 1, whole, bound | {first.text: [node]})
    if first.text != node.text or (first.children is None) != (node.children is None):
        return None
    if first.children is not None:
        inside = matched(visible(first.children), node.children, 0, True, bound)
        if inside is None:
            return None
        bound = inside[1]
    return matched(more, nodes, at + 1, whole, bound)


def statement_end(nodes: list[Node], at: int) -> int:
    end = at
    while end < len(nodes) and nodes[end].text not in ("\n", ";"):
        end += 1
        if nodes[end - 1].text == "block":
            break
    return end


def matches(text: str, pattern: str, language: str) -> list[tuple[int, int, str, list[str]]]:
    """(line_start, line_end, text, names of single holes) of all matches, by their place."""
    asked, found = visible(parse(pattern, language, blocks=False)), []

    lists = [parse(text, language)]
    while lists:
        nodes = lists.pop()
        for at, node in enumerate(nodes):
            if node.text != "\n" and (result := matched(asked, nodes, at, False, {})) and result[0] > at:
                last = nodes[result[0] - 1]
                names = sorted(k[1:] for k in result[1] if not k.startswith("$$$"))
                found.append((text.count("\n", 0, node.start) + 1, text.count("\n", 0, last.end) + 1, text[node.start : last.end], names))
            if node.children:
                lists.append(node.children)
    return sorted(found)


@F.udtf(returnType=MATCHES)
class Searched:
    """The matches of a pattern in a file."""

    def eval(self, text: str, pattern: str, language: str) -> Iterator[tuple]:
        yield from matches(text, pattern, language)


def search(tree: DataFrame, pattern: str, language: str, glob: str | None = None, most: int | None = None) -> DataFrame:
    """(path, language, line_start, line_end, matched_text, meta_variables): matches of the
    pattern in the language's files of (path, text), below a glob; with ``most``, the first
    by path and line."""
    if not pattern.strip():
        raise ValueError("pattern is required")
    path, text = F.col("path"), F.col("text")
    own = tree.where(text.isNotNull() & path.rlike("(" + "|".join(re.escape(e) for e in LANGUAGES[language]) + ")$"))
    if glob:
        own = own.where(F.rlike(path, paths.glob_pattern(F.lit(glob))))
    for word in {t for kind, t, _ in tokens(pattern, "\0") if kind == "word"}:
        own = own.where(text.contains(word))
    own = own.select("path", "text", F.lit(pattern).alias("pattern"), F.lit(language).alias("language"))
    found = own.lateralJoin(Searched(text.outer(), F.col("pattern").outer(), F.col("language").outer()))
    found = found.select("path", "language", "line_start", "line_end", "matched_text", "meta_variables")
    return found if most is None else found.orderBy("path", "line_start", "line_end", "matched_text").limit(most)
