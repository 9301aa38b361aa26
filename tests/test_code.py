"""Scopes of symbols and structural search, against plain searches of their own."""

import random
import re

import pytest

from quarrylens.sources import scopes, structural

PY = "import os\n\n@deco\nclass A(B):\n  x = {\n  1}\n\n  def f(self):\n    def inner(y):\n      return y\n\n    return inner\n  class C:\n    def g(self): pass\n# end\ndef h(\n  a,\n):\n  return a\n\n"
TS = "export class View {\n  m() { return '}' }\n  function inner() {\n    if (a) { b } else { c }\n  }\n}\ntype X = string\ninterface Y {\n}\nfunction one() { return 1 } // }\nfunction open() {\n"


def test_spans_and_scopes(spark):
    tree = spark.createDataFrame([("src/a.py", PY), ("src/b.ts", TS), ("src/none.py", None), ("src/empty.py", ""), ("x.bin", "class Z:\n")], "path string, text string")
    got = {(r.path[-4], r.symbol): (r.kind, r.line_start, r.line_end, r.enclosing_scope) for r in scopes.symbols(tree).collect()}
    assert got == {
        ("a", "A"): ("class", 4, 14, None), ("a", "f"): ("function", 8, 12, "A"), ("a", "inner"): ("function", 9, 10, "A"), ("a", "C"): ("class", 13, 14, "A"), ("a", "g"): ("function", 14, 14, "C"),
        ("a", "h"): ("function", 16, 19, None),
        ("b", "View"): ("class", 1, 6, None), ("b", "inner"): ("function", 3, 5, "View"), ("b", "X"): ("type", 7, 7, None), ("b", "Y"): ("type", 8, 9, None), ("b", "one"): ("function", 10, 10, None), ("b", "open"): ("function", 11, 11, None),
    }
    assert len(scopes.symbols(tree, 2).collect()) == 4


def test_indented_spans_equal_a_search_by_lines():
    rng = random.Random(6)
    for _ in range(300):
        lines = [rng.choice(["", "  " * rng.randint(0, 4) + rng.choice(["x = 1", f"def f{k}(a):", f"class C{k}:", "pass"])]) for k in range(rng.randint(1, 25))]
        margin = lambda x: len(x) - len(x.lstrip())
        expected = []
        for k, line in enumerate(lines):
            if found := re.match(r"\s*(def|class) (\w+)", line):
                after = [j for j in range(k + 1, len(lines)) if lines[j].strip()]
                stop = next((j for j in after if margin(lines[j]) <= margin(line)), len(lines))
                end = max([j for j in after if j < stop], default=k)
                level, scope = margin(line), None
                for j in range(k - 1, -1, -1):
                    if lines[j].strip() and margin(lines[j]) < level:
                        level = margin(lines[j])
                        if own := re.match(r"\s*class (\w+)", lines[j]):
                            scope = own[1]
                            break
                expected.append([found[2], "function" if found[1] == "def" else "class", k + 1, end + 1, scope])
        assert scopes.by_indentation(lines) == expected


def brute_force(asked, nodes):
    """All (start, end, holes) of a pattern over every list of siblings, by trying all
    lengths of every hole."""

    def ways(pattern, own, whole):
        if not pattern:
            return [(0, {})] if not whole or not own else []
        first, out = pattern[0], []
        if first.text.startswith("$$$"):
            if len(pattern) == 1:
                stop = next((k for k, x in enumerate(own) if x.text == ";"), len(own))
                n = len(own) if whole else stop
                return [(n, {first.text: own[:n]})]
            return [(n + m, {first.text: own[:n]} | b) for n in range(len(own) + 1) for m, b in ways(pattern[1:], own[n:], whole)]
        if not own:
            return []
        if first.text.startswith("$"):
            return [(1 + m, {first.text: own[:1]} | b) for m, b in ways(pattern[1:], own[1:], whole) if first.text not in b or b[first.text][0].flat() == own[0].flat()]
        if first.text != own[0].text or (first.children is None) != (own[0].children is None):
            return []
        inner = [(0, {})] if first.children is None else ways(first.children, own[0].children, True)
        return [(1 + m, a | b) for _, a in inner for m, b in ways(pattern[1:], own[1:], whole) if all(a[k][0].flat() == b[k][0].flat() for k in a.keys() & b.keys() if not k.startswith("$$$"))]

    found, lists = set(), [nodes]
    while lists:
        own = lists.pop()
        for at in range(len(own)):
            if any(n for n, _ in ways(asked, own[at:], False)):
                found.add(own[at].start)
        lists += [x.children for x in own if x.children]
    return found


@pytest.mark.parametrize("pattern", ["f($A)", "f($A, $A)", "f($$$A, b, $$$B)", "$A + $A", "a $$$X b", "( $$$X ) [ $Y ]", "f($$$A) { $$$B }", "$A = f($B)", "a; $$$X"])
def test_matches_equal_brute_force(pattern):
    rng = random.Random(pattern)
    asked = structural.visible(structural.parse(pattern, "typescript", False))

    def text(depth):
        return " ".join(rng.choice(["a", "b", "f", "+", "=", ",", ";", "f({})", "({})", "[{}]", "{{{}}}", "f({}) {{ {} }}"]).format(*[text(depth - 1) if depth else "a"] * 2) for _ in range(rng.randint(1, 6)))

    for _ in range(150):
        code = text(2)
        got = {start for start in starts(code, pattern)}
        assert got == brute_force(asked, structural.parse(code, "typescript"))


def starts(code, pattern):
    """Where matches begin, by placing each on a line of its own."""
    asked, found, lists = structural.visible(structural.parse(pattern, "typescript", False)), [], [structural.parse(code, "typescript")]
    while lists:
        nodes = lists.pop()
        for at in range(len(nodes)):
            if (result := structural.matched(asked, nodes, at, False, {})) and result[0] > at:
                found.append(nodes[at].start)
        lists += [x.children for x in nodes if x.children]
    assert len(found) == len(structural.matches(code, pattern, "typescript"))
    return found


def test_search(spark):
    tree = spark.createDataFrame([("src/a.py", PY), ("src/b.ts", TS), ("lib/c.py", "def f(x): return x\n"), ("lib/d.py", None), ("lib/e.py", "x" * 50_000 + "(" * 50_000)], "path string, text string")
    found = structural.search(tree, "def $F($$$ARGS): $$$BODY", "python").collect()
    assert sorted((r.path, r.line_start, r.line_end, r.meta_variables) for r in found) == [("lib/c.py", 1, 1, ["F"]), ("src/a.py", 8, 12, ["F"]), ("src/a.py", 9, 10, ["F"]), ("src/a.py", 14, 14, ["F"]), ("src/a.py", 16, 19, ["F"])]
    assert [r.path for r in structural.search(tree, "def $F($X): return $X", "python", "lib/**").collect()] == ["lib/c.py"]
    assert structural.search(tree, "def $F($$$A): $$$B", "python", most=2).count() == 2
    (view,) = structural.search(tree, "class View { $$$BODY }", "typescript").collect()
    assert (view.line_start, view.line_end, view.meta_variables) == (1, 6, [])
    with pytest.raises(ValueError, match="pattern is required"):
        structural.search(tree, " ", "python")
