from collections import Counter

from quarrylens.llm import license_scan
from quarrylens.llm.decontaminate import WordHashes


def brute_force(template, text, least):
    """The best Dice of any passage of a text."""
    words = [w for w in WordHashes().of(text)[0].tolist()]
    own = WordHashes().of(template)[0].tolist()
    bag = Counter(zip(own, own[1:]))
    grams = list(zip(words, words[1:]))
    best = 0.0
    for a in range(len(grams)):
        for b in range(a + 1, len(grams) + 1):
            common = (Counter(grams[a:b]) & bag).total()
            best = max(best, 2 * common / (bag.total() + b - a))
    return best if best >= least else None


def test_best_passage_equals_brute_force():
    t = license_scan.TEMPLATES
    texts = [
        "Some words. Licensed under the Apache License, Version 2.0. More words",
        "licensed under the new Apache License version 2.0 and released under MIT License",
        "the license of the work is licensed under the GNU General Public version 3 license",
        "of the of the of the under the license",
        t["ISC:text"] + " and so on",
    ]
    for text in texts:
        words = WordHashes().of(text)[0]
        for name, template in t.items():
            got = dict((n, d) for n, d, *_ in license_scan.Templates.of({name: template}).best(words, 0.7)).get(name)
            assert got == brute_force(template, text, 0.7), (name, text)


def test_rows(spark):
    rows = [(1, "Abc.\nReleased under the MIT License.", "x"), (2, None, "x"), (3, "", "x"), (4, "!!", "x"), (1, "Abc.\nReleased under the MIT License.", "x"), (None, license_scan.TEMPLATES["MIT:text"], "x"), (6, "plain words " * 500, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = license_scan.scan(df).collect()
    assert sorted((r.doc_id or 0, r.license, r.dice) for r in got) == [(0, "MIT:text", 1.0), (1, "MIT:line", 1.0), (1, "MIT:line", 1.0)]
    row = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][row.start : row.end] == "Released under the MIT License."
    assert license_scan.scan(df.limit(0)).count() == 0


def labels(text):
    """What ``scan`` would choose first for a text."""
    found = license_scan.Templates.of(license_scan.TEMPLATES).ranked(WordHashes().of(text)[0], license_scan.LEAST_DICE)
    return found[0][0].partition(":")[0]


def test_neighbouring_licences_keep_their_own_names():
    gpl = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the "
        "Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
    )
    assert labels(gpl.format("GNU General Public License", 2)) == "GPL-2.0"
    assert labels(gpl.format("GNU General Public License", 3)) == "GPL-3.0"
    assert labels(gpl.format("GNU Lesser General Public License", "2.1")) == "LGPL-2.1"
    assert labels(gpl.format("GNU Affero General Public License", 3)) == "AGPL-3.0"
    bsd = license_scan.TEMPLATES["BSD-3-Clause:text"]
    assert labels(bsd[: bsd.index(" Neither")]) == "BSD-2-Clause" and labels(bsd) == "BSD-3-Clause"
    assert labels(bsd[: bsd.index(" Neither")] + license_scan.BSD_END) == "BSD-2-Clause"
    assert labels("This work is licensed under the GNU General Public License, version 2.") == "GPL-2.0"
    for line in ("CC BY 3.0", "CC BY-ND 4.0", "CC BY-NC-SA 2.5", "CC BY 4.0", "CC BY-SA"):
        assert labels(f"Licensed under {line}.") == line.replace(" ", "-"), line
