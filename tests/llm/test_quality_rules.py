import random
import re
from collections import Counter

from quarrylens.llm import quality_rules

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_force(text):
    data = (text or "").encode()
    words = WORD.findall(data)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\x1cy\x85z\xa0w\n\nx\x1cy", "é# é#\né# é#"]
    texts += ["".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "#", "é", "\x0b", " "]) for _ in range(rng.randint(1, 150))) for _ in range(400)]
    for text in texts:
        assert quality_rules.measured(text)[0] == brute_force(text), repr(text)


def data(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(8))
    junk = lambda: "\n".join(" ".join(word().upper() + rng.choice(["!!", "%%%", "$$$"]) for _ in range(12)) for _ in range(8))
    docs = [(i, good() if i % 3 else junk(), "extra") for i in range(240)] + [(900, None, "e"), (901, "", "e"), (902, "too short", "e"), (None, good(), "e"), (1, good(), "e")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_content_stays_and_junk_goes(spark):
    docs, labels = data(spark)
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.judge(docs, model).collect()
    assert len(rows) == docs.count()
    held_out = [r for r in rows if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 240]
    assert all(r.kept == (r.doc_id % 3 > 0) for r in held_out)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (900, 901, 902))
    kept = quality_rules.keep(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)


def test_empty_tables(spark):
    docs, labels = data(spark)
    model = quality_rules.fit(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, model).collect())
    assert quality_rules.judge(docs.limit(0), model).count() == 0


def test_lines_of_one_document_get_labels_of_their_own(spark):
    docs, labels = data(spark)
    again = docs.where("doc_id % 3 > 0 and doc_id < 240").selectExpr("doc_id + 1000 as doc_id", "text || '\n' || split_part(text, '\n', 1) || '\n' || split_part(text, '\n', 2) as text", "kept")
    model = quality_rules.fit(docs.union(again), labels.union(again.selectExpr("doc_id", "1", "0")))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(6)]
    junk = [" ".join(word().upper() + "%%%" for _ in range(12)) for _ in range(2)]
    mixed = spark.createDataFrame([(1, "\n".join(good + junk)), (2, "\n".join(good[:1] + junk * 3)), (3, "\n".join(good + good[:2]))], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.judge(mixed, model).collect()}
    assert (rows[1].n_lines, rows[1].n_boilerplate_lines, rows[1].kept) == (8, 2, True)
    assert rows[2].n_boilerplate_lines >= 6 and not rows[2].kept
    assert rows[3].n_boilerplate_lines == 2 and rows[3].kept


def test_odd_labels_are_left_out(spark):
    docs, labels = data(spark)
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 7, 0), (0, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(docs, labels.union(odd).union(labels))
    assert {r.doc_id for r in quality_rules.judge(docs, model).where("kept and doc_id < 240").collect()} >= {i for i in range(2, 240) if i % 3}
