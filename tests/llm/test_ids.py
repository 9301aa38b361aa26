"""Ids, nulls, repeated rows and long texts through every operator alike."""

import pytest
import public_tokenizers

from quarrylens.llm import bpe, decontaminate, language_model, license_scan, near_dedup, quality_rules, repeated_spans, secret_scan, token_files, toxicity

BIG = 2**53 + 1
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PASSAGE = " ".join(f"unusual{k} wording{k * 7}" for k in range(30))
LICENCE = "Licensed under CC BY-NC 4.0."


def documents(spark):
    text = f"{LICENCE} {PASSAGE} password: hunter2hunter2"
    rows = [(BIG, text, "a"), (None, text, "b"), (BIG, text, "c"), (BIG, "other words of the same id " * 12, "d"), (-BIG, None, "e"), (7, "", "f"), (8, "word " * 300_000, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (BIG, 0, 1), (7, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(BIG, PASSAGE), (None, PASSAGE)], "item_id long, text string")


EVERY = {
    "op1": lambda s, d: secret_scan.scan(d),
    "op2": lambda s, d: token_files.read(s, token_files.write(d, WORD_BPE)),
    "op3": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "op5": lambda s, d: near_dedup.classes(d, 4),
    "op6": lambda s, d: quality_rules.judge(d, quality_rules.fit(d, labels(s))),
    "op7": lambda s, d: repeated_spans.remove(d),
    "op9": lambda s, d: language_model.score(d),
    "op10": lambda s, d: bpe.digests(d, WORD_BPE),
}


@pytest.mark.parametrize("name", EVERY)
def test_each_row_keeps_its_id(spark, name):
    rows = EVERY[name](spark, documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [BIG, None, BIG, BIG, -BIG, 7, 8]))
    if name in ("op3", "op9"):
        assert all(r.held_out is not None for r in rows)


def test_matches_keep_their_ids(spark):
    found = decontaminate.matches(documents(spark), benchmark(spark)).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == sorted([(str(BIG), BIG), (str(BIG), BIG), ("None", BIG)])
    found = license_scan.scan(documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted([str(BIG), str(BIG), "None"])


def test_filters_pass_every_column_on(spark):
    d = documents(spark)
    clean = decontaminate.clean(d, benchmark(spark))
    assert clean.columns == d.columns and sorted(r.score for r in clean.collect()) == ["d", "e", "f", "g"]
    kept = quality_rules.keep(d, quality_rules.fit(d, labels(spark).limit(0)))
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} <= {BIG, None}
    left = near_dedup.dedupe(d)
    assert left.schema == d.schema and sorted(r.score for r in left.collect()) == ["a", "b", "c", "d", "e", "f", "g"]


def test_links_go_by_text_where_ids_repeat(spark):
    a = " ".join(f"a{k}" for k in range(30))
    b = " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (9, b + " word"), (10, b), (11, a + " end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.classes(d, 4).collect())
    assert got == [(5, 5, True), (5, 5, True), (9, 5, False), (10, 5, False), (11, 5, False)]
    assert sorted(r.text for r in near_dedup.dedupe(d).collect()) == [a, b]
