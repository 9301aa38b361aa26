"""The pipeline against a plain composition of its rules."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SECRET = re.compile(r"""(?ai)(password|secret)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")


def tables(spark, folder, docs, items):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    save("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    save("benchmark", items, "item_id long, text string")
    # without labels every line counts as content, so that the base rules alone decide
    save("labels", [], "doc_id long, quality int, toxic int")
    return str(folder)


def expected(docs, items):
    words = {i: (t or "").split() for i, t, *_ in docs}

    def repeated(own):
        triples = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        often = {t for t in triples if triples.count(t) > 1}
        return len({k + j for k, t in enumerate(triples) if t in often for j in range(3)})

    kept = [i for i in words if len(words[i]) >= 50 and 100 * repeated(words[i]) <= 50 * len(words[i])]
    sets = {i: {tuple(w.lower() for w in words[i][k : k + 5]) for k in range(len(words[i]) - 4)} for i in kept}
    label = {i: i for i in kept}
    for a, b in itertools.combinations(kept, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    text = {i: t for i, t, *_ in docs}
    left = [i for i in kept if label[i] == i and not any(x in text[i] for _, x in items)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: library.encode(SECRET.sub("[REDACTED]", text[i]), add_special_tokens=False).ids for i in left}


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(4000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(text(30))) for k in range(5)]
    bodies = []
    for k in range(60):
        own = text(rng.randint(30, 160))
        if k % 7 == 0:
            own[10:10] = items[k % 5][1].split()
        if k % 5 == 0:
            own.insert(5, "password: " + "".join(rng.choices("abcXYZ019", k=12)))
        bodies.append(own)
    for k in range(12):  # exact copies, and copies with a word changed near the end
        own = list(bodies[3 * k + 1])
        bodies.append(own if k % 3 else [*own[:-2], "changed", own[-1]])
    bodies.append(["same", "old", "words"] * 40)
    docs = [(1000 - k if k % 2 else k, " ".join(own)) for k, own in enumerate(bodies)] + [(2000, None), (2001, "")]
    docs = [(i, t, "en", "src1", len(t or "")) for i, t in docs]
    folder = tables(spark, tmp_path, docs, items)
    rows = corpus_pipeline.run(spark, folder).collect()
    wanted = expected(docs, items)
    assert len(rows) == len(wanted) > 20
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in rows}
    assert got == wanted and all(r.n_tokens == len(wanted[r.doc_id]) for r in rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_labels_decide_and_odd_rows_pass_through(spark, tmp_path):
    """Junk goes by the line labels; a null id and an id of two texts stay."""
    from tests.llm.test_quality_rules import data

    docs, labels = data(spark)
    docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(ids, key=str) == sorted([*(i for i in range(240) if i % 3), None, 1], key=str)
