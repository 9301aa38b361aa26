import random
import zlib

from quarrylens.llm import toxicity


def data(spark, n=400):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeghi") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Foulzz", "ravzid,", "zugu" + word()]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 1, "", "x"), (None, "foulzz ravzid foulzz zuguab", "x"), (n + 2, "word " * 40_000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    docs, labels = data(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i in range(400):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    wrong = [i for i in range(400) if by[i].predicted != int(i % 5 == 0)]
    assert len(wrong) <= 4 and not [i for i in wrong if i % 5 == 0]
    assert by[None].predicted == 1 and by[400].predicted == by[401].predicted == by[402].predicted == 0
    text = {r.doc_id: r.text for r in docs.collect()}[0]
    for span in by[0].spans.split(","):
        a, b = map(int, span.split(":"))
        assert any(x in text[a:b].lower() for x in ("foulzz", "ravzid", "zugu"))


def test_without_labels(spark):
    docs, labels = data(spark, 30)
    rows = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert all(r.predicted == 0 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0
