import random

import numpy as np

from quarrylens.llm import decontaminate

VOCAB = ["the", "of", "and", "to", "in"] * 40 + [f"w{i}x" for i in range(3000)]


def brute_force(item, passage):
    """Smith-Waterman cell by cell."""
    table = np.zeros((len(item) + 1, len(passage) + 1), dtype=int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a == b else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, passage = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, end = decontaminate.aligned(item, passage)
        assert score == brute_force(item, passage)
        assert brute_force(item, passage[:end]) == score


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 2:
            out.append(rng.choice(VOCAB))
        elif r < share * 0.75:
            continue
        else:
            out += [w.upper() + ","] + ([rng.choice(VOCAB)] if r > 1 - share / 4 else [])
    return out


def test_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(20)] + [(20, None), (21, "..."), (22, "zz9"), (23, None)]
    docs, planted = [], set()
    for d in range(120):
        words = text(300)
        if d % 3 == 0:
            i = d % 20
            at = rng.randrange(250)
            words[at:at] = edited(rng, items[i][1].split(), (0, 0.1, 0.25)[d // 3 % 3])
            planted.add((d, i))
        docs.append((d, " ".join(words), "x", 1))
    docs += [(500, None, "x", 1), (501, "", "x", 1), (502, "!!! ---", "x", 1), (503, "a zz9 b", "x", 1), (503, "a zz9 b", "x", 1), (None, items[3][1], "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(503, 22), (None, 3)}
    by = {d: t for d, t, *_ in docs}
    exact = next(r for r in got if r.doc_id == 0)
    assert exact.score == 1.0 and by[0][exact.start : exact.end].lower().replace(",", "") == items[0][1]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in planted} - {503, None}
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.matches(df.limit(0), bench).count() == 0


def test_recall_against_full_alignment(spark):
    """Of the pairs that a whole Smith-Waterman table finds, nine in ten are found by seeds."""
    rng = random.Random(12)
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = [(i, text(40)) for i in range(8)]
    docs = []
    for d in range(48):
        words, (i, item) = text(80), items[d % 8]
        words[20:20] = edited(rng, item, (0.05, 0.2, 0.35, 0.5)[d // 8 % 4])
        docs.append((d, words))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    hashes = decontaminate.WordHashes()
    coded = {("d", d): hashes.of(" ".join(w))[0] for d, w in docs} | {("i", i): hashes.of(" ".join(w))[0] for i, w in items}
    whole = {(d, i) for d, _ in docs for i, _ in items if decontaminate.aligned(coded["i", i], coded["d", d])[0] >= decontaminate.LEAST_SCORE * 2 * len(coded["i", i])}
    assert len(whole) > 30 and got <= whole and len(got) >= 0.9 * len(whole), (len(got), len(whole))


def test_words_are_hashed_alike_and_once(monkeypatch):
    from quarrylens.llm import decontaminate as d

    asked = []
    monkeypatch.setattr(d.xxhash, "xxh64_intdigest", lambda x, own=d.xxhash.xxh64_intdigest: asked.append(x) or own(x))
    hashes = d.WordHashes()
    words = "Ab ab a_b A-B, ... _ İx x 12 ab".split()
    one, two = hashes.each(words), hashes.each(words)
    assert one.tolist() == two.tolist() and len(asked) == 7 and one[4] == one[5] == 0 and len({int(one[k]) for k in (0, 1, 2, 3, 9)}) == 1
    own, place = hashes.of(" ".join(words))
    assert own.tolist() == [x for x in one.tolist() if x] and place.tolist() == [0, 1, 2, 3, 6, 7, 8, 9]
