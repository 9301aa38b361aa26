import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarrylens.llm import language_model


def test_probabilities_of_spelled_words_add_up():
    """All continuations of a prefix by one byte share its probability."""
    model = language_model.BitModel.empty()
    words = [bytes(random.Random(i).choices(b"abcde", k=4)) for i in range(500)]
    slots, bits, *_ = language_model.spelled(words)
    np.add.at(model.seen, slots.ravel(), 1)
    np.add.at(model.ones, slots[:, bits == 1].ravel(), 1)
    model.__post_init__()
    for prefix in (b"", b"a", b"ab"):
        longer = sum(2.0 ** -(model.bits_of([prefix + bytes([x])])[0]) for x in range(256) if x != 0x20)
        closed = [2.0 ** -model.bits_of([prefix + bytes([x, y])])[0] for x in (97,) for y in range(256)]
        assert longer < 1.0 and sum(closed) < 1.0


def test_slots_are_within_their_tables_and_bits_spell_the_words():
    words = [b"word", b"", b"\xff\x00 "]
    slots, bits, depth, sizes = language_model.spelled(words)
    assert sizes.tolist() == [40, 8, 32] and len(bits) == len(depth) == 80
    assert all((slots[k] >= language_model.FIRST[k]).all() and (slots[k] < language_model.FIRST[k + 1]).all() for k in range(language_model.ORDERS))


def test_base_scores_and_gain_on_held_out(spark):
    rng = random.Random(3)
    syllables = {0: ["ka", "lo", "mi"], 1: ["zu", "tre", "vo", "pé"]}
    word = lambda k: "".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 4)))
    docs = [(i, " ".join(word(i % 2) for _ in range(rng.randint(30, 90))) + ".\n", "x") for i in range(300)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "A\x1cb \x85 A\x1cB", "x"), (5, docs[5][1], "x"), (None, "ka lo", "x"), (1003, "again " * 3000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    rows = language_model.score(df, block_bytes=4000).collect()
    assert len(rows) == len(docs)
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    counts = Counter()
    for i, t, _ in docs:
        if not fold(i):
            counts.update([*split(t), b"<end>"])
    n, v = counts.total(), len(counts)
    by = {i: t for i, t, _ in docs}
    for r in rows:
        tokens = [*split(by[r.doc_id]), b"<end>"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (fold(r.doc_id), len(tokens), n)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = next(r for r in rows if r.doc_id == 1003)
    assert again.score > again.base_score / 3
    assert language_model.score(df.limit(0)).count() == 0


def test_weights_and_map_learn_from_every_training_word(spark, monkeypatch):
    """As if learnt in one process from all words, whatever sample size may be set."""
    monkeypatch.setattr(language_model, "WEIGHT_WORDS", 10, raising=False)
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(b"abcdefg", k=rng.randint(2, 9))) for _ in range(900)})
    table = spark.createDataFrame([(bytearray(w), 1) for w in words], "word binary, n long").coalesce(1)
    path, weights, refine, *_ = language_model.fit(table, len(words))
    own = language_model.BitModel.empty()
    letters = language_model.Letters.of(np.bincount(np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8), minlength=256))
    own.letters = letters
    slots, bits, *_ = language_model.spelled(words, letters=letters)
    np.add.at(own.seen, slots.ravel(), 1)
    np.add.at(own.ones, slots[:, bits == 1].ravel(), 1)
    hits = np.zeros(own.refine.size * 2, dtype=np.int64)
    own.learn(words, 0, hits)
    assert np.allclose(weights, own.weights, atol=1e-4)
    hits = hits.reshape(*refine.shape, 2)
    assert np.allclose(refine, (hits[..., 1] + 4 * language_model.plain_weights()[1][0]) / (hits.sum(-1) + 4), atol=1e-3)


def test_slots_follow_the_distinct_words():
    few, many = language_model.slot_bits(1000), language_model.slot_bits(3_000_000)
    assert few == language_model.SLOT_BITS and all(a <= b for a, b in zip(few, many)) and sum(many) > sum(few)
    slots, *_ = language_model.spelled([b"word"], many)
    assert (slots.T < language_model.layout(many)[0][1:]).all()


def test_classes_come_from_all_training_documents(spark, monkeypatch):
    """A topic that no document of the sample holds has a class of its own."""
    monkeypatch.setattr(language_model, "SAMPLE_DOCS", 20)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    soon = {i: " ".join(word("abcdef") for _ in range(12)) for i in ids}
    df = spark.createDataFrame([(i, soon[i]) for i in ids], "doc_id long, text string")
    hashed = df.select("doc_id").orderBy(F.xxhash64("doc_id", "text")).collect()
    late = {r.doc_id for r in hashed[200:]}
    text = {i: " ".join(word("uvwxyz") for _ in range(12)) if i in late else soon[i] for i in ids}
    found = language_model.find_classes(spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    of = lambda i: int(found.of(language_model.bins(text[i].encode())[None])[0])
    assert not {of(i) for i in late} & {of(i) for i in ids if i not in late}


def test_letters_are_a_prefix_code():
    letters = language_model.Letters.of(np.array([1000, 500, 10] + [0] * 253))
    codes = {"".join(map(str, letters.bits[b, : letters.lengths[b]])) for b in range(256)}
    assert len(codes) == 256 and not any(a != b and b.startswith(a) for a in codes for b in codes if len(a) < 6)
    assert letters.lengths[0] == 1 < letters.lengths[2] and math.isclose(sum(2.0 ** -letters.lengths), 1)


def test_hash_bits_of_known_words_add_up():
    """The words of a bucket share all probability that reaches it."""
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64) << np.uint64(1))
    counts = rng.integers(0, 50, (300, language_model.CLASSES)).astype(float) + 1
    tree, model = language_model.Tree(h, counts, 0), language_model.CodeModel.plain()
    for k in (0, 3):
        at, cost = np.arange(300), np.zeros(300)
        for rows, bit, odds, gate in tree.levels(at, np.full(300, k), np.zeros(300)):
            cost[rows] += model.cost(bit, odds, gate)
        assert math.isclose(np.exp2(-cost).sum(), 1, rel_tol=1e-9)


def test_a_copy_scores_better_than_a_text_alone(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "zu", "tre"]) for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(0, 200, 5)]
    got = {r.doc_id: r.bits_per_byte for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = [got[i] for i in range(0, 200, 5)]
    alone = [got[i] for i in range(200) if i % 5]
    assert np.median(copies) < np.quantile(alone, 0.1)


def test_tokens_are_the_words_between_six_kinds_of_space(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab\x1c\xa0 \t\n\x0b\x0c\r", k=rng.randint(0, 60))) for _ in range(300)] + [b"", b" ", b"a"]
    found = language_model.Tokens.of(texts)
    words = [found.data[s : s + z] for s, z in zip(found.start, found.size)]
    assert words == [w for t in texts for w in t.split()]
    assert found.doc.tolist() == [d for d, t in enumerate(texts) for _ in t.split()]
    monkeypatch.setattr(language_model, "SEGMENT", 100)
    assert (language_model.Tokens.of(texts).h == found.h).all()
    by_hash = {}
    assert all(by_hash.setdefault(h, w) == w for h, w in zip(found.h.tolist(), words)) and len(by_hash) == len(set(words))
