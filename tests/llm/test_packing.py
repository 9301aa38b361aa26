import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrylens.llm import packing
from quarrylens.llm.byte_codes import ByteCodes
from quarrylens.llm.packing import Levels

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**53 + 1


def library(texts):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return [[*x.ids, 1] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "　", "\x85", "\xa0", "a", "b'll", "word", "X,", "...", "12", "3", "é", "漢", "🙂", "\x1c", "\x00", "<|endoftext|>", "'s", "don't", "-", "\r\n", "Ⅷ", "²", "ª", "ǅ", "́"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["a" * 100_000, " " * 100_000, "漢" * 30_000]
    codes = ByteCodes(BYTE_BPE)
    assert [[*codes.ids(t).tolist(), 1] for t in texts] == library(texts)


def test_placement_takes_the_least_sum_of_squares():
    rng, size = random.Random(5), 40
    levels, count = Levels(size), [0] * (size + 1)
    for k in range(4000):
        n = rng.choice([rng.randint(1, size - 1), 3, 17])
        assert levels.count[:size].tolist() == count[:size]

        def after(h):
            c = list(count)
            if h:
                c[h] -= 1
            c[h + n] += 1
            return sum(x * x for x in c[:size])

        choices = [h for h in range(size - n + 1) if h == 0 or count[h]]
        least = min(map(after, choices))
        h = levels.level_for(n)
        assert h in choices and after(h) == least and h == max(c for c in choices if after(c) == least)
        full = levels.place((k, 0, n, np.zeros(n, dtype=np.uint32)))
        if h:
            count[h] -= 1
        count[h + n] += 1
        count[size] = 0
        assert (full is not None) == (h + n == size)


def checked(pieces, docs, size):
    """All properties that the contract asks for; returns the sequences' lengths."""
    at = {}
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)):
        assert r.length == len(r.ids) // 4 > 0
        ids.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, r.ids))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == size or (end < size and end & (end - 1) == 0)
    expected = {}
    for (doc_id, _), own in zip(docs, library([t for _, t in docs])):
        expected.setdefault(doc_id, []).append(own)
    assert set(ids) == set(expected)
    for doc_id, texts in expected.items():
        assert sum(len(x[2]) // 4 for x in ids[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            end, data = 0, b""
            for start, total, part in sorted(ids[doc_id]):
                assert start == end and total == len(texts[0])
                end, data = end + len(part) // 4, data + part
            assert np.frombuffer(data, "<u4").tolist() == texts[0]
    return sorted(sum(n for _, n in parts) for parts in at.values())


@pytest.mark.parametrize("size, most_open, tasks", [(2048, 4000, 3), (64, 5, 4), (64, 4000, 1), (50, 0, 2)])
def test_each_token_lies_in_one_gapless_place(spark, size, most_open, tasks):
    rng = random.Random(size)
    docs = [(k, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 5, 40, 300])))) for k in range(150)]
    docs += [(1000, None), (1001, ""), (None, "no id"), (BIG, "word " * 30_000), (-BIG, "<|endoftext|> x"), (7000, "twice the same"), (7000, "twice the same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, part string, length int").repartition(tasks)
    pieces = packing.packed(df, BYTE_BPE, size, most_open=most_open)
    rows = pieces.collect()
    lengths = checked(rows, docs, size)
    assert sum(n < size for n in lengths) <= 11
    joined = {r.sequence_id: (r.length, r.ids) for r in packing.sequences(pieces).collect()}
    for sequence, (length, ids) in joined.items():
        assert bytes(ids) == b"".join(r.ids for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset)) and len(ids) == 4 * length
    crc = {(r.sequence_id, r.offset): zlib.crc32(r.ids) for r in rows}
    assert crc == {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.digests(pieces).collect()}


def test_few_documents_are_cut():
    """The placement decides: few windows are left open, to be cut, in the end."""
    rng, levels, full = random.Random(8), Levels(2048), 0
    for k in range(20_000):
        full += levels.place((k, 0, 0, np.zeros(min(2047, int(rng.lognormvariate(5.5, 1)) + 1), dtype=np.uint32))) is not None
    assert levels.open < 0.15 * full


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE).collect() == []
