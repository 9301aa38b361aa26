import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrylens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def agree(library, texts):
    own, words = bpe.loaded(PATH)
    for text, ids in zip(texts, words.codes(texts), strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(ids, dtype="<u4")
        assert got.tolist() == expected, repr(text)
        assert own.decode(got) == library.decode(expected, skip_special_tokens=False), repr(text)


def test_corner_texts(library):
    agree(library, [None, "", "  \n", "It's DON'T we'll 'S''s", "aaaaaaaaaaaaaaa", "a" * 5000, "é É ΣΣ İ ﬁ", "x<|endoftext|>y <|startoftext|><|endoftext|>",
                    "\x1c a\x1db\x85c d​e", "\U0001f600\U0001f468‍\U0001f469 नमस्ते 你好 123 4.5%", "!!!??? ...### '''", "<|endoftext", "\x00\x01", "a\u2003b\u1680c\u2028d\u3000e\x1cf \u200b\x1c", "\u00a0x\x1fy\u205fz"])


def test_random_texts(library):
    rng = random.Random(3)
    alphabet = "abcdeEAinth 's.,'!éÉßŁσΣ\t\n01ก́你‍"
    agree(library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)])


def test_a_full_table_of_words_changes_nothing():
    own, words = bpe.loaded(PATH)
    small = bpe.WordCodes(own.encode_words, own.special, most_words=3)
    texts = ["the quick brown fox jumps over", "over the lazy dog", "the fox"]
    assert small.codes(texts) == words.codes(texts)
    assert [small.codes([t])[0] for t in texts] == words.codes(texts)


def test_query_over_odd_rows(spark):
    rows = [(1, "Some text", 5), (1, "Some text", 5), (2, None, 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.digests(df, PATH).collect()
    assert len(out) == 4
    assert sorted(r.n_tokens for r in out) == [0, 0, 2, 2]
    assert bpe.digests(df.limit(0), PATH).count() == 0
