import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from tokenizers import Tokenizer

from quarrylens.llm import library_words, token_files
from quarrylens.llm.common import joined

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(7, "It's the last one", 1), (2, None, 2), (5, "", 3), (3, "Hello <|endoftext|> world!", 4), (5, "tie", 5), (9, "a long text " * 4000, 6), (None, "no id", 7), (7, "It's the last one", 8)]


def test_round_trip_against_the_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, shard int")
    folder = token_files.write(df, PATH, f"file://{tmp_path}/t")
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    texts = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    at = 0
    assert len(rows) == len(texts)
    for row, (doc_id, text, _) in zip(rows, texts, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_as_the_library_has_them():
    rng = random.Random(11)
    library = Tokenizer.from_file(PATH)
    codes = token_files.library_codes(PATH)
    alphabet = "abcdeEAinth 's.,'!éÉßŁσΣİ²\t\n01ก\u0301你\u200d\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["Words, like these. AND THOSE!! don't e\u0301, A\u030a x$$$ $$$ a<|endoftext|>b"]
    for text, ids in zip(texts, codes.codes(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_only_wanted_frames_and_plain_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(300)], "doc_id long, text string")
    folder = token_files.write(df, PATH, f"file://{tmp_path}/t")
    got = {r.doc_id: bytes(r.ids) for r in token_files.fetch(spark, folder, spark.createDataFrame([(3,), (250,), (999,)], "doc_id long")).collect()}
    assert sorted(got) == [3, 250]
    shards = sorted((tmp_path / "t" / "shards").iterdir())
    stream = b"".join(zstandard.ZstdDecompressor().stream_reader(p.read_bytes(), read_across_frames=True).read() for p in shards)
    assert got[3] in stream
    n = sum(r.n_tokens for r in token_files.read(spark, folder).collect())
    assert len(stream) == 4 * n


def test_a_spoilt_frame_is_found(tmp_path):
    writer = token_files.ShardWriter()
    for i in range(5):
        writer.add(i, np.arange(i * 100, i * 100 + 50, dtype="<u4").tobytes())
    data = bytearray(writer.finish())
    data[len(writer.frames[0]) - 3] ^= 1
    token_files.publish(f"file://{tmp_path}/s", bytes(data))
    with token_files.ShardReader(f"file://{tmp_path}/s") as shard:
        assert len(shard.frame(1)) == 200
        try:
            shard.frame(0)
        except (ValueError, zstandard.ZstdError):
            return
    raise AssertionError("not found")


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(spark, token_files.write(df, PATH, f"file://{tmp_path}/t")).count() == 0


def test_letters_that_arrow_takes_for_plain():
    library = Tokenizer.from_file(PATH)
    codes = library_words.LibraryCodes(PATH)
    letters = [c for c in map(chr, range(0x2000)) if re.match(f"[{library_words.PLAIN}]", c)]
    assert len(letters) > 250
    for c in letters:
        assert pc.utf8_lower(pa.scalar(c)).as_py() == c.lower() and len(c.lower()) == 1
        assert unicodedata.is_normalized("NFC", c) and unicodedata.is_normalized("NFC", c.lower())
    texts = [f"{c}{c}a{c}..." for c in letters]
    for text, ids in zip(texts, codes.codes(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_reach_the_library_once_and_texts_are_not_cut_in_python(monkeypatch):
    codes = library_words.LibraryCodes(PATH)
    asked, cut = [], []
    monkeypatch.setattr(codes.letters, "encode", lambda words, f=codes.letters.encode: asked.extend(words) or f(words))
    monkeypatch.setattr(codes.plainly, "words", lambda text, f=codes.plainly.words: cut.append(text) or f(text))
    texts = ["Eins zwei, EINS... Öl", None, "", " zwei! öl; neu ", "a<|endoftext|>b zwei", "zwei\x1cneu"]
    assert codes.codes(texts) == codes.codes(texts) == [x for text in texts for x in codes.codes([text])]
    assert sorted(asked) == sorted({"eins", "zwei", "öl", "neu", "a", "b"}) and set(cut) == set(texts[4:])


def test_forgotten_words_change_no_ids():
    library = Tokenizer.from_file(PATH)
    codes = library_words.LibraryCodes(PATH, most_words=3)
    for at in range(40):
        text = " ".join(f"{a}{b}x," for a in "abcdefg"[at % 5 :] for b in "uvw"[at % 3 :]) + " it's 12 ###"
        assert np.frombuffer(codes.codes([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(codes.letters.words) <= 3 + 21


def test_batches_are_joined_up_to_a_size():
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": ["x" * 10] * 99 + ["y" * 5000]})
    out = list(joined(iter([rows.slice(k, 1) for k in range(100)] + [rows.slice(0, 0)]), 1000))
    assert pa.Table.from_batches(out).to_pydict() == rows.to_pydict()
    assert 2 < len(out) < 10 and out[-1].num_rows == 1 and all(b.nbytes <= 1000 for b in out[:-1])
    assert [b.num_rows for b in joined(iter([rows.slice(0, 90)]), 10**6)] == [90]
