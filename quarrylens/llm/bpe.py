r"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array.  In each round all adjacent
pairs look up their rank by binary search over sorted pair keys, every word takes its
lowest rank, and all places of that pair in the word merge at once, leftmost first;
words without a mergeable pair leave the array.  The result equals that of the
``tokenizers`` library for vocabularies whose merges are in training order.

Scale: one pass over whole texts, no shuffle; a task holds the vocabulary, a bounded
table of words, and a batch.

Edge cases: null and empty texts, and such of white space only, have no ids and decode
to the empty string; special tokens in a text become their ids; repeated rows are
encoded alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_frames
from quarrylens.llm.word_codes import WHITE, WordCodes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and splitting rules of a ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        every = vocab | self.special
        self.token = [""] * (max(every.values()) + 1)
        for text, i in every.items():
            self.token[i] = text
        letters = byte_letters()
        self.inner = np.array([vocab.get(x, -1) for x in letters], dtype=np.int64)
        self.last = np.array([vocab.get(x + suffix, -1) for x in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = len(self.token)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"{path} asks for a decoder of an unknown kind, {kind}")
        self.bytes_of = {x: bytes([b]) for b, x in enumerate(letters)} if kind else None
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{WHITE}"))

    def normal(self, word: str) -> str:
        """NFC and lower case, letter by letter (a final sigma is not special)."""
        if word.isascii():
            return word.lower()
        return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, by binary search."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(size) - 1
        sym = self.inner[flat]
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(pieces)), size)
        done: list[np.ndarray] = [None] * len(pieces)
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NO_RANK)
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near] = self.rank(sym[near], sym[near + 1])
            best = np.minimum.reduceat(rank, head)
            count = np.diff(np.r_[head, len(sym)])
            for i in np.flatnonzero(best == NO_RANK):
                done[word[head[i]]] = sym[head[i] : head[i] + count[i]]
            open_ = np.repeat(best != NO_RANK, count)
            hit = open_ & (rank == np.repeat(best, count))
            # in a run of overlapping places every other one merges, from the left
            at = np.flatnonzero(hit)
            if not len(at):
                break
            start = np.r_[True, np.diff(at) > 1]
            place = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            open_[at + 1] = False
            sym, word = sym[open_], word[open_]
        return done

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        split = [[p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(self.normal(w))] for w in words]
        distinct = list({p for pieces in split for p in pieces})
        if not distinct:
            return [b""] * len(words)
        ids = {p: x[x >= 0].astype("<u4").tobytes() for p, x in zip(distinct, self.merge(distinct), strict=True)}
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: np.ndarray) -> str:
        """By the file's decoder: its bytes, or without one the tokens joined by spaces."""
        tokens = map(self.token.__getitem__, ids.tolist())
        if self.bytes_of is None:
            return " ".join(tokens)
        return b"".join(self.bytes_of.get(x, x.encode()) for token in tokens for x in token).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[Bpe, WordCodes]:
    """The tokenizer of a file and a table of words, once in each Python worker."""
    bpe = Bpe(path)
    return bpe, WordCodes(bpe.encode_words, bpe.special)


def encode(documents: DataFrame, path: str, *keep: str) -> DataFrame:
    """``doc_id``, the columns in ``keep``, and ``ids`` (little-endian unsigned 32-bit)."""
    chosen = documents.select(F.col("doc_id").cast("long"), "text", *keep)
    schema = chosen.drop("text").withColumn("ids", F.lit(b"")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, words = loaded(path)
        for pdf in frames:
            yield pdf.drop(columns="text").assign(ids=words.codes(pdf["text"]))

    return map_frames(chosen, run, schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text; digests of both results."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, words = loaded(path)
        for pdf in frames:
            out = []
            for ids in words.codes(pdf["text"]):
                text = bpe.decode(np.frombuffer(ids, dtype="<u4"))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            rows = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            rows.insert(0, "doc_id", pdf["doc_id"].array)
            yield rows

    return map_frames(documents.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
