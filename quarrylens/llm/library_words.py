r"""Texts to token ids by the tokenizers library, by way of distinct words in arrays.

The word tokenizer never lets a token span white space, so a text's ids are those of its
white-space separated words, one after the other.  Arrow cuts the texts of a batch and
numbers their distinct words, the library encodes these, and numpy lays out the ids of
every word's place.  Only words new to a Python worker become Python strings; what it
remembers is bounded and changes no result.

A word of letters and punctuation after them has the ids of both parts, so the library
gets each distinct part once, letters in lower case and joined by spaces: as such a part
ends with the only token that closes a word, the ids fall apart again.  Arrow finds these
parts for letters whose lower case and normal form are plain; for other words Python does,
and those not of this kind are encoded one by one.
"""

from __future__ import annotations

import json
import string
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from quarrylens.llm.word_codes import MOST_WORDS, Remembered, WordCodes

#: Letters that have a lower case of one letter and are normal as they stand: Latin (not U+0130) and Cyrillic.
PLAIN = "A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ"


class Runs:
    """Runs of ids: the k-th has ``sizes[k]`` of them, in one array one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, data: list[bytes]) -> Runs:
        return cls(np.frombuffer(b"".join(data), dtype="<u4"), np.fromiter(map(len, data), np.int64, len(data)) // 4)

    def take(self, places: np.ndarray) -> Runs:
        """The runs at these places, in this order."""
        sizes = self.sizes[places]
        shift = self.starts[places] - (np.cumsum(sizes) - sizes)
        index = np.repeat(shift, sizes)
        index += np.arange(len(index))
        return Runs(self.ids[index], sizes)

    def joined(self, counts: np.ndarray) -> Runs:
        """So many neighbouring runs at a time as one."""
        ends = np.concatenate(([0], np.cumsum(self.sizes)))[np.cumsum(counts)]
        return Runs(self.ids, np.diff(ends, prepend=0))

    def __add__(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def __iter__(self) -> Iterator[bytes]:
        """Each run as little-endian unsigned 32-bit integers."""
        data = memoryview(self.ids.tobytes())
        for a, b in pairwise([0, *(4 * np.cumsum(self.sizes)).tolist()]):
            yield bytes(data[a:b])


class KnownRuns:
    """Runs of distinct words, remembered in arrays; when these are more than ``most``,
    only those last asked for stay."""

    def __init__(self, encode: Callable[[list[str]], Runs], most: int):
        self.encode, self.most = encode, most
        self.words, self.runs = pa.array([], pa.string()), Runs.of([])

    def __call__(self, words: pa.Array) -> Runs:
        places = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()
        absent = places < 0
        new = words.filter(pa.array(absent))
        places[absent] = len(self.words) + np.arange(len(new))
        if len(new):
            self.words = pa.concat_arrays([self.words, new])
            self.runs += self.encode(new.to_pylist())
        found = self.runs.take(places)
        if len(self.words) > self.most:
            self.words, self.runs = words, found
        return found


class LibraryWords:
    """Words encoded by the tokenizers library itself."""

    #: ASCII punctuation but for the apostrophe, which may begin a contraction.
    AFTER = "".join(c for c in string.punctuation if c != "'")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Remembered(MOST_WORDS)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.closing[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def split(self, word: str) -> tuple[str, str]:
        """Letters in lower case, and what follows them; or the word as it is."""
        core = word.rstrip(self.AFTER)
        if not core.isalpha():
            return word, ""
        low = core.lower() if core.isascii() else core.replace("Σ", "σ").lower()
        if not core.isascii() and not (low.isalpha() and unicodedata.is_normalized("NFC", core)):
            return word, ""
        return low, word[len(core) :]

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def together(self, letters: list[str]) -> Runs:
        """The ids of parts of letters in lower case, some thousands in one call."""
        runs = [Runs.of([])]
        for at in range(0, len(letters), 5000):
            own = letters[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            falls_apart = len(ends) == len(own) and ends[-1] == len(ids)
            runs.append(Runs(ids, np.diff(ends, prepend=0)) if falls_apart else Runs.of(self.one_by_one(own)))
        return Runs(np.concatenate([x.ids for x in runs]), np.concatenate([x.sizes for x in runs]))

    def __call__(self, words: list[str]) -> list[bytes]:
        split = list(map(self.split, words))
        known = self.parts
        new = known.missing({p for parts in split for p in parts})
        letters = [p for p in new if p.isalpha() and p.islower()]
        known.update(zip(letters, self.together(letters), strict=True))
        known[""] = b""
        rest = [p for p in new if p not in known]
        known.update(zip(rest, self.one_by_one(rest), strict=True))
        return [known[a] + known[b] if b else known[a] for a, b in split]


class LibraryCodes:
    """``runs(texts)`` gives the ids of each text; special tokens in a text become their ids."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.encode = LibraryWords(path)
        special = {x.content: i for i, x in self.encode.tokenizer.get_added_tokens_decoder().items()}
        #: Cuts texts with special tokens or with characters that only Arrow and Python take for white space.
        self.plainly = WordCodes(self.encode, special)
        self.letters = KnownRuns(self.encode.together, most_words)

    def words(self, texts: pa.Array) -> pa.Array:
        """A list of words for each text; some are empty."""
        lists = pc.utf8_split_whitespace(texts)
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for token in self.plainly.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        at = np.flatnonzero(pc.fill_null(odd, False).to_numpy(zero_copy_only=False))
        if len(at):
            own: list[list[str] | None] = [None] * len(texts)
            for k in at.tolist():
                own[k] = self.plainly.words(texts[k].as_py())
            lists = pc.if_else(pc.fill_null(odd, False), pa.array(own, lists.type), lists)
        return lists

    def encoded(self, words: pa.Array) -> Runs:
        """The ids of distinct words."""
        core = pc.ascii_rtrim(words, LibraryWords.AFTER)
        plain = pc.match_substring_regex(core, f"^[{PLAIN}]+$")
        letters = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        after = pc.replace_substring_regex(words.filter(plain), f"^[{PLAIN}]+", "").dictionary_encode()
        other = words.filter(pc.invert(plain)).to_pylist()
        special = self.plainly.special
        own = dict(zip(new := [w for w in other if w not in special], self.encode(new), strict=True)) | special
        ends = self.encode.one_by_one(after.dictionary.to_pylist())
        parts = self.letters(letters.dictionary) + Runs.of([*ends, b"", *map(own.__getitem__, other)])
        # each word has two parts, the second of which may be empty
        n, nothing = len(letters.dictionary), len(letters.dictionary) + len(ends)
        mask = plain.to_numpy(zero_copy_only=False)
        places = np.full((len(words), 2), nothing)
        places[mask, 0], places[mask, 1] = letters.indices.to_numpy(), n + after.indices.to_numpy()
        places[~mask, 0] = nothing + 1 + np.arange(len(other))
        return parts.take(places.ravel()).joined(np.full(len(words), 2))

    def runs(self, texts: pa.Array) -> Runs:
        lists = self.words(texts.cast(pa.string()))
        words = lists.flatten().dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        return self.encoded(words.dictionary).take(words.indices.to_numpy()).joined(counts)

    def codes(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return list(self.runs(pa.array(texts, pa.string())))


@lru_cache(maxsize=2)
def library_codes(path: str) -> LibraryCodes:
    """The encoder of a file, once in each Python worker."""
    return LibraryCodes(path)
