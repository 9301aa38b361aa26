r"""Texts to token ids by way of their distinct words.

The word tokenizer never lets a token span white space, so a text's ids are those of
its white-space separated words, one after the other.  A task encodes each distinct
word once and then only looks it up; the table of words is emptied when full, which
bounds its memory and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Words a task remembers.
MOST_WORDS = 300_000
#: Characters that ``str.split`` takes for white space and the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The tokenizer's white space: fixed by Unicode's White_Space property.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(f"[{WHITE}]+")


class Remembered(dict):
    """A dict that forgets: when full it becomes the older generation, whose entries
    come back when asked for again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; what the older one has is taken over."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        absent = keys.difference(self)
        if self.older:
            older = self.older
            found = {k: older[k] for k in absent if k in older}
            self.update(found)
            absent -= found.keys()
        return list(absent)


class WordCodes:
    """``codes(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    ``encode`` turns distinct words into such bytes; ``special`` maps strings that are
    tokens wherever they stand, even inside a word, to their ids.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], special: dict[str, int], most_words: int = MOST_WORDS):
        self.encode = encode
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known = Remembered(most_words)

    def parts(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [x for x in SPACE.split(text) if x]
        return text.split()

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut and any(x in text for x in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.parts(part))]
        return self.parts(text)

    def codes(self, texts: Iterable[str | None]) -> list[bytes]:
        split = [self.words(text) for text in texts]
        every = set().union(*split)
        known = self.known
        new = [w for w in known.missing(every) if w not in self.special]
        known.update(zip(new, self.encode(new), strict=True))
        known.update(self.special)
        return [b"".join(map(known.__getitem__, words)) for words in split]
