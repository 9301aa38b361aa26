"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are the stated queries, taken in blocks of bounded size; each block meets
all documents.  An item's seeds are its 3-word sequences that the corpus makes
improbable (the product of its words' frequencies over all documents), and always its
few rarest.  A document that holds a seed is aligned with that item, word by word,
around the seed; the alignment's score, as a share of the item's perfect score, tells
exact, edited and partly paraphrased copies from chance.

Scale: two passes over the documents (word frequencies, then seeds and alignments)
without a shuffle of texts; only the counts of the items' own words are shuffled.  A
block is at most ``BLOCK_CHARS`` characters of items, so what tasks receive is bounded.

Edge cases: null and empty texts and texts without letters or digits match nothing;
items without words match nothing; items shorter than a seed are sought as a whole;
equal items are each reported; repeated rows are reported alike; an empty benchmark
keeps every document; extra columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import filter_texts, map_frames

#: Characters of items in a block; what a task gets is a few times this.
BLOCK_CHARS = 8_000_000
#: Words of a seed.
SEED_WORDS = 3
#: A seed is rare if chance would put it at fewer than so many of all places.
RARE = 1e-9
#: The rarest seeds of an item that serve however common they are.
LEAST_SEEDS = 6
#: Share of the perfect score from which a passage is a copy.
LEAST_SCORE = 0.4
MATCH, MISMATCH, GAP = 2, 1, 1
MOST_WORDS = 300_000

SCHEMA = "doc_id long, item_id long, score double, n_seeds long, start long, end long"
NOT_WORD = re.compile(r"[\W_]+")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Hashed(dict):
    """Words and their hashes, made when first asked for; 0 for one without letters and digits."""

    def __missing__(self, word: str) -> int:
        low = word.lower()
        plain = low if low.isalnum() else NOT_WORD.sub("", low)
        self[word] = made = (xxhash.xxh64_intdigest(plain) | 1) if plain else 0
        return made


class WordHashes:
    """64-bit hashes of a text's words, in lower case and without punctuation."""

    def __init__(self):
        self.known = Hashed()

    def each(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashes and the numbers of the white-space separated words they come from."""
        every = self.each(text.split() if text else [])
        place = np.flatnonzero(every)
        return every[place], place


def seed_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ words[k : n + k]) * MIX[k % 3]
        out ^= out >> np.uint64(29)
    return out


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best score and the place after its last word in the passage."""
    slope = GAP * np.arange(1, len(passage) + 1)
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        row = above[:-1] + np.where(passage == word, MATCH, -MISMATCH)
        np.maximum(row, above[1:] - GAP, out=row)
        np.maximum(row, 0, out=row)
        above[1:] = np.maximum.accumulate(row + slope) - slope
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


@dataclass
class Block:
    """Items by number, and their seeds sorted by hash."""

    item_ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    short: list[tuple[int, np.ndarray]]
    mask: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, np.ndarray]], frequency: dict[int, float]) -> Block:
        rows, short = [], []
        for i, (_, words) in enumerate(items):
            if len(words) < SEED_WORDS:
                short.append((i, words))
                continue
            hashes = seed_hashes(words, SEED_WORDS)
            rarity = np.log10([frequency.get(int(w), 0.0) or 1e-12 for w in words])
            chance = sum(rarity[k : len(hashes) + k] for k in range(SEED_WORDS))
            chosen = chance <= math.log10(RARE)
            chosen[np.argsort(chance, kind="stable")[:LEAST_SEEDS]] = True
            rows += [(hashes[k], i, k) for k in np.flatnonzero(chosen)]
        seeds = np.array([r[0] for r in rows], dtype=np.uint64)
        order = np.argsort(seeds, kind="stable")
        owner, offset = (np.array([r[k] for r in rows], dtype=np.int64)[order] for k in (1, 2))
        bits = 20
        while 1 << bits < 8 * len(seeds):
            bits += 1
        mask = np.zeros(1 << bits, dtype=bool)
        mask[(seeds & np.uint64(len(mask) - 1)).astype(np.int64)] = True
        return cls([x for x, _ in items], [w for _, w in items], seeds[order], owner, offset, short, mask)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place at which it would begin) of each seed in a text."""
        found = seed_hashes(words, SEED_WORDS)
        maybe = np.flatnonzero(self.mask[(found & np.uint64(len(self.mask) - 1)).astype(np.int64)])
        low = np.searchsorted(self.seeds, found[maybe], side="left")
        high = np.searchsorted(self.seeds, found[maybe], side="right")
        for at, a, b in zip(maybe[high > low], low[high > low], high[high > low], strict=True):
            for k in range(a, b):
                yield int(self.owner[k]), int(at - self.offset[k])
        for i, item in self.short:
            if len(item):
                run = np.flatnonzero(words[: len(words) - len(item) + 1] == item[0]) if len(words) >= len(item) else []
                yield from ((i, int(at)) for at in run if np.array_equal(words[at : at + len(item)], item))

    def copies(self, words: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, score, seeds, first word, place after the last word) of each item copied."""
        begins = defaultdict(list)
        for i, at in self.hits(words):
            begins[i].append(at)
        for i, places in begins.items():
            item = self.words[i]
            slack = len(item) // 2 + 5
            best = (0, 0, 0)
            places.sort()
            group = [places[0]]
            for at in [*places[1:], None]:
                if at is not None and at - group[-1] <= slack:
                    group.append(at)
                    continue
                low, high = max(0, group[0] - slack), group[-1] + len(item) + slack
                score, end = aligned(item, words[low:high])
                best = max(best, (score, low, low + end))
                group = [at]
            share = best[0] / (MATCH * len(item))
            if share >= least:
                _, low, end = best
                _, back = aligned(item[::-1], words[low:end][::-1])
                yield i, share, len(places), end - back, end


def _blocks(documents: DataFrame, benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks; each comes with its words' frequencies over all documents."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        hashes = WordHashes()
        own = [(r.item_id, w) for r in rows if len(w := hashes.of(r.text)[0])]
        if own:
            yield Block.of(own, _frequencies(documents, np.unique(np.concatenate([w for _, w in own]))))


def _frequencies(documents: DataFrame, wanted: np.ndarray) -> dict[int, float]:
    """The share of each wanted word among all words of all documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, count, n = WordHashes(), np.zeros(len(wanted), dtype=np.int64), 0
        for pdf in frames:
            # distinct words of a frame with their numbers: each is hashed and sought once
            found: Counter[str] = Counter()
            for text in pdf["text"]:
                if text:
                    found.update(text.split())
            words, times = hashes.each(list(found)), np.fromiter(found.values(), np.int64, len(found))
            n += int(times[words != 0].sum())
            at = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
            same = (wanted[at] == words) & (words != 0)
            count += np.bincount(at[same], times[same], minlength=len(wanted)).astype(np.int64)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"word": np.r_[used, -1], "n": np.r_[count[used], n]})

    rows = map_frames(documents.select("text"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    total = max(counts.pop(-1, 0), 1)
    return {int(wanted[k]): n / total for k, n in counts.items()}


def matches(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """A row for each document and each item it holds a copy of; offsets in code points."""
    chosen = documents.select(F.col("doc_id").cast("long"), "text")
    out = documents.sparkSession.createDataFrame([], SCHEMA)
    for block in _blocks(documents, benchmark):

        def run(frames: Iterator[pd.DataFrame], block: Block = block) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()
            for pdf in frames:
                rows = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    words, place = hashes.of(text)
                    spans = None
                    for i, score, n_seeds, first, after in block.copies(words, least):
                        spans = spans or [m.span() for m in re.finditer(r"\S+", text)]
                        ends = (spans[place[first]][0], spans[place[after - 1]][1]) if len(spans) > place[-1] else (None, None)
                        rows.append((doc_id, block.item_ids[i], score, n_seeds, *ends))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64", "start": "Int64", "end": "Int64"})

        out = out.unionByName(map_frames(chosen, run, SCHEMA))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that hold no copy of any item, with all their columns."""
    out = documents
    for block in _blocks(documents, benchmark):

        def keeps(texts: list[str | None], block: Block = block, hashes: WordHashes = WordHashes()) -> list[bool]:
            return [next(block.copies(hashes.of(text)[0], least), None) is None for text in texts]

        out = filter_texts(out, keeps)
    return out
