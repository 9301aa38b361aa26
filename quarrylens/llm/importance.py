r"""Importance resampling towards a target distribution, by partition-local word tries.

A text's words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z in lower case; its features
are all runs of 1 to ``longest`` consecutive words, joined by one space.  Each task keeps
a trie of the runs it meets: a node holds how often its run came and the CRC state of its
bytes, so a longer run goes on from the state of the shorter one and no feature string is
ever built.  The bucket of a feature is its CRC modulo ``buckets``; the bucket totals of
all tasks are summed by a shuffle of at most ``buckets`` rows a task, and come to the
driver as ``buckets`` numbers, whatever the corpus.  A second pass walks the same tries
with each bucket's gain attached to its nodes, and adds the gains up to a document's
weight.  Weights get Gumbel noise from a hash of the id, so that the documents of the
highest scores are a sample by importance without replacement.

Scale: two passes over whole texts, neither of which shuffles them; a task holds a batch,
the nodes of ``MOST_NODES`` runs (a full trie is emptied into the bucket totals and grows
anew, which changes no result) and the totals.  Ranks come from a range partitioning of
(score, doc_id) alone and from the number of rows in each of its partitions.

Edge cases: null and empty texts, and such of separators only, have no features and the
weight 0; a null id is hashed as the empty string and comes last among equal scores;
repeated rows are counted and ranked each on its own; a very long text comes alone in its
batch; an empty target leaves every bucket of it at 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, map_frames

#: Production parameters.
LONGEST, BUCKETS, SEED, LEAST_WORDS, SHARE = 1, 10_000, "2024", 20, (10, 100)
#: Nodes of a task's trie, beyond which it is emptied.
MOST_NODES = 500_000
#: Bytes of UTF-8 to words: A-Z become a-z, other ASCII but digits and letters a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Trie:
    """Runs of words as nodes; ``crc`` holds the CRC state of each node's run."""

    def __init__(self):
        self.crc: list[int] = []
        self.roots: dict[bytes, int] = {}
        #: By (node of a run) << 32 | (root node of the word that follows).
        self.longer: dict[int, int] = {}
        self.word: dict[int, bytes] = {}

    def __len__(self) -> int:
        return len(self.crc)

    def _grown(self, state: int, more: bytes) -> int:
        self.crc.append(zlib.crc32(more, state))
        return len(self.crc) - 1

    def walk(self, docs: list[list[bytes]], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2, ... words: the nodes of all runs, and the document of each."""
        roots = self.roots
        for word in set().union(*docs).difference(roots):
            roots[word] = self._grown(0, word)
            self.word[roots[word]] = word
        sizes = np.array([len(words) for words in docs], dtype=np.int64)
        first = np.array([roots[w] for words in docs for w in words], dtype=np.int64)
        doc = np.repeat(np.arange(len(docs)), sizes)
        nodes, at = first, np.arange(len(first))
        yield nodes, doc
        for length in range(2, longest + 1):
            inside = at + length - 1 < len(first)
            inside[inside] = doc[at[inside]] == doc[at[inside] + length - 1]
            at = at[inside]
            keys, where = np.unique(nodes[inside] << 32 | first[at + length - 1], return_inverse=True)
            for key in keys.tolist():
                if key not in self.longer:
                    self.longer[key] = self._grown(self.crc[key >> 32], b" " + self.word[key & 0xFFFFFFFF])
            nodes = np.array([self.longer[k] for k in keys.tolist()], dtype=np.int64)[where]
            yield nodes, doc[at]


def bucket_counts(documents: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, most_nodes: int = MOST_NODES) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, counts, totals = Trie(), np.zeros(0, dtype=np.int64), np.zeros(buckets, dtype=np.int64)

        def emptied() -> None:
            np.add.at(totals, np.array(trie.crc, dtype=np.int64)[: len(counts)] % buckets, counts)

        for pdf in frames:
            if len(trie) > most_nodes:
                emptied()
                trie, counts = Trie(), np.zeros(0, dtype=np.int64)
            for nodes, _ in trie.walk([words_of(x) for x in pdf["text"]], longest):
                more = np.bincount(nodes, minlength=len(trie))
                more[: len(counts)] += counts
                counts = more
        emptied()
        held = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": held.astype(np.int32), "n": totals[held]})

    summed = map_frames(documents.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(have: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of target to corpus, smoothed by one, in thousandths."""
    n, s, t = len(have), int(have.sum()), int(wanted.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(have.tolist(), wanted.tolist(), strict=True)], dtype=np.int64)


def noise(seed: str, doc_id: str) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED, most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, held = Trie(), np.zeros(0, dtype=np.int64)
        for pdf in frames:
            if len(trie) > most_nodes:
                trie, held = Trie(), np.zeros(0, dtype=np.int64)
            docs = [words_of(x) for x in pdf["text"]]
            weight, features = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
            for nodes, doc in trie.walk(docs, longest):
                new = np.array(trie.crc[len(held) :], dtype=np.int64)
                held = np.concatenate([held, gain[new % len(gain)]])
                features += np.bincount(doc, minlength=len(docs))
                sums = np.concatenate([[0], np.cumsum(held[nodes])])
                ends = np.searchsorted(doc, np.arange(len(docs) + 1))
                weight += sums[ends[1:]] - sums[ends[:-1]]
            own = [noise(seed, "" if x is pd.NA else str(x)) for x in pdf["doc_id"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "n_words": [len(x) for x in docs], "n_features": features, "weight": weight, "score": weight + np.array(own, dtype=np.int64)})

    chosen = documents.select(F.col("doc_id").cast("long"), "text")
    return map_frames(chosen, run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``scored`` with the rank of the drawn rows: the given share of those with enough
    words, highest scores first, ties to the smaller id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    fit = scored.where(F.col("n_words") >= least_words)
    placed = cut(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), (F.sum("n").over(Window.partitionBy()) * share[0] / share[1]).cast("long").alias("drawn"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(rest.columns).unionByName(rest)


def resample(documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn)."""
    gain = gains(bucket_counts(documents, longest, buckets, most_nodes), bucket_counts(target, longest, buckets, most_nodes))
    return ranked(cut(weigh(documents, gain, longest, seed, most_nodes)), least_words, share)
