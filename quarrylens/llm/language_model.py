r"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is sent as bits, each of them predicted, and its score is their sum.  First comes
the class of the document, then its words ``[^\x20\x09-\x0D]+`` (A-Z in lower case) and
an end.  A word begins with a bit that tells new words from known ones.  A known word is
sent as the bits of its 64-bit hash, until no other known word begins with them; a new
word as the bits of its bytes and of a space.

Two families of predictors count ones and zeros in contexts.  For hash bits: the bits so
far in all documents, and the same within the document's class.  For spelling: hashed
slots of the last 0 to 4 bytes and the bits so far of the next.  In both, the predictors'
log-odds are combined by weights which a gate selects (how much the class has seen; bit
place and longest known context) and which online gradient steps train; an adaptive map
then refines the mixed probability by what followed it.  While a document is read, a
cache of its own words gains weight as it repeats itself.

A training document is read as if it had not been learned from: the words that it alone
holds are new to it, and the others' counts lack its share.  So a copy of a text that the
corpus also holds elsewhere scores far better than a text that stands alone.

Counts, classes, counters, weights and maps cover all training documents; the classes
start from a bounded sample (``SAMPLE_DOCS``) and are then fitted by EM passes over all
training documents until they settle.

Scale: distinct words, not tokens, are shuffled: (word, class, counts) once to count and
twice in buckets of their hash, which are even whatever the words are; and for each block
of documents (about ``BLOCK_BYTES`` of text, by a hash of the id) its distinct words,
which meet their prices in a join and come back to the block.  Texts travel compressed.
The hashed tables grow with the distinct words up to ``MOST_SLOT_BITS``, some 20
megabytes; EM passes read a row of ``BINS`` bytes for each training document; the
driver gets a row of counts for each bucket and class.

Edge cases: null and empty texts hold the end token alone; a null id is never held out;
rows with equal ids are scored one by one, and each is learned from; without training
documents every word is spelled at even odds; a very long text is a block of its own
size; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.anchors import Prints
from quarrylens.llm.common import BATCH_BYTES, cut, fold_column, lower_ascii, map_frames, parts, shared_folder

FOLDS, HELD_OUT = 7, 2
#: Classes of documents, training documents that they start from, most rounds of EM, and
#: bins of byte pairs (a power of two).
CLASSES, SAMPLE_DOCS, EM_ROUNDS, BINS = 8, 2500, 25, 256
#: EM over all training documents ends where a round gains less than this share.
SETTLED = 1e-5
#: Least and most slots of the predictors of order 0, 1, 2, ...: powers of two.
SLOT_BITS, MOST_SLOT_BITS = (12, 16, 18, 19, 19), (12, 16, 19, 20, 20)
BLOCK_BYTES = 24_000_000
#: Words of batches that a task gathers before it adds them up and hands them on.
FLUSH_WORDS = 400_000
#: Bytes of text whose words are hashed at once.
SEGMENT = 2_000_000
#: White space between words: a fixed set of six bytes.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
CHUNK_WORDS, STEP_BITS, RATE = 6_000, 50_000, 0.5
#: Known words of a bucket of hashes; rounds over a bucket and parts of each that are a step.
BUCKET_WORDS, ROUNDS, STEPS = 60_000, 1, 4
#: What is added to the counts of a bit; gates of the hash bits, by doublings of the class's count.
EVEN, CODE_GATES = 0.4, 18
BUCKETS, REACH = 33, 8.0
#: The byte after a word.
CLOSE = 0x20

ORDERS = len(SLOT_BITS)
FIRST = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
GATES = ORDERS * 8
SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "n_bytes long, bits_per_byte double"
)


@dataclass
class Letters:
    """A prefix code of the 256 bytes: each one's bits, and the node before each bit."""

    lengths: np.ndarray
    bits: np.ndarray
    nodes: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Letters:
        """Huffman's code, so that frequent bytes are few bits to predict."""
        heap = [(int(n) + 1, byte, byte) for byte, n in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, 256 + len(children), 256 + len(children)))
            children.append((left, right))
        paths: dict[int, list[tuple[int, int]]] = {}
        open_: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
        while open_:
            at, path = open_.pop()
            if at < 256:
                paths[at] = path
            else:
                open_ += [(child, [*path, (at - 256, bit)]) for bit, child in enumerate(children[at - 256])]
        lengths = np.array([len(paths[byte]) for byte in range(256)])
        table = np.zeros((2, 256, lengths.max()), dtype=np.int64)
        for byte, path in paths.items():
            table[:, byte, : len(path)] = np.array(path).T
        return cls(lengths, table[1], table[0])

    def spread(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all bits of some bytes: the byte's place, the bit's depth, the node, the bit."""
        own = self.lengths[flat]
        owner = np.repeat(np.arange(len(flat)), own)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
        byte = flat[owner]
        return owner, depth, self.nodes[byte, depth], self.bits[byte, depth]


#: Bytes at eight bits each.
EVEN_LETTERS = Letters.of(np.zeros(256))


def slot_bits(distinct: int) -> tuple[int, ...]:
    """Slots that follow the number of distinct words."""
    return tuple(min(max(least, distinct.bit_length()), most) for least, most in zip(SLOT_BITS, MOST_SLOT_BITS, strict=True))


@lru_cache(maxsize=8)
def layout(slots: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first slot of each order, and where each node of a byte's bits stands
    relative to its context."""
    sizes = [1 << b for b in slots]
    return np.concatenate(([0], np.cumsum(sizes))), [np.random.default_rng(k).integers(0, size, 256).astype(np.int32) for k, size in enumerate(sizes)]


def spelled(words: list[bytes], widths: tuple[int, ...] = SLOT_BITS, letters: Letters = EVEN_LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words end to end: slots (orders x bits), the bits, their depths, and bits
    per word."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(w + bytes([CLOSE]) for w in words), dtype=np.uint8)
    n = len(flat)
    starts, places = layout(widths)
    first = np.cumsum(sizes) - sizes
    place = np.arange(n) - np.repeat(first, sizes)
    owner, depth, nodes, bits = letters.spread(flat)
    slots = np.empty((ORDERS, len(bits)), dtype=np.int32)
    context = np.minimum(place, 3).astype(np.uint64)
    wide = flat.astype(np.uint64) + np.uint64(1)
    for k in range(ORDERS):
        if k:
            before = np.zeros(n, dtype=np.uint64)
            before[k:] = np.where(place[k:] >= k, wide[:-k], np.uint64(0))
            context = before if k == 1 else context * np.uint64(0x100000001B3) + before
        mixed = (context + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        base = (mixed >> np.uint64(64 - widths[k])).astype(np.int32)
        slots[k] = (places[k][nodes] ^ base[owner]) + np.int32(starts[k])
    per_word = np.add.reduceat(letters.lengths[flat], first) if n else sizes
    return slots, bits, np.minimum(depth, 7), per_word


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BitModel:
    """Counters of all slots, the gated weights, and the refining map."""

    ones: np.ndarray
    seen: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    widths: tuple[int, ...] = SLOT_BITS
    letters: Letters = field(default_factory=lambda: EVEN_LETTERS)

    def __post_init__(self):
        self.odds = np.log((self.ones + 0.2) / (self.seen - self.ones + 0.2)).astype(np.float32)
        self.known = self.seen >= 2

    @classmethod
    def empty(cls) -> BitModel:
        zero = np.zeros(FIRST[-1], dtype=np.float32)
        return cls(zero, zero.copy(), *plain_weights())

    def gate(self, known: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """known: for each order, whether its context is."""
        return np.maximum(sum(x.view(np.int8) for x in known) - 1, 0) * np.int64(8) + depth

    def left_out(self, slots: np.ndarray, bits: np.ndarray, depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Log-odds and gates as if these bits had not been counted once."""
        odds, known = [], []
        for own in slots:
            ones, seen = self.ones[own], self.seen[own]
            ones -= bits
            zeros = np.maximum(seen - ones - 1, 0)
            np.maximum(ones, 0, out=ones)
            odds.append(np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2))))
            known.append(seen >= 3)
        return odds, self.gate(known, depth)

    def mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return sum(x * self.weights[:, k][gate] for k, x in enumerate(odds))

    def cells(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row and the bucket of the refining map."""
        bucket = np.rint((np.clip(x, -REACH, REACH) + REACH) * ((BUCKETS - 1) / (2 * REACH))).astype(np.int64)
        return np.minimum(gate // 8, 3) * 8 + gate % 8, bucket

    def bits_of(self, words: list[bytes], left_out: bool = False) -> np.ndarray:
        """The number of bits that each word costs, as if it had not been learned if so asked."""
        slots, bits, depth, sizes = spelled(words, self.widths, self.letters)
        odds, gate = self.left_out(slots, bits, depth) if left_out else ([self.odds[own] for own in slots], self.gate([self.known[own] for own in slots], depth))
        x = self.mixed(odds, gate)
        p = (squash(x) + self.refine[self.cells(x, gate)]) / 2
        cost = -np.log2(np.clip(np.where(bits == 1, p, 1 - p), 1e-6, 1))
        return np.add.reduceat(cost, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)

    def learn(self, words: list[bytes], turn: int, hits: np.ndarray) -> None:
        """Online steps of the weights; ``hits`` gathers what follows each cell."""
        slots, bits, depth, _ = spelled(words, self.widths, self.letters)
        odds, gate = self.left_out(slots, bits, depth)
        for at in range(0, len(bits), STEP_BITS):
            part = slice(at, at + STEP_BITS)
            x = self.mixed([own[part] for own in odds], gate[part])
            miss = bits[part] - squash(x)
            n = np.bincount(gate[part], minlength=GATES) + 20
            rate = RATE / (1 + 0.1 * turn) ** 0.5
            for k in range(ORDERS):
                self.weights[:, k] += rate * np.bincount(gate[part], miss * odds[k][part], GATES) / n
            row, bucket = self.cells(x, gate[part])
            hits += np.bincount((row * BUCKETS + bucket) * 2 + bits[part], minlength=hits.size)


def plain_weights() -> tuple[np.ndarray, np.ndarray]:
    """Even weights, and a map that changes nothing."""
    return np.full((GATES, ORDERS), 1 / ORDERS), np.tile(squash(np.linspace(-REACH, REACH, BUCKETS)), (8 * 4, 1))


@lru_cache(maxsize=1)
def counters(path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ones and all counts of every slot, from the table that tasks share."""
    files, place = fs.FileSystem.from_uri(path)
    rows = pq.read_table(place, filesystem=files)
    ones, seen = np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)
    slot = rows.column("slot").to_numpy()
    ones[slot] = rows.column("ones").to_numpy()
    seen[slot] = ones[slot] + rows.column("zeros").to_numpy()
    return ones, seen


@dataclass
class Classes:
    """How likely each class of documents is, and how its pairs of neighbouring bytes fall
    into bins."""

    prior: np.ndarray
    log_rate: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The likeliest class of each row of bins."""
        return (np.log(self.prior) + evidence(rows) @ self.log_rate.astype(np.float32)).argmax(1)


def bins(text: bytes) -> np.ndarray:
    """The pairs of neighbouring bytes by bins, the fullest bin at 255."""
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    counts = np.bincount(((((data[:-1] << np.uint32(8)) | data[1:]) * np.uint32(40503)) >> np.uint32(8)) & np.uint32(BINS - 1), minlength=BINS) if len(data) > 1 else np.zeros(BINS)
    return np.rint(counts * (255 / max(counts.max(), 1))).astype(np.uint8)


def evidence(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.float32) / 16


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), BINS)


def find_classes(documents: DataFrame) -> Classes:
    """A mixture of bins, by EM over all training documents; a bounded sample of them
    gives the start."""
    training = documents.where(F.coalesce(fold_column("doc_id", FOLDS) != HELD_OUT, F.lit(True))).select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"h": pdf["h"], "row": [bins(lower_ascii(text)).tobytes() for text in pdf["text"]]})

    rows = cut(map_frames(training, counted, "h long, row binary"))
    sample = rows.select("h", "row").distinct().orderBy("h", "row").limit(SAMPLE_DOCS).collect()
    prior, log_rate = mixture(unpacked(sorted({bytes(r.row) for r in sample})))
    best = -np.inf
    for _ in range(EM_ROUNDS if sample else 0):
        prior, log_rate, like = em_round(rows, prior, log_rate)
        if like - best <= SETTLED * abs(like):
            break
        best = like
    return Classes(prior, log_rate)


def em_round(rows: DataFrame, prior: np.ndarray, log_rate: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Priors and log rates after a pass over all rows, and the log-likelihood before."""
    width, k = log_rate.shape

    def expected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rate, docs, total, n = np.zeros((width, k)), np.zeros(k), 0.0, 0
        for pdf in frames:
            x = evidence(unpacked(list(pdf["row"])))
            like = np.log(prior) + x @ log_rate.astype(np.float32)
            top = like.max(1, keepdims=True)
            member = np.exp(like - top)
            whole = member.sum(1, keepdims=True)
            member /= whole
            rate += x.T @ member.astype(np.float32)
            docs += member.sum(0)
            total += float((top + np.log(whole)).sum())
            n += len(pdf)
        if n:
            values = np.concatenate((rate.ravel(), docs, [total, n]))
            yield pd.DataFrame({"key": np.arange(len(values)), "value": values})

    found = map_frames(rows.select("row"), expected, "key int, value double", rows=5000).groupBy("key").agg(F.sum("value").alias("value")).orderBy("key").collect()
    values = np.array([r.value for r in found])
    rate, docs, (total, n) = values[: width * k].reshape(width, k) + 0.05, values[width * k : -2], values[-2:]
    return (docs + 1) / (n + k), np.log(rate / rate.sum(0)), float(total)


def mixture(rows: np.ndarray, k: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class priors and log rates of a mixture of multinomials over rows of bins."""
    n = len(rows)
    if not n:
        return np.full(k, 1 / k), np.zeros((BINS, k))
    x = evidence(rows)
    rng = np.random.default_rng(1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seeds = [int(rng.integers(n))]
    near = unit @ unit[seeds[0]]
    while len(seeds) < k:  # far from the seeds so far
        far = np.maximum(1 - near, 0) ** 2 + 1e-12
        seeds.append(int(rng.choice(n, p=far / far.sum())))
        near = np.maximum(near, unit @ unit[seeds[-1]])
    member = np.eye(k)[(unit @ unit[seeds].T).argmax(1)]
    for _ in range(EM_ROUNDS):
        prior = (member.sum(0) + 1) / (n + k)
        rate = x.T @ member + 0.05
        log_rate = np.log(rate / rate.sum(0))
        like = np.log(prior) + x @ log_rate
        member = np.exp(like - like.max(1, keepdims=True))
        member /= member.sum(1, keepdims=True)
    return prior, log_rate


@dataclass
class Tokens:
    """The words of some texts: place and size in the bytes of all, text, and hash."""

    data: bytes
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        data = b"\n".join([b"", *texts, b""])
        flat = np.frombuffer(data, dtype=np.uint8)
        space = SPACE[flat]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        ends = np.cumsum([len(x) + 1 for x in texts])
        h = np.empty(len(start), dtype=np.uint64)
        cuts = np.r_[np.searchsorted(start, np.arange(0, len(flat), SEGMENT)), len(start)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                h[a:b] = Prints(flat[start[a] : start[b - 1] + size[b - 1]]).of(start[a:b] - start[a], size[a:b])
        return cls(data, start, size, np.searchsorted(ends, start, side="left"), h)


def counted_words(packed: DataFrame) -> DataFrame:
    """(word, k, n, docs): each distinct word of each class of documents, and how often
    and in how many training documents it occurs; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        texts: list[bytes] = []
        own: list[tuple[np.ndarray, ...]] = []
        held = 0
        ends = np.zeros(CLASSES, dtype=np.int64)

        def rows() -> pa.RecordBatch:
            """What was counted in some batches, each word once."""
            key, k, n, docs, batch, start, size = map(np.concatenate, zip(*own, strict=True))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            at = order[first]
            words = [texts[b][s : s + z] for b, s, z in zip(batch[at].tolist(), start[at].tolist(), size[at].tolist(), strict=True)]
            return pa.record_batch({
                "word": pa.array(words, pa.binary()), "k": pa.array(k[at].astype(np.int32)),
                "n": pa.array(np.add.reduceat(n[order], first)), "docs": pa.array(np.add.reduceat(docs[order], first)),
            })

        for batch in batches:
            for part in parts(batch, size=BATCH_BYTES // 16):
                learn = ~part.column("held_out").to_numpy(zero_copy_only=False)
                k = part.column("k").to_numpy().astype(np.int64)
                ends += np.bincount(k[learn], minlength=CLASSES)
                found = Tokens.of([unpacker.decompress(x) for x in part.column("packed").to_pylist()])
                if not len(found.h):
                    continue
                key = _keys(found.h, k[found.doc])
                order = np.argsort(key, kind="stable")
                sorted_key, doc = key[order], found.doc[order]
                new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
                first, taken = np.flatnonzero(new), learn[doc].astype(np.int64)
                new[1:] |= doc[1:] != doc[:-1]
                at = order[first]
                own.append((sorted_key[first], k[found.doc[at]], np.add.reduceat(taken, first), np.add.reduceat(taken * new, first), np.full(len(at), len(texts)), found.start[at], found.size[at]))
                texts.append(found.data)
                held += len(at)
                if held > FLUSH_WORDS:
                    yield rows()
                    texts, own, held = [], [], 0
        if own:
            yield rows()
        k = np.flatnonzero(ends)
        yield pa.record_batch({"word": pa.array([b""] * len(k), pa.binary()), "k": pa.array(k.astype(np.int32)), "n": pa.array(ends[k]), "docs": pa.array(ends[k])})

    counted = packed.select("held_out", "k", "packed").mapInArrow(run, "word binary, k int, n long, docs long")
    return counted.groupBy("word", "k").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Short batches gathered into frames of about ``CHUNK_WORDS``."""
    own: list[pd.DataFrame] = []
    for pdf in frames:
        own.append(pdf)
        if sum(map(len, own)) >= CHUNK_WORDS:
            yield pd.concat(own, ignore_index=True)
            own = []
    if sum(map(len, own)):
        yield pd.concat(own, ignore_index=True)


def _letters(train: DataFrame) -> Letters:
    """The code of bytes for the distinct training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, dtype=np.int64)
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8)
            counts += np.bincount(data, minlength=256)
            counts[CLOSE] += batch.num_rows
        yield pa.record_batch({"byte": pa.array(np.arange(256, dtype=np.int32)), "n": pa.array(counts)})

    rows = train.mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(256, dtype=np.int64)
    for r in rows:
        counts[r.byte] = r.n
    return Letters.of(counts)


def fit(words: DataFrame, distinct: int) -> tuple[str, np.ndarray, np.ndarray, tuple[int, ...], Letters]:
    """The folder of the counters of all training words, weights and map fitted on all of
    them, the slots' bits, and the code of bytes."""
    widths = slot_bits(distinct)
    starts = layout(widths)[0]
    size = int(starts[-1])
    train = words.where("n > 0 and length(word) > 0").select("word")
    letters = _letters(train)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = np.zeros(2 * size, dtype=np.int64)
        for pdf in _chunks(frames):
            slots, bits, *_ = spelled(list(pdf["word"]), widths, letters)
            for own, a, b in zip(slots, starts[:-1], starts[1:], strict=True):
                tally[2 * a : 2 * b] += np.bincount((own - np.int32(a)) * 2 + bits, minlength=2 * int(b - a))
        zeros, ones = tally[0::2], tally[1::2]
        used = np.flatnonzero(zeros + ones)
        for at in range(0, len(used), 100_000):
            own = used[at : at + 100_000]
            yield pd.DataFrame({"slot": own.astype(np.int32), "ones": ones[own], "zeros": zeros[own]})

    # at most a row for each slot, whatever the corpus
    tables = map_frames(train, count, "slot int, ones long, zeros long", rows=CHUNK_WORDS).groupBy("slot").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    path = f"{shared_folder(words.sparkSession).rstrip('/')}/counters-{uuid.uuid4().hex}"
    tables.write.parquet(path)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BitModel(*counters(path, size), *plain_weights(), widths, letters)
        hits, n = np.zeros(own.refine.size * 2, dtype=np.int64), 0
        for turn, pdf in enumerate(_chunks(frames)):
            own.learn(list(pdf["word"]), turn, hits)
            n += len(pdf)
        if n:
            yield pd.DataFrame({"kind": 0, "key": np.arange(own.weights.size), "value": own.weights.ravel() * n})
            yield pd.DataFrame({"kind": 1, "key": np.arange(len(hits)), "value": hits.astype(float)})
            yield pd.DataFrame({"kind": [2], "key": [0], "value": [float(n)]})

    rows = map_frames(train, learn, "kind int, key int, value double", rows=CHUNK_WORDS).groupBy("kind", "key").agg(F.sum("value").alias("value")).orderBy("kind", "key").collect()
    weights, refine = plain_weights()
    if rows:
        by_kind = [np.array([r.value for r in rows if r.kind == kind]) for kind in range(3)]
        weights = (by_kind[0] / by_kind[2][0]).reshape(weights.shape)
        hits = by_kind[1].reshape(*refine.shape, 2)
        refine = (hits[..., 1] + 4 * refine[0]) / (hits.sum(-1) + 4)
    return path, weights, refine, widths, letters


def _keys(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One number for a word's hash and a class."""
    return ((h ^ (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@dataclass
class Tree:
    """Counts below each node of the hash bits, in all documents and in each class.

    ``h``: sorted hashes of the known words, or numbers of the buckets; ``depth``: the
    bits that all of them share; ``counts``: a column for each class.
    """

    h: np.ndarray
    counts: np.ndarray
    depth: int

    def __post_init__(self):
        sums = np.zeros((len(self.h) + 1, CLASSES + 1))
        sums[1:, 1:] = np.cumsum(self.counts, axis=0)
        sums[:, 0] = sums[:, 1:].sum(1)
        self.sums = sums

    def levels(self, at: np.ndarray, k: np.ndarray, own: np.ndarray, last: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: the rows (word ``at``, class ``k``) for which it is sent, the bit,
        the predictors' log-odds, and the gate; ``own`` is left out of a row's counts."""
        rows = np.arange(len(at))
        for d in range(self.depth, last):
            head = self.h >> np.uint64(64 - d) if d else np.zeros(len(self.h), dtype=np.uint64)
            new = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(head) else np.zeros(0, dtype=np.int64)
            low, high = new, np.r_[new[1:], len(head)]
            one = (self.h >> np.uint64(63 - d)) & np.uint64(1)
            ones = np.r_[0, np.cumsum(one)]
            middle = high - (ones[high] - ones[low]).astype(np.int64)
            node = np.repeat(np.arange(len(low)), high - low)
            if last == 64:
                rows = rows[(high - low)[node[at[rows]]] > 1]
                if not len(rows):
                    return
            # where all words below a node go one way no bit is needed
            sent = rows[((middle > low) & (middle < high))[node[at[rows]]]]
            mine = node[at[sent]]
            bit = one[at[sent]].astype(np.int64)
            odds, seen = [], None
            for column in (0, k[sent] + 1):
                upper = self.sums[high[mine], column]
                above = upper - self.sums[middle[mine], column] - own[sent] * bit
                below = self.sums[middle[mine], column] - self.sums[low[mine], column] - own[sent] * (1 - bit)
                above, below = np.maximum(above, 0), np.maximum(below, 0)
                odds.append(np.log((above + EVEN) / (below + EVEN)))
                seen = above + below
            gate = np.minimum(np.log2(seen + 1), CODE_GATES - 1).astype(np.int64)
            yield sent, bit, np.stack(odds, axis=1), gate


@dataclass
class CodeModel:
    """The gated weights of the hash bits' predictors, and the refining map."""

    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def plain(cls) -> CodeModel:
        return cls(np.full((CODE_GATES, 2), 0.5), np.tile(squash(np.linspace(-REACH, REACH, BUCKETS)), (CODE_GATES, 1)))

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return odds[:, 0] * self.weights[:, 0][gate] + odds[:, 1] * self.weights[:, 1][gate]

    @staticmethod
    def bucket(x: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(x, -REACH, REACH) + REACH) * ((BUCKETS - 1) / (2 * REACH))).astype(np.int64)

    def cost(self, bit: np.ndarray, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Bits; beyond the map's reach the mixed probability stands alone."""
        x = self.mixed(odds, gate)
        p = squash(x)
        p = np.where(np.abs(x) < REACH, (p + self.refine[gate, self.bucket(x)]) / 2, p)
        return -np.log2(np.maximum(np.where(bit == 1, p, 1 - p), 1e-12))

    def learn(self, bit: np.ndarray, odds: np.ndarray, gate: np.ndarray, n: np.ndarray, turn: int, hits: np.ndarray) -> None:
        """Online steps on bits that were each sent ``n`` times."""
        for part in np.array_split(np.arange(len(bit)), STEPS):
            x = self.mixed(odds[part], gate[part])
            miss = n[part] * (bit[part] - squash(x))
            total = np.bincount(gate[part], n[part], CODE_GATES) + 20
            for j in range(2):
                self.weights[:, j] += RATE / (1 + 0.1 * turn) ** 0.5 * np.bincount(gate[part], miss * odds[part, j], CODE_GATES) / total
        cell = (gate * BUCKETS + self.bucket(self.mixed(odds, gate))) * 2 + bit
        hits += np.bincount(cell, n, hits.size)


@dataclass
class Totals:
    """Tokens and distinct tokens of the training documents, the end token among them;
    and of each class: documents, words, and words that one document alone holds."""

    tokens: int
    distinct: int
    docs: np.ndarray
    words: np.ndarray
    single: np.ndarray
    #: Words of each bucket and class.
    buckets: np.ndarray

    def fresh(self) -> np.ndarray:
        """The probability of a new word in each class."""
        return (self.single + 0.5) / (self.words + 1.0)

    def depth(self) -> int:
        return len(self.buckets).bit_length() - 1

    def top(self) -> Tree:
        """The tree above the buckets."""
        return Tree(np.arange(len(self.buckets), dtype=np.uint64) << np.uint64(64 - self.depth()) if self.depth() else np.zeros(1, dtype=np.uint64), self.buckets, 0)


@dataclass
class Bucket:
    """The rows (word, class) of a bucket: places among its known words, and counts."""

    words: list[bytes]
    h: np.ndarray
    k: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Bucket:
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        take = lambda c: rows.column(c).to_numpy()[order]
        return cls(rows.column("word").take(pa.array(order)).to_pylist(), h[order], take("k").astype(np.int64), take("n").astype(float), take("docs").astype(float))

    def __post_init__(self):
        every, self.word = np.unique(self.h, return_inverse=True)
        self.total, self.held = (np.bincount(self.word, x, len(every)) for x in (self.n, self.docs))
        self.known = self.total > 0
        self.place = (np.cumsum(self.known) - 1)[self.word]
        counts = np.zeros((int(self.known.sum()), CLASSES))
        mine = self.known[self.word]
        np.add.at(counts, (self.place[mine], self.k[mine]), self.n[mine])
        self.hashes, self.counts = every[self.known], counts
        #: A document's share of a word, on average.
        self.share = np.where(self.docs > 0, np.maximum(np.rint(self.n / np.maximum(self.docs, 1)), 1), 0)

    def levels(self, top: Tree, rows: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The hash bits of some rows, from the top of the whole tree."""
        depth = len(top.h).bit_length() - 1
        bucket = (self.hashes >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(self.hashes), dtype=np.int64)
        yield from top.levels(bucket[self.place[rows]], self.k[rows], own, depth)
        yield from Tree(self.hashes, self.counts, depth).levels(self.place[rows], self.k[rows], own)

    def cost(self, top: Tree, model: CodeModel, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for at, bit, odds, gate in self.levels(top, rows, own):
            out[at] += model.cost(bit, odds, gate)
        return out


def _buckets(words: DataFrame, n: int) -> DataFrame:
    """Each word row with its hash and its bucket, of ``n`` (a power of two)."""
    hashed = words.where("length(word) > 0").withColumn("h", F.xxhash64("word"))
    place = F.shiftrightunsigned("h", 64 - (n.bit_length() - 1)) if n > 1 else F.lit(0).cast("long")
    return hashed.withColumn("bucket", place)


def _code_model(rows: DataFrame, totals: Totals) -> CodeModel:
    """Weights and map of the hash bits, from all words that several training documents
    hold: each bucket learns on its own, and the results are averaged by their words."""

    def learn(rows: pa.Table) -> pa.Table:
        own, top, model = Bucket.of(rows), totals.top(), CodeModel.plain()
        chosen = np.flatnonzero((own.n > 0) & (own.held[own.word] > 1))
        hits = np.zeros(model.refine.size * 2)
        for turn in range(ROUNDS):
            hits[:] = 0
            for at, bit, odds, gate in own.levels(top, chosen, own.share[chosen]):
                model.learn(bit, odds, gate, own.n[chosen][at], turn, hits)
        n = float(own.n[chosen].sum())
        values = np.concatenate((model.weights.ravel() * n, hits, [n]))
        return pa.table({"key": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values)})

    learned = rows.groupBy("bucket").applyInArrow(learn, "key int, value double")
    found = learned.groupBy("key").agg(F.sum("value").alias("value")).orderBy("key").collect()
    model = CodeModel.plain()
    values = np.array([r.value for r in found])
    if not len(values) or not values[-1]:
        return model
    weights, hits = np.split(values[:-1], [model.weights.size])
    hits = hits.reshape(*model.refine.shape, 2)
    return CodeModel((weights / values[-1]).reshape(model.weights.shape), (hits[..., 1] + 4 * model.refine) / (hits.sum(-1) + 4))


def _priced(rows: DataFrame, totals: Totals, code: CodeModel, path: str, weights: np.ndarray, refine: np.ndarray, widths: tuple[int, ...], letters: Letters) -> DataFrame:
    """(key, n, bits, others_bits): the training count of each word, and its bits in each
    class by all training documents and by all but one that holds it."""

    size = int(layout(widths)[0][-1])

    def run(rows: pa.Table) -> pa.Table:
        own, top = Bucket.of(rows), totals.top()
        model = BitModel(*counters(path, size), weights, refine, widths, letters)
        fresh, total, held = totals.fresh()[own.k], own.total[own.word], own.held[own.word]
        bits, others = np.zeros(len(own.h)), np.zeros(len(own.h))
        known, shared = np.flatnonzero(total > 0), np.flatnonzero((held > 1) & (own.docs > 0))
        bits[known] = own.cost(top, code, known, np.zeros(len(known))) - np.log2(1 - fresh[known])
        others[shared] = own.cost(top, code, shared, own.share[shared]) - np.log2(1 - fresh[shared])
        for out, chosen, left_out in ((bits, np.flatnonzero(total == 0), False), (others, np.flatnonzero((held == 1) & (own.docs > 0)), True)):
            for at in range(0, len(chosen), CHUNK_WORDS):
                part = chosen[at : at + CHUNK_WORDS]
                out[part] = model.bits_of([own.words[i] for i in part], left_out) - np.log2(fresh[part])
        return pa.table({"key": pa.array(_keys(Tokens.of(own.words).h, own.k)), "n": pa.array(total.astype(np.int64)), "bits": pa.array(bits.astype(np.float32)), "others_bits": pa.array(others.astype(np.float32))})

    return rows.groupBy("bucket").applyInArrow(run, "key long, n long, bits float, others_bits float")


def _packed(documents: DataFrame, found: Classes, blocks: int) -> DataFrame:
    """The documents with their blocks, classes and compressed texts, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in parts(batch):
                texts = [lower_ascii(text) for text in part.column("text").to_pylist()]
                k = found.of(np.stack(list(map(bins, texts))))
                columns = [part.column(c) for c in ("block", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(k, pa.int32()), pa.array(list(map(packer.compress, texts)), pa.binary())], names=["block", "doc_id", "held_out", "k", "packed"])

    held_out = F.coalesce(fold_column("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("block")
    chosen = documents.select(block, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return chosen.mapInArrow(run, "block long, doc_id long, held_out boolean, k int, packed binary")


def _chunked(documents: pa.Table) -> Iterator[tuple[pa.Table, Tokens]]:
    """A block's documents, some at a time, with their words."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in documents.to_batches():
        for part in parts(batch, size=BATCH_BYTES // 16):
            yield part, Tokens.of([unpacker.decompress(x) for x in part.column("packed").to_pylist()])


def _block_words(block: pa.Table) -> pa.Table:
    """The keys of all words and classes of a block."""
    found = [np.unique(_keys(words.h, part.column("k").to_numpy()[words.doc])) for part, words in _chunked(block)]
    keys = np.unique(np.concatenate(found))
    return pa.table({"block": pa.array(np.full(len(keys), block.column("block")[0].as_py(), dtype=np.int64)), "key": pa.array(keys)})


def score_block(documents: pa.Table, vocabulary: pa.Table, totals: Totals) -> pa.Table:
    """The scores of a block's documents."""
    keys = vocabulary.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    n, *bits = (vocabulary.column(c).to_numpy()[order] for c in ("n", "bits", "others_bits"))
    log_n, rates = np.log10(n + 1.0), [np.exp2(-x.astype(float)) for x in bits]
    ends = totals.docs.sum()
    end = (ends + 0.5) / (totals.tokens + 1)
    prior = np.log10((totals.docs + 0.5) / (ends + 0.5 * CLASSES))
    out = []
    for part, words in _chunked(documents):
        held_out, k = part.column("held_out").to_numpy(zero_copy_only=False), part.column("k").to_numpy()
        distinct, where = np.unique(_keys(words.h, k[words.doc]), return_inverse=True)
        at = np.searchsorted(keys, distinct)[where]
        size = np.bincount(words.doc, minlength=part.num_rows)
        add = lambda x: np.bincount(words.doc, x, part.num_rows)
        base = add(log_n[at]) + np.log10(ends + 1) - (size + 1) * np.log10(totals.tokens + totals.distinct + 1)
        rate = np.where(held_out[words.doc], rates[0][at], rates[1][at])
        score = add(with_cache(where, words.doc, rate)) + prior[k] + size * np.log10(1 - end) + np.log10(end)
        n_bytes = add(words.size.astype(float)).astype(np.int64) + size + 1
        out.append(pa.table({
            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": size + 1,
            "n_known": add((n[at] > 0).astype(float)).astype(np.int64) + int(ends > 0), "train_tokens": np.full(len(size), totals.tokens),
            "base_score": base, "score": score, "n_bytes": n_bytes, "bits_per_byte": -score / np.log10(2) / n_bytes,
        }))
    return pa.concat_tables(out)


def with_cache(at: np.ndarray, doc: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The words' log10 probabilities: each word's rate is mixed with its document's own
    words so far, by a weight that follows how often it has repeated itself.

    ``at`` and ``doc``: the number of each word and of its document, documents in order.
    """
    n = len(at)
    if not n:
        return np.zeros(0)
    order = np.argsort(doc * (at.max() + 1) + at, kind="stable")
    sorted_at, sorted_doc = at[order], doc[order]
    first = np.flatnonzero(np.r_[True, (sorted_at[1:] != sorted_at[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])])
    before = np.empty(n, dtype=np.int64)
    before[order] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[start, n])
    t = np.arange(n) - np.repeat(start, length)
    seen = np.r_[0, np.cumsum(before > 0)]
    again = seen[:-1] - np.repeat(seen[start], length)
    weight = (again + 0.2) / (t + 12.0) * (0.3 + 0.7 * again / np.maximum(t, 1))
    weight[start] = 0.0
    return np.log10(np.maximum(rates * (1 - weight) + weight * before / np.maximum(t, 1), 1e-300))


def _totals(words: DataFrame, every: DataFrame) -> Totals:
    """What the driver needs to know of the counted words; a row for each bucket and class."""
    docs, total, single = (np.zeros(CLASSES) for _ in range(3))
    tokens = distinct = 0
    is_word = F.length("word") > 0
    for r in every.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum(F.when((F.col("docs") == 1) & is_word, F.col("n"))).alias("single")).collect():
        tokens, distinct = tokens + r.n, distinct + r.words
        single[r.k] = r.single or 0
    n = 1
    while n * BUCKET_WORDS < distinct:
        n *= 2
    buckets = np.zeros((n, CLASSES))
    for r in _buckets(words.where("n > 0"), n).groupBy("bucket", "k").agg(F.sum("n").alias("n")).collect():
        buckets[r.bucket, r.k] = r.n
    for r in words.where(~is_word).collect():  # a row for each class
        docs[r.k] = r.n
    return Totals(tokens, distinct, docs, buckets.sum(0), single, buckets)


def score(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row of base and model scores for each document."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(4, -(-size // block_bytes)))
    packed = cut(_packed(documents, find_classes(documents), blocks))
    words = cut(counted_words(packed))
    # (word, n, docs, k): all classes together, and the one of a word's only document
    every = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max_by("k", "docs").alias("k")).where("n > 0")
    every = cut(every)
    totals = _totals(words, every)
    rows = _buckets(words, len(totals.buckets)).select("bucket", "h", "word", "k", "n", "docs")
    priced = cut(_priced(rows, totals, _code_model(rows, totals), *fit(every, totals.distinct)))
    dealt = packed.repartition(blocks, "block")
    needed = dealt.groupBy("block").applyInArrow(_block_words, "block long, key long")
    vocabulary = needed.join(priced, "key").select("block", "key", "n", "bits", "others_bits")
    return dealt.groupBy("block").cogroup(vocabulary.groupBy("block")).applyInArrow(lambda d, v: score_block(d, v, totals), SCHEMA)
