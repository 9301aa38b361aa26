r"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case, its set the distinct
shingles of ``width`` words (the whole sequence if it is shorter).  Shingles fall into
``SLOTS`` slots by a first permutation; a second permutation, shifted circularly by
0, 1, 2, ... gives every coordinate of the signature.  ``BANDS`` bands of ``ROWS``
coordinates are bucket keys.

Documents with equal sets are one node, named by a 64-bit digest of the set.  In each
bucket all nodes are compared with one leader, on full sets (of 64-bit shingle hashes).
Buckets that then still hold nodes of several components are gone through again: small
ones pair by pair; in large ones first the nodes go that can't be linked with another
component, as sets of that similarity share one of their ``n - ceil(0.8 * n) + 1`` rarest
shingles.  Of the others those outside the bucket's largest component meet all, block by
block, and a node is compared only until its component has met the others.  So large
groups of copies cost about one comparison a member, texts over one template that aren't
near-duplicates cost none, and no link that could join two components is left untested.

Scale: texts are read twice and never shuffled whole; the text of candidates alone goes
to a table in the shared folder.  Bucket keys are grouped with map-side aggregation and
joined back, so that a hot bucket can be split; the pairs of a leader of many are dealt
in parts of ``SPLIT``; intermediate tables cut the lineage.

Edge cases: null and empty texts have no shingles and link with nothing; rows with equal
ids and different texts are linked each by its own text, and one of them may go while
the other stays; equal rows stay or go together; a null id links with nothing and has no
component; ties go to the smallest id; a very long text is one row of its own size;
extra columns are ignored by ``classes`` and kept by ``dedupe``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, lower_ascii, map_frames
from quarrylens.llm.components import components

WIDTH, SIMILARITY = 5, (80, 100)
#: Slots of the permutations; a power of two.
SLOTS = 1 << 20
#: 48 bands of 7 rows: a pair with a Jaccard of 0.8 shares no band once in 80,000.
BANDS, ROWS = 48, 7
SEED = 20_240_229
#: Nodes of a bucket up to which pairs are formed, and of a block beyond that.
SMALL, BLOCK = 32, 400
#: Shingles of a block, about.
BLOCK_SHINGLES = 400_000
#: Pairs of one leader that meet in one task.
SPLIT = 200
MOST_WORDS = 300_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct shingle hashes of texts; remembers a bounded number of words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        return self.of_words(lower_ascii(text).split())

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            out = mixed(out + ids[k : n + k] * MIX[k % len(MIX)])
        return np.unique(out)


class Circulant:
    """Signatures from two permutations: the first by ``mixed``, the second a table."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        second = np.random.default_rng(SEED).permutation(SLOTS).astype(np.uint32)
        size = bands * rows
        ring = np.concatenate([second, second[:size]])
        # row i holds the second permutation at i, i+1, ...: all circular shifts at once
        self.shifts = np.lib.stride_tricks.sliding_window_view(ring, size)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = (mixed(shingles) & np.uint64(SLOTS - 1)).astype(np.int64)
        low = None
        for at in range(0, len(slots), 512):
            part = self.shifts[slots[at : at + 512]].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A bucket key for each band."""
        values = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        key = self.salt.copy()
        for k in range(self.rows):
            key = mixed(key ^ values[:, k] * MIX[k % len(MIX)])
        return key.view(np.int64)


def _profiles(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (a digest of the set) and bucket keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, circulant = Shingles(width), Circulant()
        for pdf in frames:
            sets = [shingles.of(text) for text in pdf["text"]]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": [len(s) for s in sets],
                "node": nodes, "keys": [circulant.keys(s) if len(s) else None for s in sets],
            })

    chosen = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_frames(chosen, run, "doc_id long, text_key long, n_shingles long, node long, keys array<long>")


def _texts(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): the lower-cased words of the nodes' first documents, compressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for pdf in frames:
            yield pd.DataFrame({"node": pdf["node"], "packed": [packer.compress(b" ".join(lower_ascii(t).split())) for t in pdf["text"]]})

    own = documents.select(F.col("doc_id").cast("long").alias("first"), F.xxhash64("text").alias("text_key"), "text").join(nodes, ["first", "text_key"])
    return map_frames(own.select("node", "text"), run, "node long, packed binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    part, whole = similarity

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, unpacker = Shingles(width), zstandard.ZstdDecompressor()
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for pdf in frames:
            linked = []
            for a, b, pa, pb in zip(pdf["a"], pdf["b"], pdf["pa"], pdf["pb"], strict=True):
                if last[0] != b:
                    last = (b, shingles.of_words(unpacker.decompress(pb).split()))
                sa, sb = shingles.of_words(unpacker.decompress(pa).split()), last[1]
                common = len(np.intersect1d(sa, sb, assume_unique=True)) if whole * min(len(sa), len(sb)) >= part * max(len(sa), len(sb)) else 0
                if whole * common >= part * (len(sa) + len(sb) - common):
                    linked.append((a, b))
            yield pd.DataFrame(linked, columns=["a", "b"])

    hot = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")).where("parts > 1")
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "parts"), F.lit(0)).cast("int").alias("part"))
    at_a = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    at_b = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")).join(hot, "b", "left")
    at_b = at_b.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = dealt.join(at_a, "a").join(at_b, ["b", "part"]).select("a", "b", "pa", "pb")
    return map_frames(met, run, "a long, b long")


def _met(nodes: pd.DataFrame, width: int, similarity: tuple[int, int]) -> pd.DataFrame:
    """Links between the components of a bucket's largest one's outsiders (``side`` 1) of
    one block and the nodes (``side`` 0) of another."""
    part, whole = similarity
    shingles, unpacker = Shingles(width), zstandard.ZstdDecompressor()
    sets = [shingles.of_words(unpacker.decompress(x).split()) for x in nodes["packed"]]
    sizes = np.array([len(s) for s in sets])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(where, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[order]
    begin = np.searchsorted(where[order], np.arange(len(every) + 1))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    _, label = np.unique(nodes["label"], return_inverse=True)
    label = label.astype(np.int64)
    side, node = nodes["side"].to_numpy(), nodes["node"].to_numpy()
    links = []
    # nodes of rare components first: the largest one then has nothing left to ask
    for a in np.argsort(np.bincount(label)[label], kind="stable"):
        open_ = (label != label[a]) & (side != side[a])
        if not open_.any():
            continue
        own = where[starts[a] : starts[a + 1]]
        found = np.concatenate([holders[begin[x] : begin[x + 1]] for x in own])
        common = np.bincount(found, minlength=len(sets))
        for b in np.flatnonzero(open_ & (whole * common >= part * (sizes + sizes[a] - common))):
            if label[b] != label[a]:
                links.append((node[a], node[b]))
                label[label == label[b]] = label[a]
    return pd.DataFrame(links, columns=["a", "b"])


def _linkable(crowd: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The nodes that share a shingle of their rarest with a node of another component.

    crowd: (node, n, label), a row a node.
    """
    part, whole = similarity

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, unpacker = Shingles(width), zstandard.ZstdDecompressor()
        for pdf in frames:
            sets = [shingles.of_words(unpacker.decompress(x).split()) for x in pdf["packed"]]
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), [len(s) for s in sets]), "shingle": np.concatenate(sets).view(np.int64)})

    spread = map_frames(crowd.select("node").join(texts, "node"), run, "node long, shingle long", rows=100)
    held = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = spread.join(held, "shingle").join(crowd, "node")
    by_node = Window.partitionBy("node")
    # shingles of one node alone come before all others and lead nowhere
    first = F.col("n") - F.floor((part * F.col("n") + whole - 1) / whole) + 1 - (F.col("n") - F.count(F.lit(1)).over(by_node))
    rarest = shared.withColumn("first", first).withColumn("place", F.row_number().over(by_node.orderBy("held", "shingle"))).where("place <= first")
    mixed = rarest.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    return rarest.join(mixed, "shingle", "left_semi").select("node").distinct()


def _labels(members: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame | None:
    """(node, label) of nodes linked with another; None if there is no link.

    members: (key, node, n) for buckets of two nodes or more.
    """
    part, whole = similarity
    alike = whole * F.least("n", "other_n") >= part * F.greatest("n", "other_n")
    led = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"))
    met = members.join(led, "key").select("node", "n", F.col("lead.node").alias("other"), F.col("lead.n").alias("other_n")).where(F.col("node") != F.col("other"))
    # the leader is b: pairs with one leader meet in one place
    tested = cut(met.where(alike).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    links = cut(_verified(tested, texts, width, similarity))
    labels = None if links.isEmpty() else components(links)
    now = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = now.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "size")
    open_ = cut(now.join(held, "key"))
    if open_.isEmpty():
        return labels
    small = open_.where(F.col("size") <= SMALL)
    other = small.select("key", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"))
    pairs = small.join(other, "key").where((F.col("other") < F.col("node")) & (F.col("label") != F.col("other_label")) & alike)
    pairs = cut(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    more = _verified(pairs, texts, width, similarity)
    # a node meets every block of outsiders, an outsider every block of nodes
    crowd = open_.where(F.col("size") > SMALL)
    if not crowd.isEmpty():
        crowd = cut(crowd.join(_linkable(crowd.select("node", "n", "label").distinct(), texts, width, similarity), "node", "left_semi"))
    by_label = crowd.groupBy("key", "label").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("sum"))
    largest = by_label.groupBy("key").agg(F.max(F.struct("held", "label", "sum")).alias("top"), F.sum("held").alias("every"), F.sum("sum").alias("sum")).where("every > top.held")
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES))
    largest = largest.select("key", F.col("top.label").alias("main"), blocks(F.col("every"), F.col("sum")).alias("blocks"), blocks(F.col("every") - F.col("top.held"), F.col("sum") - F.col("top.sum")).alias("apart"))
    sized = crowd.join(largest, "key")
    place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).alias("own")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    inside = sized.select("key", "node", "label", place(F.col("blocks")).alias("one"), each("apart").alias("two"), F.lit(0).alias("side"))
    outside = sized.where("label <> main").select("key", "node", "label", each("blocks").alias("one"), place(F.col("apart")).alias("two"), F.lit(1).alias("side"))
    paired = inside.unionByName(outside)
    large = paired.join(texts, "node").groupBy("key", "one", "two").applyInPandas(lambda nodes: _met(nodes, width, similarity), "a long, b long")
    found = cut(more.unionByName(large))
    return labels if found.isEmpty() else components(links.unionByName(found))


def _classes(documents: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of each document."""
    profiles = cut(_profiles(documents, width))
    known = profiles.where("doc_id is not null and n_shingles > 0")
    sets = cut(known.groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "keys")).alias("x")).select("node", F.col("x.doc_id").alias("first"), F.col("x.text_key").alias("text_key"), F.col("x.n_shingles").alias("n"), F.col("x.keys").alias("keys")))
    spread = sets.select("node", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = cut(spread.join(shared, "key").select("key", "node", "n"))
    nodes = sets.select("node", F.col("first").alias("component_id"))
    labels = None
    if not members.isEmpty():
        chosen = sets.select("first", "text_key", "node").join(members.select("node").distinct(), "node", "left_semi")
        labels = _labels(members, cut(_texts(documents, chosen)), width, similarity)
    if labels is not None:
        labelled = cut(sets.select("node", "first").join(labels, "node"))
        smallest = labelled.groupBy("label").agg(F.min("first").alias("smallest"))
        joined = labelled.join(smallest, "label").select("node", "smallest")
        nodes = nodes.join(joined, "node", "left").select("node", F.coalesce("smallest", "component_id").alias("component_id"))
    out = profiles.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(nodes, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))


def classes(documents: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each document."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return _classes(documents, width, similarity).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def dedupe(documents: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns; documents without an id stay."""
    gone = _classes(documents, width, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return documents.join(gone, (documents["doc_id"].cast("long") == F.col("gone_id")) & (F.xxhash64(documents["text"]) == F.col("gone_key")), "left_anti")
