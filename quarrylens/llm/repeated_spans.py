"""Exact removal of long repeats by a logarithmic family of sparse suffix arrays.

Of all suffixes of all texts those at content-defined anchors are indexed: every string
of ``LENGTH`` bytes has one anchor, and equal strings have it at the same offset.  A
table is dealt to batches of documents.  Each gets a suffix array, a stored table in
buckets, sorted by the first four bytes of its suffixes and a fingerprint of their first
``GRAM`` (all that has to lie side by side), with a fingerprint of all bytes of the
windows that an anchor answers for, its context.  The array is merge-scanned against
each level that is there; what both hold is a match.  Then levels of equal size merge.
(A full suffix array sorts every byte's suffix, some seventy times as many; README has
the figures.)

A key without a match rules out that any of its windows repeats.  A key whose contexts
are all equal settles all of its windows.  For the rest one text of each context is
fetched, and its windows are counted by fingerprints: groups of ``GROUP`` at once first,
single windows where groups agree in part.  What is found goes back to the documents'
blocks, which remove the covered bytes.

Scale: an entry of some 20 bytes for about 70 bytes of text is shuffled once and stored
once for each doubling of the levels; scans and merges shuffle nothing.  Texts travel
compressed, twice, by blocks of about ``BLOCK_BYTES``; nothing reaches the driver, and
no key's contexts have to fit a task.  Fingerprints have 64 bits.

Edge cases: null and empty texts, and texts shorter than ``LENGTH``, lose nothing;
repeated rows are copies of each other and both lose what they share; texts that repeat
within themselves lose the repeats; null ids are kept as they are; extra columns are
ignored; a very long text is indexed in segments; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.anchors import Anchors, Prints, mixed
from quarrylens.llm.common import cut, map_frames, shared_folder

LENGTH, GRAM = 200, 40
BLOCK_BYTES = 12_000_000
#: Entries after which a task hands them on.
FLUSH_ENTRIES = 600_000
#: Batches that a table is dealt to; each is scanned against the levels before it.
BATCHES = 4
#: Bytes of text for each bucket of a level, and the most buckets that tables may have.
BUCKET_BYTES, MOST_BUCKETS = 64_000_000, 50_000
#: Windows of a context that are compared together.
GROUP = 20
SCHEMA = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: A suffix: its key, the fingerprint of its windows, the documents' block, and a count.
ENTRY = np.dtype([("key", "<i8"), ("context", "<i8"), ("block", "<i8"), ("n", "<i8")])
HALF = np.uint64(0xFFFFFFFF)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def suffixes(data: np.ndarray, block: int, length: int) -> np.ndarray:
    """The entries of a text's anchors, in the order of the text.

    A key is four bytes in their order, then half a fingerprint of ``GRAM`` bytes; what
    meets by chance is told apart by its context.
    """
    found = Anchors.of(data, length, GRAM)
    out = np.empty(len(found.key), dtype=ENTRY)
    lead = np.zeros(len(out), dtype=np.uint64)
    for i in range(4):
        lead = lead << np.uint64(8) | data[found.place + i]
    out["key"] = ((lead << np.uint64(32) ^ np.uint64(1 << 63)) | (found.key & HALF)).view(np.int64)
    out["context"], out["block"], out["n"] = found.context.view(np.int64), block, 1
    return out


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """Entries of a block that match over all their windows, counted as one."""
    every = np.concatenate(parts)
    every = every[np.lexsort([every["block"], every["context"]])]
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every["context"][1:] != every["context"][:-1]) | (every["block"][1:] != every["block"][:-1])
    out = every[new]
    if len(out):
        out["n"] = np.add.reduceat(every["n"], np.flatnonzero(new))
    return out


def entries(dealt: DataFrame, length: int) -> DataFrame:
    """(key, context, block, n) of all anchors, combined within stretches of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[np.ndarray] = []

        def rows() -> Iterator[pd.DataFrame]:
            every = combined(own)
            own.clear()
            for at in range(0, len(every), 100_000):
                yield pd.DataFrame({c: every[c][at : at + 100_000] for c in ENTRY.names})

        for pdf in frames:
            own += [suffixes(utf8(text), block, length) for block, text in zip(pdf["block"], pdf["text"], strict=True)]
            if sum(map(len, own)) > FLUSH_ENTRIES:
                yield from rows()
        if own:
            yield from rows()

    return map_frames(dealt.select("block", "text"), run, "key long, context long, block long, n long")


class Family:
    """Stored suffix arrays: tables in buckets by key, each sorted, in doubling sizes.

    A new batch becomes a table of its own and is merge-scanned against each level: as
    both are in buckets and sorted by key, the join shuffles nothing.  Then it is merged
    with the levels of its size.  Texts of earlier batches aren't read again.
    """

    COLUMNS = "key", "context", "block", "n"

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.folder = shared_folder(spark)
        self.levels: list[tuple[int, str]] = []
        self.names: list[str] = []

    def _stored(self, entries: DataFrame) -> str:
        name = f"repeats_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name, format="parquet")
        self.names.append(name)
        return name

    def _keys(self, name: str) -> DataFrame:
        return self.spark.table(name).groupBy("key").agg(F.sum("n").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))

    def scan(self, name: str) -> DataFrame:
        """(key, low, high) for keys of the batch that occur twice in it or in a level."""
        new = self._keys(name)
        found = new.where("n >= 2").select("key", "low", "high")
        for _, level in self.levels:
            old = self._keys(level).toDF("key", "m", "lower", "higher")
            both = new.hint("merge").join(old, "key")
            found = found.unionByName(both.select("key", F.least("low", "lower").alias("low"), F.greatest("high", "higher").alias("high")))
        return found

    def add(self, entries: DataFrame) -> DataFrame:
        """Index a batch; what it has in common with itself and all batches before it."""
        sorted_ = entries.repartition(self.buckets, "key").groupBy("key", "context", "block").agg(F.sum("n").alias("n"))
        name, rank = self._stored(sorted_.select(*self.COLUMNS)), 0
        found = cut(self.scan(name))
        equal = []
        while self.levels and self.levels[-1][0] == rank:
            equal.append(self.levels.pop()[1])
            rank += 1
        if equal:
            name = self._stored(reduce(DataFrame.unionByName, map(self.spark.table, [*equal, name])))
        self.levels.append((rank, name))
        return found

    def entries(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.table(name) for _, name in self.levels))

    def drop(self) -> None:
        """Forget the tables; their files go with the application's folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batches(dealt: DataFrame, length: int, batches: int) -> list[DataFrame]:
    """The entries of each batch of blocks, from one pass over the texts."""
    spark = dealt.sparkSession
    path = f"{shared_folder(spark)}/entries-{uuid.uuid4().hex}"
    entries(dealt, length).withColumn("batch", (F.col("block") % batches).cast("int")).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("key long, context long, block long, n long, batch int").parquet(path)
    return [stored.where(F.col("batch") == k).drop("batch") for k in range(batches)]


def _packed(dealt: DataFrame) -> DataFrame:
    """The documents with compressed texts, for the way to their blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            yield pd.DataFrame({"block": pdf["block"], "doc_id": pdf["doc_id"], "packed": [packer.compress(utf8(t).tobytes()) for t in pdf["text"]]})

    return map_frames(dealt, run, "block long, doc_id string, packed binary")


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)


def _fetch(documents: pd.DataFrame, wanted: pd.DataFrame, length: int) -> pd.DataFrame:
    """The bytes of each wanted context and its anchor's place in them, from any of the
    block's documents."""
    wanted = wanted.sort_values("context")
    known, n = wanted["context"].to_numpy(), wanted["n"].to_numpy()
    open_ = np.ones(len(known), dtype=bool)
    out = []
    if len(known):
        for packed in documents["packed"]:
            data = _unpacked(packed)
            found = Anchors.of(data, length, GRAM)
            context = found.context.view(np.int64)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            for k in np.flatnonzero((known[at] == context) & open_[at]):
                if open_[at[k]]:
                    open_[at[k]] = False
                    out.append((int(context[k]), int(n[at[k]]), int(found.place[k] - found.first[k]), data[found.first[k] : found.last[k] + length].tobytes()))
    return pd.DataFrame(out, columns=["context", "n", "anchor", "bytes"])


def _joined(pieces: pd.Series) -> tuple[Prints, np.ndarray, np.ndarray]:
    """Fingerprints over some byte strings laid end to end, their places and sizes."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return Prints(np.frombuffer(b"".join(pieces), dtype=np.uint8)), np.cumsum(sizes) - sizes, sizes


def _groups(contexts: DataFrame, length: int) -> DataFrame:
    """Each context's windows in groups by their distance from the anchor: ``first`` and
    ``last`` window, ``common`` for the bytes that any window of such a group holds, and
    ``span`` for the bytes of all its windows.  Equal windows are in equal groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            prints, base, sizes = _joined(pdf["bytes"])
            anchor, windows = pdf["anchor"].to_numpy(np.int64), sizes - length + 1
            low, high = (length - anchor) // GROUP, (length - anchor + windows - 1) // GROUP
            n = high - low + 1
            of = np.repeat(np.arange(len(pdf)), n)
            group = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
            least = group * GROUP - length + anchor[of]
            most = least + GROUP - 1
            first, last = np.maximum(least, 0), np.minimum(most, windows[of] - 1)
            common = mixed(prints.of(base[of] + most, least + length - most) ^ group.astype(np.uint64))
            place = ((first - least) * GROUP + last - least).astype(np.uint64)
            span = mixed(prints.of(base[of] + first, last - first + length) ^ common ^ place)
            yield pd.DataFrame({
                "context": pdf["context"].to_numpy()[of], "n": pdf["n"].to_numpy()[of], "first": first, "last": last,
                "common": common.view(np.int64), "span": span.view(np.int64),
            })

    return map_frames(contexts, run, "context long, n long, first int, last int, common long, span long")


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """(context, place, n, print) of the windows in ``asked``, runs of (n, first, last)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            prints, base, _ = _joined(pdf["bytes"])
            asked = np.array([(i, x["n"], x["first"], x["last"]) for i, own in enumerate(pdf["asked"]) for x in own], dtype=np.int64)
            of, n, first, last = asked.T
            size = last - first + 1
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
            of, n = np.repeat(of, size), np.repeat(n, size)
            found = prints.of(base[of] + place, length)
            yield pd.DataFrame({"context": pdf["context"].to_numpy()[of], "place": place, "n": n, "print": found.view(np.int64)})

    return map_frames(contexts, run, "context long, place int, n long, print long")


def _resolved(contexts: DataFrame, length: int) -> DataFrame:
    """(context, ranges) of the repeated windows of contexts that occur once.

    A group whose span occurs again repeats as a whole; one whose common bytes occur
    nowhere else has no window that repeats.  Only what is left is compared window by
    window, ``GROUP`` rows for each group.  Everything is counted by fingerprint, so a
    key of very many contexts is in no task as a whole.
    """
    groups = cut(_groups(contexts, length))
    spans = cut(groups.groupBy("span").agg(F.sum("n").alias("n"), F.min("common").alias("common"), F.min(F.struct("context", "first", "last")).alias("at")))
    settled = groups.where("n = 1").join(spans.where("n >= 2").select("span"), "span").select("context", "first", "last")
    shared = spans.groupBy("common").agg(F.count(F.lit(1)).alias("spans")).where("spans >= 2").select("common")
    asked = spans.join(shared, "common").groupBy("at.context").agg(F.collect_list(F.struct("n", "at.first", "at.last")).alias("asked"))
    windows = cut(_windows(contexts.select("context", "bytes").join(asked, "context"), length))
    again = windows.groupBy("print").agg(F.sum("n").alias("total")).where("total >= 2").select("print")
    single = windows.where("n = 1").join(again, "print").select("context", F.col("place").alias("first"), F.col("place").alias("last"))
    return settled.unionByName(single).groupBy("context").agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("ranges"))


def _remove(documents: pd.DataFrame, found: pd.DataFrame, length: int) -> pd.DataFrame:
    """What is left of each document of a block."""
    found = found.sort_values("context").drop_duplicates("context")
    known, ranges = found["context"].to_numpy(), found["ranges"].to_numpy()
    out = []
    for doc_id, packed in zip(documents["doc_id"], documents["packed"], strict=True):
        data = _unpacked(packed)
        edge = np.zeros(len(data) + 1, dtype=np.int64)
        own = Anchors.of(data, length, GRAM)
        if len(known) and len(own.key):
            context = own.context.view(np.int64)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            hit = np.flatnonzero(known[at] == context)
            whole = np.fromiter((len(ranges[k]) == 0 for k in at[hit]), bool, len(hit))
            full = hit[whole]
            np.add.at(edge, own.first[full], 1)
            np.add.at(edge, own.last[full] + length, -1)
            for k in hit[~whole]:
                pairs = np.asarray(ranges[at[k]], dtype=np.int64).reshape(-1, 2) + own.first[k]
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def remove(documents: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, batches: int = BATCHES) -> DataFrame:
    """A row of sizes and digest of what is left for each document."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(4, -(-size // block_bytes)))
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("block")
    # as text the ids come through pandas unchanged, nulls beside them or not
    dealt = documents.select(block, F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    family = Family(spark, int(min(max(16, -(-size // BUCKET_BYTES)), MOST_BUCKETS)))
    matches = reduce(DataFrame.unionByName, [family.add(batch) for batch in _batches(dealt, length, batches)])
    keys = matches.groupBy("key").agg((F.min("low") != F.max("high")).alias("mixed"))
    repeated = cut(family.entries().join(keys, "key"))
    family.drop()
    unsettled = repeated.where("mixed").groupBy("key", "context").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    packed = _packed(dealt)
    fetched = packed.groupBy("block").cogroup(unsettled.groupBy("block")).applyInPandas(lambda d, w: _fetch(d, w, length), "context long, n long, anchor int, bytes binary")
    contexts = cut(fetched)
    found = _resolved(contexts, length)
    whole = F.array().cast("array<int>").alias("ranges")
    several = contexts.where("n >= 2").select("context", whole)
    settled = repeated.where("not mixed").select("block", "context", whole)
    needed = settled.unionByName(repeated.where("mixed").select("block", "context").join(found.unionByName(several), "context").select("block", "context", "ranges"))
    return packed.groupBy("block").cogroup(needed.groupBy("block")).applyInPandas(lambda d, f: _remove(d, f, length), SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
