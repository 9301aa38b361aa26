"""Token ids in binary files: independent zstandard frames with a trailing seek table.

A shard holds whole documents in ascending ``doc_id`` order:

    one zstandard frame per document: its ids, little-endian unsigned 32-bit
    a skippable frame (0x184D2A50) with the 64-bit document ids
    a skippable frame (0x184D2A5E) with the seek table of the published seekable
    format: compressed size, size and checksum (low half of XXH64) of each frame

so any zstandard decoder reads a shard as one stream of ids, and a reader of single
documents fetches the tail, finds the frame and decompresses that alone.

Scale: documents are range-partitioned by id once (the only shuffle of texts); a task
sorts its range, and closes a shard after ``SHARD_BYTES``, so memory is bounded by a
batch and a shard.  Files appear under their final name by a rename, so a task that is
run again replaces its own shards.

Edge cases: null and empty texts give the end id alone; rows with the same id each keep
a frame, ordered by text; null ids come first; extra columns are ignored; an empty
table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import joined, map_frames, shared_folder
from quarrylens.llm.library_words import library_codes

END_ID = 1
#: Compressed bytes after which a shard is closed.
SHARD_BYTES = 8_000_000
#: Fixed values of the seekable zstandard format.
SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER, HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
#: Stands for a null document id.
NO_ID = -(2**63)

MANIFEST = "shard string, first_id long, n_docs long, n_tokens long"
READ = "doc_id long, shard string, place long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Collects the frames of a shard; ``finish`` gives its bytes."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.entries: list[bytes] = []
        self.doc_ids: list[int] = []
        self.size = self.n_ids = 0
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=False)

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.frames.append(frame)
        self.entries.append(ENTRY.pack(len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.size += len(frame)
        self.n_ids += len(ids) // 4

    def finish(self) -> bytes:
        names = np.array(self.doc_ids, dtype="<i8").tobytes()
        seek = b"".join(self.entries) + FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEK_MAGIC)
        return b"".join([*self.frames, HEAD.pack(SKIPPABLE_IDS, len(names)), names, HEAD.pack(SKIPPABLE_SEEK, len(seek)), seek])


class ShardReader:
    """Reads the tail of a shard, then only the frames asked for."""

    def __init__(self, path: str):
        self.files, place = fs.FileSystem.from_uri(path)
        self.file = self.files.open_input_file(place)
        size = self.file.size()
        n, _, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        seek_at = size - FOOTER.size - n * ENTRY.size
        self.entries = np.frombuffer(self._at(seek_at, n * ENTRY.size), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.doc_ids = np.frombuffer(self._at(seek_at - HEAD.size - 8 * n, 8 * n), dtype="<i8")
        self.starts = np.concatenate(([0], np.cumsum(self.entries[:, 0])))
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        """The ids of the k-th document, checked."""
        size, check = int(self.entries[k, 1]), int(self.entries[k, 2])
        ids = self.unpacker.decompress(self._at(int(self.starts[k]), int(self.entries[k, 0])), max_output_size=size)
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return ids

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(place, doc_id, ids) of all or of the wanted documents."""
        chosen = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)))
        for k in chosen:
            yield int(k), int(self.doc_ids[k]), self.frame(int(k))

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def publish(path: str, data: bytes) -> None:
    """The file appears whole, and a later attempt takes the place of an earlier one."""
    files, place = fs.FileSystem.from_uri(path)
    draft = f"{place}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as f:
        f.write(data)
    if not isinstance(files, fs.LocalFileSystem) and files.get_file_info(place).type != fs.FileType.NotFound:
        files.delete_file(place)
    files.move(draft, place)


def write(documents: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> str:
    """Write all documents' ids below a shared folder; returns that folder.

    ``folder/shards`` holds the binary files, ``folder/manifest`` a row for each.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    files, place = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{place}/shards", recursive=True)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, writer = TaskContext.get().partitionId(), 0, ShardWriter()
        codes = library_codes(path)

        def closed() -> pa.RecordBatch:
            nonlocal shard, writer
            name = f"part-{part:06d}-{shard:05d}.ids.zst"
            publish(f"{folder}/shards/{name}", writer.finish())
            row = [[name], [writer.doc_ids[0]], [len(writer.doc_ids)], [writer.n_ids]]
            shard, writer = shard + 1, ShardWriter()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in joined(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codes.runs(batch.column("text")), strict=True):
                writer.add(doc_id, ids + end)
                if writer.size >= SHARD_BYTES:
                    yield closed()
        if writer.doc_ids:
            yield closed()

    ranged = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document, from the files: its shard, its place in it and its ids'
    number and crc32; ``start`` counts the ids of all documents before it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, before in zip(pdf["shard"], pdf["before"], strict=True):
                with ShardReader(f"{folder}/shards/{name}") as shard:
                    rows = [(pd.NA if doc_id == NO_ID else doc_id, name, k, len(ids) // 4, zlib.crc32(ids)) for k, doc_id, ids in shard.documents()]
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")]).astype({"doc_id": "Int64"})
                out.insert(1, "start", before + out["n_tokens"].cumsum() - out["n_tokens"])
                yield out

    # shards are a few rows for many megabytes each; their names follow the order of ids
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = manifest.select("shard", before.alias("before")).repartition(max(4, spark.sparkContext.defaultParallelism * 2), "shard")
    return map_frames(spread, run, "doc_id long, start long, " + READ.split(", ", 1)[1]).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "place")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in ``wanted.doc_id``; other frames stay packed."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    following = F.lead("first_id").over(Window.orderBy("shard"))
    ranges = manifest.select("shard", "first_id", following.alias("next_id"))
    known = manifest.where(F.col("first_id") > NO_ID).agg(F.min("first_id").alias("low"), F.max("first_id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, bins = float(known.low or 0), max(known.n, 1)
    width = max((float(known.high or 0) - low) / bins, 1.0)
    # as many stretches of ids as shards: an id and a shard that may hold it meet in one
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((F.col(c).cast("double") - low) / width)))
    dealt = ranges.withColumn("bin", F.explode(F.sequence(place("first_id"), F.coalesce(place("next_id"), F.lit(bins)))))
    ids = wanted.select(F.col("doc_id").cast("long")).distinct().withColumn("bin", place("doc_id"))
    inside = (F.col("doc_id") >= F.col("first_id")) & (F.col("next_id").isNull() | (F.col("doc_id") <= F.col("next_id")))
    asked = ids.join(dealt, "bin").where(inside).groupBy("shard").agg(F.collect_set("doc_id").alias("doc_ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, doc_ids in zip(pdf["shard"], pdf["doc_ids"], strict=True):
                with ShardReader(f"{folder}/shards/{name}") as shard:
                    yield pd.DataFrame([(d, x) for _, d, x in shard.documents(doc_ids)], columns=["doc_id", "ids"])

    return map_frames(asked, run, "doc_id long, ids binary")
