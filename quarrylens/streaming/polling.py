"""Polling of growing log files by byte offset, in batches and as a stream.

``poll`` reads what each log has gained since an offset; ``LogTail`` is a streaming source
whose offsets are the bytes of each file.  Only the new bytes of a file are read, in
ranges of ``MOST_BYTES`` a row; a task reads many files.  A range never ends inside a character: the
bytes of one that isn't whole yet wait for the next poll, unless the log has ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that one row holds.
MOST_BYTES = 8_000_000
#: Bytes and files of a task of the stream.
PART_BYTES, PART_FILES = 32_000_000, 500
CHUNK = "file string, offset long, content string, next_offset long"
#: The states in which a run's log grows no more.
ENDED = ("completed", "failed", "cancelled")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def tail_of(data: bytes) -> int:
    """How many bytes at the end belong to a character that isn't whole."""
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 != 0x80:  # a character's first byte, which tells its length
            size = 1 if byte < 0x80 else 2 if byte >> 5 == 0b110 else 3 if byte >> 4 == 0b1110 else 4 if byte >> 3 == 0b11110 else 1
            return back if size > back else 0
    return 0


def whole_end(file, begin: int, end: int) -> int:
    """The last place up to ``end`` at which a character ends."""
    start = max(begin, end - 4)
    file.seek(start)
    return end - tail_of(file.read(end - start))


def ranges(file, begin: int, end: int, most: int = MOST_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole characters from ``begin`` to ``end``."""
    while begin < end:
        to = end if end - begin <= most else whole_end(file, begin, begin + most)
        to = to if to > begin else min(end, begin + most)
        yield begin, to
        begin = to


def poll(logs: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(run_id, offset, content, next_offset, eof): what each log has gained.

    logs: (run_id, log_path, status, offset).  A log without a path, without a file or
    with nothing new has one row with empty content and the offset it came with; a
    negative offset is the beginning.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for run_id, path, status, offset in zip(pdf["run_id"], pdf["log_path"], pdf["status"], pdf["offset"], strict=True):
                offset, ended, rows = max(int(offset), 0), status in ENDED, []
                if path and path.strip():
                    files, place = opened(path)
                    if files.get_file_info(place).is_file:
                        with files.open_input_file(place) as file:
                            size = file.size()
                            end = size if ended or size <= offset else whole_end(file, offset, size)
                            for begin, to in ranges(file, offset, end, most):
                                file.seek(begin)
                                rows.append((run_id, begin, file.read(to - begin).decode("utf-8", "replace"), to, ended and to == size))
                yield pd.DataFrame(rows or [(run_id, offset, "", offset, ended)], columns=["run_id", "offset", "content", "next_offset", "eof"])

    kind = logs.schema["run_id"].dataType.simpleString()
    return logs.select("run_id", "log_path", "status", F.coalesce(F.col("offset").cast("long"), F.lit(0)).alias("offset")).mapInPandas(run, f"run_id {kind}, offset long, content string, next_offset long, eof boolean")


class Ranges(InputPartition):
    """What is new of some files: (path, bytes before, bytes now) of each."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class Tail(DataSourceStreamReader):
    """Offsets: the bytes that each file had when it was listed.

    Logs only grow, so the last whole character before an offset is the same whenever it is
    looked for: tasks look for it, and the driver lists files without opening any.
    """

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("maxbytes", MOST_BYTES))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files, place = opened(self.root)
        ends = {}
        for info in files.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.is_file and not name.startswith((".", "_")):
                ends[info.path] = info.size
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before, parts, room = json.loads(start["files"]), [[]], PART_BYTES
        for path, to in json.loads(end["files"]).items():
            begin = before.get(path, 0)
            # long logs are cut where rows of ``most`` bytes would be, give or take a character
            while begin < to:
                if room <= 0 or len(parts[-1]) >= PART_FILES:
                    parts.append([])
                    room = PART_BYTES
                upto = min(to, begin + max(self.most, PART_BYTES))
                parts[-1].append((path, begin, upto))
                room -= upto - begin
                begin = upto
        return [Ranges(x) for x in parts if x]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        files, _ = opened(self.root)
        for path, begin, end in partition.files:
            with files.open_input_file(path) as file:
                begin, end = (whole_end(file, 0, x) for x in (begin, end))
                for a, b in ranges(file, begin, end, self.most):
                    file.seek(a)
                    yield path, a, file.read(b - a).decode("utf-8", "replace"), b

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(folder)``: the new content of each file."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return CHUNK

    def streamReader(self, schema: StructType) -> Tail:
        return Tail(self.options)


def tail(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """A stream of (file, offset, content, next_offset) of the logs below a folder."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("maxbytes", most).load(folder)
