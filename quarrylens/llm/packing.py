"""Packing of documents into windows of ``size`` tokens by sum-of-squares placement.

Each task packs its own documents online.  A document's full windows are cut off first;
what remains goes to the fill level that makes the sum of the squared numbers of windows
at each level smallest, a new window being one of the choices.  ``Levels`` keeps those
numbers in an array and the windows of a level in a list, so a placement is one pass over
an array of ``size`` numbers.  A window that is full leaves the task's memory.  When more
than ``most_open`` windows are open, and at the end, the open windows are laid one after
the other and cut at ``size``, so that no place stays empty; less than a window is left of
a task.  These rests of all tasks are laid one after the other likewise, and the last of
them is cut at powers of two, which need no padding.

Scale: one pass over whole texts, no shuffle of theirs; a task holds ``most_open`` windows
at most; places of the tasks' rests come from a sum over one row a task.  The pieces are a
table in the shared folder, so numbers of sequences don't change when executors are lost.

Edge cases: null and empty texts are the end id alone; a null id stays null; repeated rows
are packed each on its own; a text longer than a window fills windows of its own but for
its rest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.byte_codes import loaded
from quarrylens.llm.common import cut, map_frames

SIZE, END_ID, MOST_OPEN = 2048, 1, 4000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: A piece: doc_id, start, doc_tokens, ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Levels:
    """Open windows by fill level: ``count[h]`` windows hold ``h`` tokens."""

    def __init__(self, size: int):
        self.size, self.open = size, 0
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]

    def level_for(self, n: int) -> int:
        """The level (0: a new window) whose window grows by ``n`` at the least sum of
        squares; the fullest of equals."""
        count = self.count
        at, to = count[1 : self.size - n + 1], count[n + 1 : self.size + 1]
        # leaving a level of c windows takes 2c-1 off the sum, reaching one adds 2c+1
        change = np.where(at > 0, 2 * (to - at) + 2, np.iinfo(np.int64).max)
        if at[-1:].any():
            change[-1] -= 1  # a full window is at no level
        k = len(change) - 1 - int(change[::-1].argmin()) if len(change) else -1
        return k + 1 if k >= 0 and change[k] <= 2 * count[n] + 1 else 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece into a window; the window if it's full then."""
        n = len(piece[3])
        h = self.level_for(n)
        window = self.windows[h].pop() if h else []
        window.append(piece)
        if h:
            self.count[h] -= 1
            self.open -= 1
        if h + n == self.size:
            return window
        self.windows[h + n].append(window)
        self.count[h + n] += 1
        self.open += 1
        return None

    def emptied(self) -> list[Piece]:
        """The pieces of all open windows, fuller windows first."""
        every = [piece for level in reversed(self.windows) for window in level for piece in window]
        self.__init__(self.size)
        return every


def laid(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """The pieces one after the other, cut into full windows, and what is left."""
    full: list[list[Piece]] = []
    window: list[Piece] = []
    held = 0
    for doc_id, start, total, ids in pieces:
        while len(ids):
            own = ids[: size - held]
            window.append((doc_id, start, total, own))
            held, start, ids = held + len(own), start + len(own), ids[len(own) :]
            if held == size:
                full.append(window)
                window, held = [], 0
    return full, window


def ends_of(total: int, size: int) -> list[int]:
    """Where the sequences in the last, not full window of a run of ``total`` tokens end."""
    at, ends = total - total % size, []
    for bit in reversed(range((total % size).bit_length())):
        if total % size >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def packed(documents: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, most_open: int = MOST_OPEN) -> DataFrame:
    """A row for each piece of a document: its place there and in its sequence, its ids
    (little-endian unsigned 32-bit); a sequence's pieces lie one after the other."""
    columns = [x.split()[0] for x in PIECES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, levels, part, number, rows = loaded(path), Levels(size), TaskContext.get().partitionId(), 0, []

        def lay(window: list[Piece], sequence: int | None) -> None:
            at = 0
            for doc_id, start, total, ids in window:
                rows.append((doc_id, start, len(ids), total, sequence, at, ids.astype("<u4").tobytes()))
                at += len(ids)

        def close(window: list[Piece]) -> None:
            nonlocal number
            lay(window, (part << 32) + number)
            number += 1

        def given() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "sequence_id": "Int64"})
            out.insert(0, "part", part)
            rows.clear()
            return out

        for pdf in frames:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(codes.ids(text), np.uint32(end_id))
                whole = len(ids) - len(ids) % size
                for at in range(0, whole, size):
                    close([(doc_id, at, len(ids), ids[at : at + size])])
                if whole < len(ids) and (window := levels.place((doc_id, whole, len(ids), ids[whole:]))):
                    close(window)
                if levels.open > most_open:
                    full, rest = laid(levels.emptied(), size)
                    for window in full:
                        close(window)
                    for piece in rest:
                        if window := levels.place(piece):
                            close(window)
            if rows:
                yield given()
        full, rest = laid(levels.emptied(), size)
        for window in full:
            close(window)
        lay(rest, None)
        if rows:
            yield given()

    done = cut(map_frames(documents.select(F.col("doc_id").cast("long"), "text"), run, f"part long, {PIECES}"))
    rests = done.where("sequence_id is null")
    sums = rests.groupBy("part").agg(F.sum("length").alias("n"))  # a row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = Window.partitionBy()
    places = sums.select("part", before.alias("before"), F.sum("n").over(over).alias("total"), F.max("part").over(over).alias("last"))

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, start, doc_tokens, at, total, last, ids in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["at"], pdf["total"], pdf["last"], pdf["ids"], strict=True):
                at, total, last = int(at), int(total), int(last)
                ends, whole = ends_of(total, size), total - total % size
                while ids:
                    if at < whole:
                        sequence, begin, end = at // size, at - at % size, at - at % size + size
                    else:
                        k = sum(at >= e for e in ends)
                        sequence, begin, end = whole // size + k, ends[k - 1] if k else whole, ends[k]
                    n = min(end - at, len(ids) // 4)
                    rows.append((doc_id, start, n, doc_tokens, ((last + 1) << 32) + sequence, at - begin, ids[: 4 * n]))
                    at, start, ids = at + n, start + n, ids[4 * n :]
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    placed = rests.join(places, "part").select("doc_id", "start", "doc_tokens", (F.col("before") + F.col("offset")).alias("at"), "total", "last", "ids")
    return done.where("sequence_id is not null").drop("part").unionByName(map_frames(placed, shared, PIECES))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, whose pieces are ``size`` at most."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.concat_ws("", F.transform(ordered, lambda x: F.hex(x["ids"]))).alias("digits")).select("sequence_id", "length", F.unhex("digits").alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned crc32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
