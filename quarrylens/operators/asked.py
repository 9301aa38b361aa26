"""Asked rows meet all rows in blocks, without a pair ever being shuffled.

The asked rows lie in the shared folder as sets of 64-bit hashes, in parts of some
``MOST_HASHES``.  Each task over the other rows reads a part, inverts it and meets it with
one page of its rows after the other; a page has as many rows as give ``CELLS`` pairs at
most, so memory is bounded by a part and a page.  What a task gives are the pairs that are
results, or the first few of each asked row.  Where only like sets count, ``Prefixes``
looks at the rarest hashes of both and counts the others of few pairs alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylens.sources.shared import folder

#: Hashes of a part of the asked rows, and their rows, at most on the whole.
MOST_HASHES, MOST_ROWS = 20_000_000, 100_000
#: Pairs of a page, at most; the common hashes that meet as a matrix.
CELLS, DENSE = 1_000_000, 192
#: Tasks for each core that give the first rows of all asked ones.
TASKS = 4
#: Rows that wait before the first ones are chosen anew.
WAITING = 300_000
#: Hits and hashes that are looked at in one go, at most but for those of one row.
HITS = 2_000_000
#: Of the hashes that like sets must share, the part that their rarest ones have to hold.
RARE = 0.2


def hashes(values: Column) -> Column:
    return F.transform(values, lambda x: F.xxhash64(x))


class Sets:
    """Lists of hashes of some rows: the values one after the other, the row of each, and
    how many each row has."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self) -> np.ndarray:
        """The sum of each row's hashes in 64 bits, which stands for its set."""
        ends = np.cumsum(self.sizes)
        whole = np.r_[np.uint64(0), np.cumsum(self.values.astype(np.int64).view(np.uint64))]
        return whole[ends] - whole[ends - self.sizes]


class Words(Sets):
    """The words of texts, cut at white space of ASCII as by ``\\s+`` in Spark, each once.
    They are numbered: ``words`` has the hash of each number."""

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(texts)
        own = cut.flatten().dictionary_encode()
        self.words = pd.util.hash_array(own.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
        row, number = np.repeat(np.arange(len(cut)), cut.value_lengths().fill_null(0)), own.indices.to_numpy()
        full = number != pc.index(own.dictionary, "").as_py()
        key = np.sort(row[full] * max(1, len(self.words)) + number[full])
        self.rows, self.numbers = np.divmod(key[np.diff(key, prepend=-1) != 0], max(1, len(self.words)))
        self.sizes = np.bincount(self.rows, minlength=len(cut))
        self.values = self.words[self.numbers]

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.sizes)], pa.int32()), pa.array(self.values))

    def take(self, rows: np.ndarray) -> Words:
        out = Words.__new__(Words)
        at = spread((np.cumsum(self.sizes) - self.sizes)[rows], self.sizes[rows])
        out.words, out.numbers, out.values, out.sizes = self.words, self.numbers[at], self.values[at], self.sizes[rows]
        out.rows = np.repeat(np.arange(len(rows)), out.sizes)
        return out


class Inverted:
    """The asked rows' hashes, each with the rows that hold it and a weight of its own."""

    def __init__(self, own: Sets, weights: np.ndarray | None = None):
        self.n, self.sizes = len(own.sizes), own.sizes
        self.words, first, number = np.unique(own.values, return_index=True, return_inverse=True)
        self.weights = None if weights is None else weights[first]
        self.held = np.bincount(number, minlength=len(self.words))
        self.owners = own.rows[np.argsort(number, kind="stable")]
        self.begins = np.cumsum(self.held) - self.held
        most = np.argsort(-self.held, kind="stable")[:DENSE]
        most = most[self.held[most] * 64 > self.n]
        self.place = np.full(len(self.words), -1)
        self.place[most] = np.arange(len(most))
        self.dense = np.zeros((len(most), self.n), dtype=np.float32 if weights is None else np.float64)
        at = self.place[number]
        self.dense[at[at >= 0], own.rows[at >= 0]] = 1

    def known(self, page: Sets) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the page's values that any asked row holds."""
        if not len(self.words) or not len(page.values):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, page.values), len(self.words) - 1)
        same = self.words[at] == page.values
        return page.rows[same], at[same]

    def sums(self, n: int, rows: np.ndarray, numbers: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """A matrix of ``n`` rows and the asked ones: the sum of the values they share."""
        place = self.place[numbers]
        common, rare = place >= 0, place < 0
        left = np.zeros((n, len(self.dense)), dtype=self.dense.dtype)
        left[rows[common], place[common]] = 1 if values is None else values[common]
        out = left @ self.dense if len(self.dense) else np.zeros((n, self.n), dtype=self.dense.dtype)
        held = self.held[numbers[rare]]
        if total := int(held.sum()):
            before = np.repeat(np.cumsum(held) - held, held)
            owner = self.owners[np.repeat(self.begins[numbers[rare]], held) + np.arange(total) - before]
            cells = np.repeat(rows[rare], held) * self.n + owner
            own = None if values is None else np.repeat(values[rare], held)
            if total * 8 < n * self.n and own is None:
                cells, times = np.unique(cells, return_counts=True)
                out.reshape(-1)[cells] += times
            else:
                out += np.bincount(cells, own, minlength=n * self.n).reshape(n, self.n)
        return out

    def shared(self, page: Sets) -> np.ndarray:
        """How many values each row of a page has in common with each asked row."""
        return self.sums(len(page.sizes), *self.known(page))


def needed(sizes: np.ndarray, above: float) -> np.ndarray:
    """How many values a set must share with another, at least, for a Jaccard of ``above``
    or more; never too many by a rounded product."""
    return np.floor(above * sizes * 0.9999).astype(np.int64) + 1


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``begins``, ``begins`` + 1, … of runs of ``counts``, run after run."""
    return np.arange(int(counts.sum())) + np.repeat(begins - np.cumsum(counts) + counts, counts)


def cuts(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` in all, or of one row."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


class Prefixes:
    """The asked rows' sets, to find those with a Jaccard of ``above`` or more to others.

    Sets that are alike share ``needed`` values, so among the rarest values of both, less
    all but k of those, they share k.  Only these values are inverted, and only pairs that
    share so many of them are counted as a whole.  Rare is what few asked rows hold.
    """

    def __init__(self, own: Sets, above: float):
        self.above, self.order = above, np.argsort(own.sizes, kind="stable")
        self.sizes = own.sizes[self.order]
        self.need, self.rare = self.prefix(self.sizes)
        self.words, number = np.unique(own.values, return_inverse=True)
        self.rank = self.inverse(np.argsort(np.bincount(number, minlength=len(self.words)), kind="stable"))
        row, word = self.sorted(self.inverse(self.order)[own.rows], self.rank[number])
        self.begins, self.values = np.cumsum(self.sizes) - self.sizes, word.astype(np.int32)
        first = np.arange(len(row)) - self.begins[row] < (self.sizes - self.need + self.rare)[row]
        row, word = row[first], word[first]
        self.owners = row[np.argsort(word, kind="stable")].astype(np.int32)
        self.held = np.bincount(word, minlength=len(self.words))
        self.opens = np.cumsum(self.held) - self.held
        self.marks = np.zeros(len(self.words), dtype=np.uint8)

    def prefix(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        need = needed(sizes, self.above)
        return need, 1 + (RARE * (need - 1)).astype(np.int64)

    @staticmethod
    def inverse(order: np.ndarray) -> np.ndarray:
        out = np.empty_like(order)
        out[order] = np.arange(len(order))
        return out

    def sorted(self, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(np.sort(rows * max(1, len(self.words)) + words), max(1, len(self.words)))

    def alike(self, page: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, asked row, how many values they share) of all pairs that are so much alike
        and some that are less, each once."""
        n, none = len(page.sizes), np.zeros(0, dtype=np.int64)
        if not len(self.words) or not len(page.values):
            return none, none, none
        order = np.argsort(page.sizes, kind="stable")
        sizes = page.sizes[order]
        need, rare = self.prefix(sizes)
        at = np.minimum(np.searchsorted(self.words, page.words), len(self.words) - 1)
        word = np.where(self.words[at] == page.words, self.rank[at], -1)[page.numbers]
        row, word = self.sorted(self.inverse(order)[page.rows[word >= 0]], word[word >= 0])
        known = np.bincount(row, minlength=n)
        begins = np.cumsum(known) - known
        first = np.arange(len(row)) - begins[row] < np.where(known >= need, known - need + rare, 0)[row]
        ends, hits = np.cumsum(np.bincount(row[first], minlength=n)), word[first]
        hit_rows, found = row[first], []
        step = max(1, CELLS // len(self.sizes))
        for start in range(0, n, step):
            stop = min(n, start + step)
            low, high = np.searchsorted(self.sizes, need[start]), np.searchsorted(self.need, sizes[stop - 1], "right")
            own = slice(ends[start - 1] if start else 0, ends[stop - 1])
            if low >= high or own.start == own.stop:
                continue
            shared = self.counted(hit_rows[own] - start, hits[own], stop - start, low, high)
            cells = np.flatnonzero(shared >= max(1, min(rare[start], self.rare[low])))
            r, a = np.divmod(cells, high - low)
            r, a = r + start, a + low
            likely = (shared[cells] >= np.minimum(rare[r], self.rare[a])) & (need[r] <= self.sizes[a]) & (self.need[a] <= sizes[r])
            r, a = r[likely], a[likely]
            both = self.whole(r, a, word, begins, known)
            enough = both >= np.maximum(need[r], self.need[a])
            found.append((order[r[enough]], self.order[a[enough]], both[enough]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none)

    def counted(self, rows: np.ndarray, words: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
        """How many of the given values each of ``n`` rows shares with each asked row from
        ``low`` to ``high``, row after row."""
        out = None
        for start, stop in cuts(held := self.held[words], HITS):
            owner = self.owners[spread(self.opens[words[start:stop]], held[start:stop])] - low
            cells = np.repeat(rows[start:stop] * (high - low), held[start:stop]) + owner
            cells = cells[(owner >= 0) & (owner < high - low)]
            own = np.bincount(cells, minlength=n * (high - low))
            out = own if out is None else out + own
        return out

    def whole(self, r: np.ndarray, a: np.ndarray, word: np.ndarray, begins: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many values the pairs of rows ``r``, in order, and asked rows ``a`` share."""
        both = np.zeros(len(r), dtype=np.int64)
        opens = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else []
        for start, stop in zip(opens, np.r_[opens[1:], len(r)] if len(r) else [], strict=True):
            own = word[begins[r[start]] : begins[r[start]] + known[r[start]]]
            self.marks[own] = 1
            for x, y in cuts(sizes := self.sizes[a[start:stop]], HITS):
                at = self.values[spread(self.begins[a[start + x : start + y]], sizes[x:y])]
                both[start + x : start + y] = np.add.reduceat(self.marks[at], np.cumsum(sizes[x:y]) - sizes[x:y], dtype=np.int64)
            self.marks[own] = 0
        return both


class Best:
    """The first ``most`` rows of each asked row by (score, id), and what it takes to be one."""

    def __init__(self, n: int, most: int, least: float):
        self.n, self.most, self.least = n, most, np.full(n, least)
        #: The last id that counts with just that score.
        self.last = np.full(n, np.iinfo(np.int64).max)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, asked: np.ndarray, score: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
        self.rows.append((asked, score, ids, *more))
        self.waiting += len(asked)
        if self.waiting > max(WAITING, 2 * self.n * self.most):
            self.chosen()
            self.waiting = 0

    def may(self, asked: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of these rows are among the first, as far as is known."""
        return (score > self.least[asked]) | ((score == self.least[asked]) & (ids <= self.last[asked]))

    def chosen(self) -> tuple[np.ndarray, ...] | None:
        if not self.rows:
            return None
        every = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        order = np.lexsort((every[2], -every[1], every[0]))
        asked = every[0][order]
        opens = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(asked)) - np.repeat(opens, np.diff(np.r_[opens, len(asked)]))
        kept = tuple(c[order][place < self.most] for c in every)
        last = asked[place == self.most - 1]
        self.least[last] = np.maximum(self.least[last], every[1][order][place == self.most - 1])
        self.last[last] = every[2][order][place == self.most - 1]
        self.rows = [kept]
        return kept


def stored(asked: DataFrame, id_: str, sizes: list[str]) -> list[str]:
    """The parts of the asked rows in the shared folder."""
    at = folder(asked.sparkSession)
    size = sum((F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") for c in sizes), F.lit(0).cast("long"))
    whole = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("hashes")).first()  # two numbers
    parts = max(1, -(-whole.n // MOST_ROWS), -(-(whole.hashes or 0) // MOST_HASHES))
    asked.withColumn("part", F.pmod(F.xxhash64(id_), F.lit(parts))).repartition(parts, "part").write.partitionBy("part").parquet(at)
    return [f"{at}/part={k}" for k in range(parts)]


def read(path: str) -> pa.Table:
    files, place = fs.FileSystem.from_uri(path)
    if files.get_file_info(place).type == fs.FileType.NotFound:
        return pa.table({})
    return pads.dataset(place, filesystem=files, format="parquet").to_table().combine_chunks()


#: What a Python worker made of the part that it read last.
_made: dict[str, Any] = {}


def made(path: str, build: Callable[[pa.Table], Any]) -> Any:
    if path not in _made:
        _made.clear()
        table = read(path)
        _made[path] = build(table) if table.num_rows else None
    return _made[path]


def meet(rows: DataFrame, parts: list[str], run: Callable[[Any, Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, build: Callable[[pa.Table], Any] | None = None) -> DataFrame:
    """``run(asked, pages)`` over all rows, once for each part of the asked rows; columns
    that it yields become rows of ``schema``.  With ``build``, ``run`` gets what that makes
    of a part, once in each worker, and the rows in batches as they come, in ``TASKS`` tasks
    a core at most: each task gives a few rows of each asked one, so their number grows with
    the asked rows alone."""
    if build:
        rows = rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    kind = to_arrow_schema(StructType.fromDDL(schema))
    out = None
    for path in parts:

        def over(batches: Iterator[pa.RecordBatch], path: str = path) -> Iterator[pa.RecordBatch]:
            if build:
                asked, pages = made(path, build), (batch for batch in batches if batch.num_rows)
            else:
                asked = read(path)
                step = max(1, CELLS // max(1, asked.num_rows))
                pages = (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step))
            if asked is not None and (build or asked.num_rows):
                for found in run(asked, pages):
                    yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type, from_pandas=False) for f in kind], schema=kind)

        own = rows.mapInArrow(over, schema)
        out = own if out is None else out.unionByName(own)
    return out
