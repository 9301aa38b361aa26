r"""Conversation structure repair by a min-plus scan of 4x4 matrices.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Its states are: nothing yet,
after the system turn, after a user turn, after an assistant turn.  Each turn is a matrix
over pairs (cost, audit): entry (i, j) is the cheapest edit of the turn that leads from
state i to j, followed by the cheapest insertions (the closure ``INSERTS``); products add
costs and join audits, sums take the least pair, so that ties go to the least audit in
ASCII order.  Two audits of one cost between the same states never are one the beginning
of the other, as they hold one letter a turn and insertions cost; so the least of the
joined is joined of the least, and products are associative.  They are reduced as a tree:
in a task over the turns of a conversation within a chunk of ``CHUNK`` rows, then chunk
over chunk, ``FAN`` at a time, for conversations that reach over several.

Edits: Keep costs nothing, Rerole to user or assistant 1, Delete 2 (and must be, for blank
and duplicate turns), Insert of an empty turn 5; a truncated turn that stays costs 5 more.

Scale: turns are range-partitioned by conversation and turn and numbered in that order, so
that a long conversation lies in many partitions; duplicates are found by a grouping of
digests with map-side aggregation; matrices and audits travel without texts; the texts
are shuffled twice.  The audit of a conversation is one string, as long as its turns.
``digests`` streams the repaired turns of a conversation through one hash, which is
sequential by nature, in bounded memory.

Edge cases: null roles and texts are one space, a null conversation is one of its own;
null turns come first; equal turns are ordered by role and text; roles of other initials
can't be kept; a conversation without rows has zeros and an empty audit; very long texts
are rows of their own size; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, map_frames

#: Rows of a chunk (a power of two) and parts that are joined at a time.
CHUNK_BITS, FAN = 12, 32
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The six characters of white space that words end at.
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
#: States: nothing yet, after s, after u, after a.  A user turn may follow all but u.
START, SYSTEM, USER, ASSISTANT = range(4)
Entry = tuple[int, str] | None
Matrix = list[list[Entry]]
LEGAL = {"su", "ua", "au"}


def least(one: Entry, other: Entry) -> Entry:
    return one if other is None or (one is not None and one <= other) else other


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: costs add, audits join, the least pair stays."""
    out: Matrix = []
    for row in a:
        steps = [(k, x[0], x[1]) for k, x in enumerate(row) if x is not None]
        line: list[Entry] = []
        for j in range(4):
            best: Entry = None
            for k, cost, audit in steps:
                y = b[k][j]
                if y is not None and (best is None or cost + y[0] <= best[0]):
                    best = least((cost + y[0], audit + y[1]), best)
            line.append(best)
        out.append(line)
    return out


def matrix_of(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return [[entries.get((i, j)) for j in range(4)] for i in range(4)]


#: Any number of insertions; more than these never pay.
INSERTS = matrix_of({(i, i): (0, "") for i in range(4)} | {
    (START, USER): (INSERT, "I"), (START, ASSISTANT): (2 * INSERT, "II"), (SYSTEM, USER): (INSERT, "I"), (SYSTEM, ASSISTANT): (2 * INSERT, "II"),
    (USER, ASSISTANT): (INSERT, "I"), (ASSISTANT, USER): (INSERT, "I"),
})


def turn_matrix(initial: str, fault: int) -> Matrix:
    """The edits of a turn with that role's initial, then insertions."""
    entries: dict[tuple[int, int], tuple[int, str]] = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        for before in (START, SYSTEM, ASSISTANT):
            entries[before, USER] = (more, "K") if initial == "u" else (more + REROLE, "R")
        entries[USER, ASSISTANT] = (more, "K") if initial == "a" else (more + REROLE, "R")
        if initial == "s":
            entries[START, SYSTEM] = (more, "K")
    return times(matrix_of(entries), INSERTS)


@dataclass(slots=True)
class Part:
    """Neighbouring turns of a conversation: their product, and what is counted."""

    matrix: Matrix
    rows: int
    faults: tuple[int, int, int]
    illegal: int
    first: str
    last: str
    low: int | None
    high: int | None
    distinct: int

    def joined(self, other: Part) -> Part:
        if not (self.rows and other.rows):
            return self if self.rows else other
        a, b = self.faults, other.faults
        # turns are in order: they overlap in one at most
        both = self.high is not None and self.high == other.low
        return Part(
            times(self.matrix, other.matrix), self.rows + other.rows, (a[0] + b[0], a[1] + b[1], a[2] + b[2]), self.illegal + other.illegal + (self.last + other.first not in LEGAL),
            self.first, other.last, other.low if self.low is None else self.low, self.high if other.high is None else other.high, self.distinct + other.distinct - both,
        )


NO_ROWS = Part(INSERTS, 0, (0, 0, 0), 0, "", "", None, None, 0)


class Reduction:
    """Parts joined as a balanced tree, so that audits are copied a few times only."""

    def __init__(self):
        self.stack: list[tuple[int, Part]] = []
        self.matrices: dict[tuple[str, int], Matrix] = {}

    def add(self, part: Part) -> None:
        size = 1
        while self.stack and self.stack[-1][0] == size:
            part, size = self.stack.pop()[1].joined(part), 2 * size
        self.stack.append((size, part))

    def turn(self, turn: int | None, initial: str, fault: int) -> None:
        if (initial, fault) not in self.matrices:
            self.matrices[initial, fault] = turn_matrix(initial, fault)
        faults = (int(fault == BLANK), int(fault == DUPLICATE), int(fault == CUT_OFF))
        self.add(Part(self.matrices[initial, fault], 1, faults, 0, initial, initial, turn, turn, int(turn is not None)))

    def result(self) -> Part:
        out = reduce(lambda right, left: left.joined(right), (part for _, part in reversed(self.stack)), NO_ROWS)
        self.stack.clear()
        return out


PART = "conv string, chunk long, place long, rows long, costs array<long>, audits array<string>, faults array<long>, illegal long, first string, last string, low long, high long, distinct long"


def row_of(conv: str, chunk: int, place: int, part: Part) -> tuple:
    entries = [x for line in part.matrix for x in line]
    return (conv, chunk, place, part.rows, [-1 if x is None else x[0] for x in entries], ["" if x is None else x[1] for x in entries], list(part.faults), part.illegal, part.first, part.last, part.low, part.high, part.distinct)


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PART.split(", ")]).astype({"low": "Int64", "high": "Int64"})


def parts_of(pdf: pd.DataFrame) -> Iterator[Part]:
    whole = lambda x: None if pd.isna(x) else int(x)
    for r in pdf.itertuples(index=False):
        entries = [None if c < 0 else (int(c), a) for c, a in zip(r.costs, r.audits, strict=True)]
        yield Part([entries[k : k + 4] for k in range(0, 16, 4)], int(r.rows), tuple(map(int, r.faults)), int(r.illegal), r.first, r.last, whole(r.low), whole(r.high), int(r.distinct))


def placed(turns: DataFrame) -> DataFrame:
    """conv (the id as text; one space: null), turn, role, text, copies and ``place``, a
    number in the order of conversations and their turns; a table in the shared folder."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    chosen = turns.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"),
    )
    dealt = chosen.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64))
    return cut(dealt.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").withColumn("place", F.monotonically_increasing_id()))


def _faults(rows: DataFrame) -> DataFrame:
    """conv, place, turn, copies, initial and the first fault of each row, without texts."""
    visible = F.rtrim("text", F.lit(WHITE))
    twin = F.sha2(F.concat_ws(":", "conv", F.length("role"), "role", "text"), 256)
    light = rows.select("conv", "place", "turn", "copies", F.substring("role", 1, 1).alias("initial"), (visible == "").alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("cut_off"), twin.alias("twin"))
    firsts = light.where("copies > 0 and not blank").groupBy("twin").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("earliest"), DUPLICATE).when(F.col("cut_off"), CUT_OFF).otherwise(0)
    return light.join(firsts, "twin", "left").select("conv", "place", "turn", "copies", "initial", fault.alias("fault"))


def chunk_of(place: str) -> Column:
    return F.shiftright(place, CHUNK_BITS)


def _segments(faults: DataFrame) -> DataFrame:
    """A part for each conversation and chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begun, tree = None, 0, Reduction()
        for pdf in frames:
            out = []
            for conv, chunk, place, turn, copies, initial, fault in zip(pdf["conv"], pdf["chunk"], pdf["place"], pdf["turn"], pdf["copies"], pdf["initial"], pdf["fault"], strict=True):
                if key != (conv, chunk):
                    if key:
                        out.append(row_of(*key, begun, tree.result()))
                    key, begun = (conv, chunk), place
                turn = None if turn is pd.NA else turn
                for k in range(copies):
                    tree.turn(turn, initial, fault if k == 0 or fault == BLANK else DUPLICATE)
            if out:
                yield frame_of(out)
        if key:
            yield frame_of([row_of(*key, begun, tree.result())])

    chunked = faults.withColumn("chunk", chunk_of("place"))
    return cut(map_frames(chunked.repartition("chunk").sortWithinPartitions("place"), run, PART))


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reports(parts: DataFrame) -> DataFrame:
    """The result of each conversation, from the part that holds all of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for conv, part in zip(pdf["conv"], parts_of(pdf), strict=True):
                ways = times([INSERTS[START]], part.matrix)[0] if part.rows else INSERTS[START]
                cost, audit = least(ways[START], ways[ASSISTANT])
                gaps = 0 if part.low is None else part.high - part.low + 1 - part.distinct
                rows.append((conv, gaps, *part.faults, part.illegal, cost, audit))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])

    return map_frames(parts, run, REPORT)


def _reduced(segments: DataFrame) -> DataFrame:
    """One part for each conversation of several segments: ``FAN`` neighbours at a time."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        tree = Reduction()
        for part in parts_of(pdf):
            tree.add(part)
        out = frame_of([row_of(pdf["conv"].iloc[0], int(pdf["chunk"].iloc[0]), int(pdf["place"].iloc[0]), tree.result())])
        return out.assign(node=int(pdf["node"].iloc[0]) // FAN)

    now = segments
    while (now.agg(F.max("node").alias("top")).first().top or 0) > 0:  # one number
        now = cut(now.groupBy("conv", F.floor(F.col("node") / FAN).alias("group")).applyInPandas(merge, f"{PART}, node long"))
    return now


HEADERS = "conv string, chunk long, place long, audit string, seat long, odd boolean"


def _headers(reports: DataFrame, segments: DataFrame) -> DataFrame:
    """Each segment's share of its conversation's audit, and the seats taken before it."""
    lists = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "place", "rows"))).alias("segments"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for conv, audit, own in zip(pdf["conv"], pdf["audit"], pdf["segments"], strict=True):
                odd, at, seat = bool((len(audit) - audit.count("D")) % 2), 0, 0
                own = [s for s in own if s["rows"]]
                for s in own:
                    begin, left = at, s["rows"]
                    while left:
                        left -= audit[at] != "I"
                        at += 1
                    if s is own[-1]:
                        at = len(audit)
                    share = audit[begin:at]
                    rows.append((conv, s["chunk"], s["place"], share, seat, odd))
                    seat += len(share) - share.count("D")
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEADERS.split(", ")])

    return map_frames(reports.select("conv", "audit").join(lists, "conv"), run, HEADERS)


TURNS = "conv string, seat long, edit string, role string, text string"


def _edited(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The repaired turns: (conv, seat, edit, role, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, seat, odd = "", 0, 0, False
        for pdf in frames:
            out = []
            for conv, header, role, text, copies, share, begun, odd_ in zip(pdf["conv"], pdf["header"], pdf["role"], pdf["text"], pdf["copies"], pdf["audit"], pdf["seat"], pdf["odd"], strict=True):
                if header:
                    audit, at, seat, odd = share, 0, begun, odd_
                    continue
                for _ in range(copies):
                    while True:
                        edit = audit[at]
                        at += 1
                        if edit != "D":
                            own = ("user", "assistant")[(seat - odd) % 2]
                            out.append((conv, seat, edit, role if edit == "K" else own, "" if edit == "I" else text))
                            seat += 1
                        if edit != "I":
                            break
                if copies and not audit[at:].strip("I"):
                    for at in range(at, len(audit)):
                        out.append((conv, seat, "I", ("user", "assistant")[(seat - odd) % 2], ""))
                        seat += 1
                    at = len(audit)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TURNS.split(", ")])

    none = lambda kind: F.lit(None).cast(kind)
    told = headers.select("conv", "chunk", "place", F.lit(True).alias("header"), none("string").alias("role"), none("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit", "seat", "odd")
    held = rows.where("copies > 0").select("conv", chunk_of("place").alias("chunk"), "place", F.lit(False).alias("header"), "role", "text", "copies", none("string").alias("audit"), F.lit(0).cast("long").alias("seat"), F.lit(False).alias("odd"))
    # a segment's header comes before its rows
    both = told.unionByName(held).repartition("chunk").sortWithinPartitions("place", F.desc("header"))
    return map_frames(both.drop("chunk", "place"), run, TURNS)


def named(df: DataFrame) -> DataFrame:
    """``conv`` as the id it stands for."""
    return df.select(F.nullif("conv", F.lit(" ")).cast("long").alias("conv_id"), *[c for c in df.columns if c != "conv"])


def _repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = placed(turns)
    segments = _segments(_faults(rows))
    crowded = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    node = F.row_number().over(Window.partitionBy("conv").orderBy("chunk")) - 1
    several = segments.join(crowded, "conv", "left_semi")
    nodes = several.select("conv", "chunk").withColumn("node", node.cast("long"))
    tops = _reduced(cut(several.join(nodes, ["conv", "chunk"])))
    whole = segments.join(crowded, "conv", "left_anti").unionByName(tops.drop("node"))
    reports = cut(_reports(whole))
    return reports, cut(_edited(rows, _headers(reports, segments.select("conv", "chunk", "place", "rows"))))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation (conv_id, gaps, counts of faults, cost, audit), and
    the repaired turns (conv_id, seat, edit, role, text).

    turns: conv_id, turn, role, text, and where rows stand for several, their ``copies``;
    a conversation of which all rows stand for none has a report, too.
    """
    reports, repaired = _repaired(turns)
    return named(reports), named(repaired)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract, by a hash of the row's name."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256``, of the repaired ``role:text`` lines."""
    reports, repaired = _repaired(turns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, hashlib.sha256()
        frame = lambda rows: pd.DataFrame(rows, columns=["conv", "repaired_sha256"])
        for pdf in frames:
            out = []
            for conv, role, text in zip(pdf["conv"], pdf["role"], pdf["text"], strict=True):
                if conv != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield frame(out)
        if last is not None:
            yield frame([(last, state.hexdigest())])

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "seat").select("conv", "role", "text")
    hashed = map_frames(ordered, run, "conv string, repaired_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named(reports.join(hashed, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)))
