"""The likeliest duplicates of issues by their whole similarity, with no link lost.

A pair's score adds what its titles (Jaccard above 0.5), summaries (above 0.4), severity,
paths and labels have in common.  The asked issues meet all others in blocks
(``operators.asked``), as sets of 64-bit hashes: like titles and summaries meet on their
rarest words, all other pairs on their profiles (severity, paths and labels), so only pairs
that may be among the first of an asked issue are scored.  A task gives the first few of
each asked issue, so no pair is shuffled but these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.arrays import jaccard
from quarrylens.operators.asked import HITS, Best, Inverted, Prefixes, Sets, Words, cuts, hashes, meet, spread, stored

#: From where similar parts count and how much, and from where a pair does.
TITLE, SUMMARY, LEAST = (0.5, 0.35), (0.4, 0.25), 0.3
SEVERITY, PATHS, LABELS = 0.1, 0.2, 0.1
MOST, EXACT = 10, 0.95
#: Pairs of profiles that are compared in one go, at most.
PROFILES = 2_000_000
#: Bytes of issues that are cut into words in one go, at most but for a single issue.
TEXT = 40_000_000
#: Parts that a group's first rows are taken of before they meet.
SALT = 16


def words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")))


def match(title: Column, summary: Column, severity: Column, paths: Column, labels: Column, fingerprint: Column) -> Column:
    """(similarity, match_type, shared_fields) of a pair from its parts' Jaccard
    similarities and whether severities and fingerprints are the same."""
    part = lambda on, value: F.when(on, value).otherwise(0.0)
    on = {"title": title > TITLE[0], "summary": summary > SUMMARY[0], "severity": severity, "evidence_paths": paths > 0, "labels": labels > 0}
    score = part(on["title"], title * TITLE[1]) + part(on["summary"], summary * SUMMARY[1]) + part(severity, F.lit(SEVERITY)) + part(on["evidence_paths"], paths * PATHS) + part(on["labels"], labels * LABELS)
    rounded = F.floor(F.least(score, F.lit(1.0)) * 1000 + 0.5) / 1000
    shared = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in on.items())))
    fuzzy = F.struct(rounded.alias("similarity"), F.when(score >= EXACT, "exact").otherwise("fuzzy").alias("match_type"), shared.alias("shared_fields"))
    return F.when(fingerprint, F.struct(F.lit(1.0).alias("similarity"), F.lit("fingerprint").alias("match_type"), F.array(F.lit("fingerprint")).alias("shared_fields"))).otherwise(fuzzy)


def first_of(df: DataFrame, keys: list[str], order: list[Column], most: int, salt: str) -> DataFrame:
    """The first ``most`` rows of each group: of each part of it, then of those."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(SALT)))
    for by in ([*keys, "_part"], keys):
        df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= most)
    return df.drop("_part", "_place")


def profiled(issues: DataFrame) -> DataFrame:
    """Issues with their word sets."""
    return issues.select(
        "bug_id", F.coalesce("severity", F.lit("")).alias("severity"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), words(F.col("title")).alias("t"), words(F.col("summary")).alias("s"),
        *(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(c) for c in ("paths", "labels")),
    )


PROFILE = ["severity", "paths", "labels"]


def _same(column: str) -> Column:
    return (F.col(f"a_{column}") == F.col(f"b_{column}")) & (F.col(f"a_{column}") != "")


def scored_pairs(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity, match_type, shared_fields) of given pairs."""
    own = profiled(issues)
    side = lambda name: own.select(F.col("bug_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("t", "s", *PROFILE, "fingerprint")))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    like = lambda c: jaccard(F.col(f"a_{c}"), F.col(f"b_{c}"))
    found = match(like("t"), like("s"), _same("severity"), like("paths"), like("labels"), _same("fingerprint"))
    return both.select("a", "b", found.alias("m")).select("a", "b", "m.*")


SETS = ("t", "s", "paths", "labels")
HASHED = "bug_id long, severity long, fingerprint long, " + ", ".join(f"{c} array<long>" for c in SETS)
SHARED = ("title", "summary", "severity", "evidence_paths", "labels", "fingerprint")


def hashed(issues: DataFrame) -> DataFrame:
    """Issues with hashes for their profiles and texts in lower case as ``t`` and ``s``; 0
    stands for no severity and no fingerprint."""
    key = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.xxhash64(c)).alias(c)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    sets = (hashes(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))).alias(c) for c in ("paths", "labels"))
    return issues.where("bug_id is not null").select(F.col("bug_id").cast("long"), key("severity"), key("fingerprint"), low("title").alias("t"), low("summary").alias("s"), *sets)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``hashed`` with sets of hashed words for their texts."""
    for batch in (part for batch in batches for part in light(batch)):
        yield pa.RecordBatch.from_arrays([Words(batch[c]).lists() if c in "ts" else batch[c] for c in batch.schema.names], names=batch.schema.names)


def light(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``TEXT`` bytes, or of one row."""
    if batch.nbytes <= TEXT or batch.num_rows <= 1:
        yield batch
    else:
        middle = batch.num_rows // 2
        yield from light(batch.slice(0, middle))
        yield from light(batch.slice(middle))


def share(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of sets of ``a`` and ``b`` values, ``both`` of them shared; 0 if both are empty."""
    whole = a + b - both
    return np.where(whole == 0, 0.0, both / np.where(whole == 0, 1, whole))


def distinct(*columns: np.ndarray | Sets) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each kind of rows, which have the same values or sets, and the
    kind of each row."""
    kind = np.zeros(1, dtype=np.int64)
    for column in (x for c in columns for x in ((c.sums(), c.sizes) if isinstance(c, Sets) else (c,))):
        own, number = np.unique(column, return_inverse=True)
        first, kind = np.unique(kind * len(own) + number, return_index=True, return_inverse=True)[1:]
    return first, kind


class Runs:
    """Rows in runs, one for each of ``n`` kinds: where they open and how many they are."""

    def __init__(self, kinds: np.ndarray, n: int):
        self.counts = np.bincount(kinds, minlength=n)
        self.opens = np.cumsum(self.counts) - self.counts


class Asked:
    """A part of the asked issues: their words, and those of one profile together."""

    def __init__(self, table: pa.Table):
        self.ids, self.severity, self.mark = (table[c].to_numpy() for c in ("bug_id", "severity", "fingerprint"))
        sets = {c: Sets(table[c]) for c in SETS}
        self.words = {"t": Prefixes(sets["t"], TITLE[0]), "s": Prefixes(sets["s"], SUMMARY[0])}
        self.sizes = {c: sets[c].sizes for c in "ts"}
        first, self.profile = distinct(self.severity, sets["paths"], sets["labels"])
        few = table.take(pa.array(first))
        self.few, self.few_severity = {c: Inverted(Sets(few[c])) for c in ("paths", "labels")}, self.severity[first]
        self.runs, self.by_profile = Runs(self.profile, len(first)), np.argsort(self.profile, kind="stable")
        self.by_mark = np.argsort(self.mark, kind="stable")

    def marked(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``by_mark`` the issues of these fingerprints begin, and how many they are."""
        own = self.mark[self.by_mark]
        begins = np.searchsorted(own, marks)
        return begins, np.where(marks == 0, 0, np.searchsorted(own, marks, "right") - begins)


class Profiles:
    """How like the profiles of some issues and of asked ones are."""

    def __init__(self, asked: Asked, few: pa.RecordBatch):
        self.like = {c: share(asked.few[c].shared(x := Sets(few[c])).astype(np.float64), asked.few[c].sizes[None], x.sizes[:, None]) for c in ("paths", "labels")}
        self.same = (few["severity"].to_numpy()[:, None] == asked.few_severity[None]) & (asked.few_severity[None] != 0)


def scored(t: np.ndarray, s: np.ndarray, same: np.ndarray, p: np.ndarray, x: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and bits of ``SHARED`` and of being exact, in the order of the sum."""
    on = [t > TITLE[0], s > SUMMARY[0], same, p > 0, x > 0, marked]
    part = lambda on, value: np.where(on, value, 0.0)
    exact = part(on[0], t * TITLE[1]) + part(on[1], s * SUMMARY[1]) + part(on[2], SEVERITY) + part(on[3], p * PATHS) + part(on[4], x * LABELS)
    rounded = np.where(on[5], 1.0, np.floor(np.minimum(exact, 1.0) * 1000 + 0.5) / 1000)
    return rounded, sum(c.astype(np.int32) << k for k, c in enumerate([*on, exact >= EXACT]))


def halves(asked: Asked, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch, with few profiles each, and their ``distinct`` profiles."""
    first, profile = distinct(batch["severity"].to_numpy(), Sets(batch["paths"]), Sets(batch["labels"]))
    if len(first) * len(asked.runs.counts) <= PROFILES or batch.num_rows == 1:
        yield batch, first, profile
    else:
        middle = batch.num_rows // 2
        yield from halves(asked, batch.slice(0, middle))
        yield from halves(asked, batch.slice(middle))


def by_profile(asked: Asked, best: Best, base: np.ndarray, profile: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, asked) of pairs that may be among the first by their profiles alone: of each
    profile the rows of the first ids, one more than are wanted, as one may be the asked."""
    order, own = np.lexsort((ids, profile)), Runs(profile, len(base))
    least, last = (f.reduceat(x[asked.by_profile], asked.runs.opens) for f, x in ((np.minimum, best.least), (np.maximum, best.last)))
    f, g = np.nonzero((base > least[None]) | ((base == least[None]) & (ids[order[own.opens]][:, None] <= last[None])))
    rows, found = np.minimum(own.counts, best.most + 1), []
    for start, stop in cuts(asked.runs.counts[g], HITS):
        held = asked.runs.counts[g[start:stop]]
        a = asked.by_profile[spread(asked.runs.opens[g[start:stop]], held)]
        of, score = np.repeat(f[start:stop], held), np.repeat(base[f[start:stop], g[start:stop]], held)
        may = best.may(a, score, ids[order[own.opens[of]]])
        a, of, score = a[may], of[may], score[may]
        row = order[spread(own.opens[of], rows[of])]
        a, score = np.repeat(a, rows[of]), np.repeat(score, rows[of])
        may = best.may(a, score, ids[row])
        found.append((row[may], a[may]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2


def add(asked: Asked, best: Best, batch: pa.RecordBatch, first: np.ndarray, profile: np.ndarray) -> None:
    """Scores issues with all asked ones that they may be among the first duplicates of.

    Issues that are the same but for their id are scored once, and the first of them count.
    Pairs meet on like words of titles or summaries, on fingerprints or, as all other pairs
    of two profiles have the same score, on the first ids of each profile.
    """
    ids, mark = (batch[c].to_numpy() for c in ("bug_id", "fingerprint"))
    own = {c: Words(batch[c]) for c in "ts"}
    kinds = {c: distinct(own[c]) for c in "ts"}
    whole, kind = distinct(profile, mark, *(k[1] for k in kinds.values()))
    n, order, same = len(whole), np.lexsort((ids, kind)), Runs(kind, len(whole))
    firsts, lowest = np.minimum(same.counts, best.most + 1), ids[order[same.opens]]
    like = Profiles(asked, batch.take(pa.array(first)))
    zero = np.zeros_like(like.like["paths"])
    base = scored(zero, zero, like.same, like.like["paths"], like.like["labels"], zero > 0)[0]
    # where each kind finds asked issues: (first place, how many, asked issues, shared words)
    ways = []
    for c in "ts":
        row, a, both = asked.words[c].alike(own[c].take(kinds[c][0]))
        by, runs, of = np.argsort(row, kind="stable"), Runs(row, len(kinds[c][0])), kinds[c][1][whole]
        ways.append((runs.opens[of], runs.counts[of], a[by], both[by]))
    ways.append((*asked.marked(mark[whole]), asked.by_mark, None))
    row, a = by_profile(asked, best, base, profile, ids)
    by, runs = np.argsort(kind[row], kind="stable"), Runs(kind[row], n)
    ways.append((runs.opens, runs.counts, a[by], None))
    for start, stop in cuts(sum(w[1] for w in ways), HITS):
        found = []
        for opens, counts, a, both in ways:
            at = spread(opens[start:stop], counts[start:stop])
            found.append((np.repeat(np.arange(start, stop), counts[start:stop]) * len(asked.ids) + a[at], None if both is None else both[at]))
        pairs = np.sort(np.concatenate([x[0] for x in found]))
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        k, a = np.divmod(pairs, len(asked.ids))
        likes = []
        for c, (where, both) in zip("ts", found, strict=False):
            shared = np.zeros(len(pairs))
            shared[np.searchsorted(pairs, where)] = both
            likes.append(share(shared, asked.sizes[c][a], own[c].sizes[whole[k]]))
        f, g = profile[whole[k]], asked.profile[a]
        marked = (mark[whole[k]] == asked.mark[a]) & (asked.mark[a] != 0)
        score, bits = scored(*likes, like.same[f, g], like.like["paths"][f, g], like.like["labels"][f, g], marked)
        may = best.may(a, score, lowest[k])
        k, a, score, bits = k[may], a[may], score[may], bits[may]
        id_ = ids[order[spread(same.opens[k], firsts[k])]]
        a, score, bits = (np.repeat(x, firsts[k]) for x in (a, score, bits))
        may = best.may(a, score, id_) & (id_ != asked.ids[a])
        best.add(a[may], score[may], id_[may], bits[may])


def _firsts(most: int):
    def run(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        best = Best(len(asked.ids), most, LEAST)
        for batch in batches:
            for part in (x for own in light(batch) for x in halves(asked, own)):
                add(asked, best, *part)
        if (found := best.chosen()) is not None:
            yield {"a": asked.ids[found[0]], "b": found[2], "similarity": found[1], "bits": found[3]}

    return run


def find(issues: DataFrame, asked: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, similarity, match_type, shared_fields, place): the first ``most`` duplicates
    of each asked issue among all, best first, ties by id.

    issues: (bug_id, title, summary, severity, paths, labels, fingerprint); asked: bug_id.
    """
    own = hashed(issues)
    queries = hashed(issues.join(asked.select("bug_id").distinct(), "bug_id", "left_semi")).mapInArrow(cut, HASHED)
    found = meet(own, stored(queries, "bug_id", list(SETS)), _firsts(most), "a long, b long, similarity double, bits int", Asked)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))  # ``most`` rows of each task
    best = found.withColumn("place", place).where(F.col("place") <= most)
    has = lambda k: F.col("bits").bitwiseAND(1 << k) != 0
    kind = F.when(has(5), "fingerprint").when(has(6), "exact").otherwise("fuzzy")
    shared = F.when(has(5), F.array(F.lit("fingerprint"))).otherwise(F.array_compact(F.array(*(F.when(has(k), F.lit(name)) for k, name in enumerate(SHARED[:5])))))
    kinds = {f.name: f.dataType for f in issues.schema if f.name == "bug_id"}
    return best.select(*(F.col(c).cast(kinds["bug_id"]).alias(c) for c in ("a", "b")), "similarity", kind.alias("match_type"), shared.alias("shared_fields"), "place")


def alike(issues: DataFrame, asked: DataFrame, least: float, more: bool = False) -> DataFrame:
    """(a, b, common, score) of all pairs of an asked issue and another whose titles' words
    ``t`` have a Jaccard of ``least`` or more; ``more`` adds (s, labels), those of the other
    sets, and (severity, path), whether these are the same (null if either is null).

    Both: (bug_id, t) and for ``more`` (s, labels, severity, path); sets without doubles.
    """
    names = ("t", "s", "labels") if more else ("t",)

    def run(table: pa.Table, pages: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = {c: Inverted(Sets(table[c])) for c in names}
        ids = table["bug_id"].to_numpy()
        for page in pages:
            own, own_ids = {c: Sets(page[c]) for c in names}, page["bug_id"].to_numpy()
            both = held["t"].shared(own["t"])
            sizes = (held["t"].sizes[None] + own["t"].sizes[:, None]).astype(np.float32)
            row, at = np.nonzero((both > 0) & (both * np.float32(1 + least) >= sizes * np.float32(least * 0.9999)) & (own_ids[:, None] != ids[None]))
            like = share(both[row, at].astype(np.float64), held["t"].sizes[at], own["t"].sizes[row])
            row, at, like = (x[like >= least] for x in (row, at, like))
            if not len(row):
                continue
            out = {"a": ids[at], "b": own_ids[row], "common": both[row, at].astype(np.int64), "score": like}
            if more:
                for c in ("s", "labels"):
                    out[c] = share(held[c].shared(own[c])[row, at].astype(np.float64), held[c].sizes[at], own[c].sizes[row])
                for c in ("severity", "path"):
                    out[c] = pa.compute.equal(table[c].combine_chunks().take(pa.array(at)), page[c].take(pa.array(row)))
            yield out

    columns = lambda df: df.where("bug_id is not null").select(F.col("bug_id").cast("long"), *(hashes(F.col(c)).alias(c) for c in names), *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in ("severity", "path") if more))
    schema = "a long, b long, common long, score double" + (", s double, labels double, severity boolean, path boolean" if more else "")
    return meet(columns(issues), stored(columns(asked), "bug_id", list(names)), run, schema)
