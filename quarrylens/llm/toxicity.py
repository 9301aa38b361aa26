"""Toxicity: a linear-chain CRF tags toxic spans, its marginals score the document.

Training looks only at labelled documents outside the held-out fold, at most
``SAMPLE_ROWS`` of each class.  Cues (words, their beginnings and endings) are weighed
by how much oftener a (distinct) word of a toxic than of a clean document shows them.  The labelled tokens
are words of toxic documents with a strong cue.  The sample has ``PARTS`` parts, and the
CRF sees a part's words only through the cues of the other parts: the strongest one's
strength and kind, the neighbours' strengths, the word's size and shape.  So it learns
what cues are worth on texts that they don't come from.  A document's score is a logistic function of the sum of its words' marginals, that sum a
word, and the largest, set to the labels' prior and fitted on marginals of the same kind.

Words without a cue beside or in them have one and the same emission, so the chain jumps
over any number of them by a power of one matrix: forward-backward runs over whole texts
and is exact, and only marginals of words near cues are summed.

Scale: scoring is one pass over whole texts without a shuffle; the sample and the model
are bounded by ``SAMPLE_ROWS``.

Edge cases: null and empty texts get the score of a document without evidence; with no
labelled rows that score is 0; repeated rows are scored alike; a null id is never held
out; null labels are left out, a document with both labels is a sample of each; a very
long text is a frame of its own; extra columns are ignored; labels, lang, source and
doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import crf
from quarrylens.llm.common import fold_column, map_frames

SAMPLE_ROWS = 2500
FOLDS, HELD_OUT = 4, 2
#: Parts of the training sample, each seen through the cues of the others.
PARTS = 5
THRESHOLD = 0.3
#: A cue is in this many toxic documents of a sample at least.
LEAST_DOCS = 3
#: Natural log of how much oftener words of toxic documents show a cue; the steps of its strength.
STRENGTHS = (0.7, 1.2, 1.7, 2.2, 2.8, 3.5)
#: Strength from which a word of a toxic document is labelled toxic.
LABEL_FROM = 1.2
#: Standard errors below its estimate at which a cue's strength is taken: 90 % on one side.
LOWER = 1.28
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7, 8), (4, 5)
MOST_WORDS = 300_000

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_toxic_words long, spans string"
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
N_STRENGTHS, N_SHAPES, N_KINDS, N_SIZES = len(STRENGTHS) + 1, 3, 3, 4
#: A word's code: the strongest cue's strength and kind, the word's size and shape; 0 for no cue.
N_CODES = N_STRENGTHS * N_KINDS * N_SIZES * N_SHAPES
N_FEATURES = 3 * N_STRENGTHS + N_STRENGTHS * N_KINDS + N_SIZES + N_SHAPES + 1


def cues(word: str) -> list[str]:
    """The word, its beginnings and endings; beginnings and endings of whole words only."""
    plain = EDGE.sub("", word.lower())
    if not plain:
        return []
    return [f"={plain}", *(f"^{plain[:n]}" for n in BEGINNINGS if len(plain) >= n), *(f"{plain[-n:]}$" for n in ENDINGS if len(plain) > n)]


def shape(word: str) -> int:
    return 2 if word.isupper() else 1 if word[:1].isupper() else 0


@dataclass
class Model:
    strength: dict[str, float] = field(default_factory=dict)
    chain: crf.Crf = field(default_factory=lambda: crf.Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2))))
    #: Weights of 1, log(1 + sum of marginals), that sum a hundred words, and the largest.
    top: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0, 0.0]))


class Reader:
    """Words to codes; bounded memory of words."""

    def __init__(self, strength: dict[str, float]):
        self.strength, self.known = strength, {}

    def code(self, word: str) -> int:
        found = [(self.strength[c], c) for c in cues(word) if c in self.strength]
        best, cue = max(found, default=(0.0, ""))
        step = int(np.searchsorted(STRENGTHS, best, side="right"))
        if not step:
            return 0
        kind = 0 if cue[0] == "=" else 1 if cue[0] == "^" else 2
        size = int(np.searchsorted((5, 8, 12), len(word)))
        return ((step * N_KINDS + kind) * N_SIZES + size) * N_SHAPES + shape(word)

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.code(w)
        return np.fromiter(map(known.__getitem__, words), np.int16, len(words))


def step_of(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.int64) // (N_KINDS * N_SIZES * N_SHAPES)


def chosen(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words that have a cue or stand beside one, and the words left out
    before each."""
    cue = np.r_[False, codes > 0, False]
    near = np.flatnonzero(cue[:-2] | cue[1:-1] | cue[2:])
    return near, np.diff(np.r_[-1, near]) - 1


def features(codes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Strength of a word, of the words before and after, and the word's kind of cue, size
    and shape; words without a cue have their strength, their neighbours' and a sign."""
    own = codes[near].astype(np.int64)
    step = step_of(np.r_[0, codes, 0])
    kind, size, form = own // (N_SIZES * N_SHAPES) % N_KINDS, own // N_SHAPES % N_SIZES, own % N_SHAPES
    base = 3 * N_STRENGTHS
    columns = [step[near + 1], N_STRENGTHS + step[near], 2 * N_STRENGTHS + step[near + 2], base + step[near + 1] * N_KINDS + kind, base + N_STRENGTHS * N_KINDS + size, N_FEATURES - 1 - N_SHAPES + form]
    out = np.stack(columns, axis=1)
    out[own == 0, 3], out[own == 0, 4:] = N_FEATURES - 1, -1
    return out


#: The features of a word without a cue in it or beside it.
REST = np.array([[0, N_STRENGTHS, 2 * N_STRENGTHS, N_FEATURES - 1, -1, -1]])


def tagged(reader: Reader, chain: crf.Crf, texts: list[str | None]) -> list[tuple[float, float, np.ndarray, int]]:
    """For each text: the sum of marginals, the largest, the toxic words' numbers, and the
    number of words."""
    out = [(0.0, 0.0, np.zeros(0, dtype=np.int64), 0) for _ in texts]
    rows, gaps, tails, owners, places = [], [], [], [], []
    for d, text in enumerate(texts):
        codes = reader.codes(text.split()) if text else np.zeros(0, dtype=np.int16)
        out[d] = (0.0, 0.0, out[d][2], len(codes))
        if codes.any():
            near, gap = chosen(codes)
            rows.append(features(codes, near))
            gaps.append(gap)
            tails.append(len(codes) - 1 - near)
            owners.append(d)
            places.append(near)
    if rows:
        lengths = [len(x) for x in places]
        rests = crf.Rests.of(chain.emissions(REST)[0], chain.trans)
        p = crf.marginals_between(chain.emissions(np.concatenate(rows)), np.concatenate(gaps), np.concatenate(tails), rests, crf.Lanes.of(np.array(lengths)))[:, 1]
        for d, near, own in zip(owners, places, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
            out[d] = (float(own.sum()), float(own.max()), near[own >= 0.5], out[d][3])
    return out


def evidence(sums: np.ndarray, tops: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sums)), np.log1p(sums), np.log1p(100 * sums / np.maximum(words, 20)), tops], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").where(fold_column("doc_id", FOLDS) != HELD_OUT).distinct()
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    return documents.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").where("text is not null").dropDuplicates(["toxic", "text"])


def _count_cues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words of documents that show each cue, and toxic documents, by part and
    class; "" counts all words."""
    counts: dict[tuple[int, int], Counter] = {(p, t): Counter() for p in range(PARTS) for t in (0, 1)}
    held: dict[int, Counter] = {p: Counter() for p in range(PARTS)}
    for pdf in frames:
        for part, toxic, text in zip(pdf["part"], pdf["toxic"], pdf["text"], strict=True):
            shown: Counter = Counter()
            for w in set(text.split()):  # a word that a document repeats is one sign
                shown.update({"", *cues(w)})
            counts[int(part), int(toxic)].update(shown)
            if toxic:
                held[int(part)].update(shown.keys())
    for (part, toxic), own in counts.items():
        yield pd.DataFrame({"cue": list(own), "part": part, "toxic": toxic, "n": list(own.values()), "docs": [held[part][c] if toxic else 0 for c in own]})


def _strengths(rows: list, without: int | None = None) -> dict[str, float]:
    """The cues' strengths by the counts of all parts but one: the lower end of what the
    log-odds may be, so that chance meetings in few documents make no cue."""
    used = [p for p in range(PARTS) if p != without]
    add = lambda r, name: sum(r[f"{name}{p}"] for p in used)
    total = next(((add(r, "n0_"), add(r, "n1_")) for r in rows if r.cue == ""), (0, 0))
    out = {}
    for r in rows:
        docs, toxic, clean = add(r, "docs_"), add(r, "n1_"), add(r, "n0_")
        if r.cue and docs >= LEAST_DOCS:
            odds = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 1.5) / (total[0] + 2))
            low = float(odds - LOWER * np.sqrt(1 / docs + 1 / (clean + 1.5)))
            if low >= STRENGTHS[0]:
                out[r.cue] = low
    return out


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Cues, chain and top weights from the bounded sample of labelled documents."""
    part = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(PARTS)).cast("int").alias("part")
    sample = _sample(documents, labels, sample_rows).select("toxic", part, "text")
    counted = map_frames(sample, _count_cues, "cue string, part int, toxic int, n long, docs long")
    of = lambda name, p, t: F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), F.col(name)).otherwise(0))
    columns = [*(of("n", p, t).alias(f"n{t}_{p}") for p in range(PARTS) for t in (0, 1)), *(of("docs", p, 1).alias(f"docs_{p}") for p in range(PARTS))]
    whole_of = lambda name: sum((F.col(f"{name}{p}") for p in range(PARTS)), F.lit(0))
    by_cue = counted.groupBy("cue").agg(*columns)
    rows = by_cue.where((F.col("cue") == "") | (whole_of("docs_") >= LEAST_DOCS) & (whole_of("n1_") > whole_of("n0_") / 50)).collect()
    whole = next((r for r in rows if r.cue == ""), None)
    if whole is None or not sum(whole[f"n1_{p}"] for p in range(PARTS)):
        return Model()
    strength, others = _strengths(rows), [_strengths(rows, p) for p in range(PARTS)]
    strong = int(np.searchsorted(STRENGTHS, LABEL_FROM, side="right"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, readers = Reader(strength), [Reader(x) for x in others]
        for pdf in frames:
            out = []
            for p, toxic, text in zip(pdf["part"], pdf["toxic"], pdf["text"], strict=True):
                words = text.split()
                seen, own = readers[p].codes(words), every.codes(words)
                near, gap = chosen(np.where(seen > 0, seen, own))
                truth = (step_of(own)[near] >= strong) & (toxic == 1)
                out.append((int(toxic), features(seen, near).astype(np.int16).tobytes(), gap.astype(np.int32).tobytes(), truth.astype(np.int8).tobytes(), len(words)))
            yield pd.DataFrame(out, columns=["toxic", "tokens", "gaps", "truth", "words"])

    docs = map_frames(sample, run, "toxic int, tokens binary, gaps binary, truth binary, words int").orderBy("tokens", "toxic", "words").collect()
    tokens = [np.frombuffer(r.tokens, dtype=np.int16).reshape(-1, 6).astype(np.int64) for r in docs]
    gaps = [np.frombuffer(r.gaps, dtype=np.int32).astype(np.int64) for r in docs]
    truth = [np.frombuffer(r.truth, dtype=np.int8).astype(np.int64) for r in docs]
    # a stretch of words ends where more than two are left out; one of them begins the next
    parts = [_stretches(*x) for x in zip(tokens, gaps, truth, strict=True) if len(x[0])]
    if not parts:
        return Model()
    chain = crf.fit(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]), N_FEATURES)
    lengths = np.array([len(t) for t in tokens])
    toxic = np.array([r.toxic for r in docs])
    tails = np.concatenate([r.words - 1 - np.cumsum(g + 1) + 1 for r, g in zip(docs, gaps, strict=True)])
    p = crf.marginals_between(chain.emissions(np.concatenate(tokens)), np.concatenate(gaps), tails, crf.Rests.of(chain.emissions(REST)[0], chain.trans), crf.Lanes.of(lengths))[:, 1]
    owner = np.repeat(np.arange(len(docs)), lengths)
    tops = np.zeros(len(docs))
    np.maximum.at(tops, owner, p)
    x = evidence(np.bincount(owner, p, len(docs)), tops, np.array([r.words for r in docs]))
    prior = labels.where("toxic in (0, 1)").where(fold_column("doc_id", FOLDS) != HELD_OUT).agg(F.avg("toxic")).first()[0]
    return Model(strength, chain, _top_weights(x, toxic, prior))


def _stretches(tokens: np.ndarray, gaps: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and lengths of a document's stretches for training: up to two words
    without cues are put in before each chosen word, as many as were left out there."""
    rest = np.minimum(gaps, 2)
    size = rest + 1
    ends = np.cumsum(size)
    out = np.repeat(REST, ends[-1], axis=0)
    label = np.zeros(ends[-1], dtype=np.int64)
    out[ends - 1], label[ends - 1] = tokens, truth
    first = np.flatnonzero((gaps > 2) | (np.arange(len(gaps)) == 0))
    starts = (ends - size)[first]
    return out, label, np.diff(np.r_[starts, ends[-1]])


def _top_weights(x: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression by Newton's steps, halved until they help; each class is weighed
    by its prior, and all weights but the first are held small in units of their columns."""
    share = toxic.mean()
    weight = np.where(toxic == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    unit = np.r_[1.0, np.maximum(x[:, 1:].std(0), 1e-6)]
    z = x / unit
    ridge = np.r_[1e-6, np.full(x.shape[1] - 1, 0.1)]

    def loss(w: np.ndarray) -> float:
        m = np.where(toxic == 1, z @ w, -(z @ w))
        return float((weight * np.logaddexp(0, -m)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(z @ w)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (toxic - p)) - ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return w / unit


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row of score, verdict and toxic spans (code points) for each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.strength)
        for pdf in frames:
            found = tagged(reader, model.chain, list(pdf["text"]))
            scores = logistic(evidence(*(np.array([x[k] for x in found]) for k in (0, 1, 3))) @ model.top)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": scores, "predicted": (scores >= threshold).astype(np.int32),
                "n_toxic_words": [len(x[2]) for x in found], "spans": [spans(text, x[2]) for text, x in zip(pdf["text"], found, strict=True)],
            })

    held_out = F.coalesce(fold_column("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return map_frames(documents.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text"), run, SCHEMA)


def spans(text: str | None, words: np.ndarray) -> str:
    """start:end of runs of neighbouring words, comma-joined."""
    if not len(words):
        return ""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    runs = np.split(words, np.flatnonzero(np.diff(words) > 1) + 1)
    return ",".join(f"{places[r[0]][0]}:{places[r[-1]][1]}" for r in runs)
