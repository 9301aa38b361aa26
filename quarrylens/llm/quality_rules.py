r"""Quality rules with line labelling.

Every document gets fixed base counts; a linear-chain CRF then labels its lines as
content or boilerplate by Viterbi decoding, and the share of words on content lines
decides whether a document that passed the base rules is kept.

Labels are known of documents only, so the lines of the sample get weak labels of their
own: a line is boilerplate if it repeats an earlier one, if it stands in several sampled
documents, or if it looks like the lines of bad documents rather than good ones, by a
logistic classifier that was fitted on the other half of the sample.  So good documents
have boilerplate lines and bad ones content, and the chain learns where labels change.

Scale: one pass over the documents without a shuffle.  The CRF is fitted on at most
``SAMPLE_ROWS`` labelled documents of each class (only their line features and hashes
reach the driver).

Edge cases: a null or empty text has no words, fails the base rules and is not kept;
a null ``doc_id`` stays null; repeated rows are judged one by one, alike; rows of
``labels`` with nulls are left out, and a document with both labels is a sample of
each; an empty ``labels`` table leaves a CRF of zero weights, which labels every line
content; a very long text is a frame of its own; extra columns are ignored by ``judge``
and passed through by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import crf
from quarrylens.llm.common import filter_texts, map_frames, words_of

#: Labelled documents of each class that the CRF is fitted on.
SAMPLE_ROWS = 1500
#: Words on content lines, of all words, that a kept document has at least.
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1
#: Sampled documents from which a line counts as shared.
SHARED_LINES = 4

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long"
)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Steps of each measured line property; a feature is a property and the step it falls in.
EDGES = {
    "words": (1, 3, 6, 12, 30),
    "symbols": (0.005, 0.05, 0.2, 0.5),
    "upper": (0.02, 0.1, 0.3, 0.6, 0.9),
    "digits": (0.02, 0.1, 0.3),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "word_length": (2.5, 4, 6, 9, 14),
    "repeat": (0.05, 0.2, 0.5),
    "shouting": (0.005, 0.02, 0.1),
    "ended": (0.5,),
    "seen_before": (0.5,),
}
WIDTH = max(map(len, EDGES.values())) + 1


def repeated_positions(words: list[bytes]) -> np.ndarray:
    """True at each word inside a 3-word window that occurs twice or more."""
    n = len(words)
    covered = np.zeros(n, dtype=bool)
    if n < 4:
        return covered
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    seq = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1].astype(np.int64) if len(ids) > 2_000_000 else seq[:-1] * len(ids) + seq[1:]
    triple = pair[:-1] * len(ids) + seq[2:]
    _, where, count = np.unique(triple, return_inverse=True, return_counts=True)
    again = count[where] > 1
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return covered


def line_properties(line: str, words: list[bytes], repeated: int, seen: bool) -> tuple[float, ...]:
    """The measured properties of a line, in the order of ``EDGES``."""
    chars, n = max(len(line), 1), len(words)
    upper = sum(map(str.isupper, line)) if not line.islower() else 0
    digits = 0 if line.isalpha() else sum(map(line.count, "0123456789"))
    return (
        n,
        sum(map(line.count, SYMBOLS)) / chars,
        upper / chars,
        digits / chars,
        len(set(words)) / max(n, 1),
        sum(map(len, words)) / max(n, 1),
        repeated / max(n, 1),
        line.count("!") / chars,
        float(line.rstrip().endswith((".", "?", "!", ":", ";"))),
        float(seen),
    )


def lines_of(text: str | None) -> list[str]:
    """The lines with a word."""
    return [line for line in (text or "").split("\n") if words_of(line)]


def measured(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """The base counts, and the properties and word counts of the lines with words."""
    if not text:
        return (0, 0, 0, 0, 0), np.zeros((0, len(EDGES))), np.zeros(0, dtype=np.int64)
    words = words_of(text)
    covered = repeated_positions(words)
    seen: set[str] = set()
    rows, sizes, at, dup = [], [], 0, 0
    for line in text.split("\n"):
        own = words_of(line)
        if own:
            again = line in seen
            dup += again
            seen.add(line)
            rows.append(line_properties(line, own, int(covered[at : at + len(own)].sum()), again))
            sizes.append(len(own))
            at += len(own)
    counts = (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, int(covered.sum()))
    return counts, np.array(rows).reshape(-1, len(EDGES)), np.array(sizes, dtype=np.int64)


def feature_numbers(properties: np.ndarray) -> np.ndarray:
    """One feature number for each property of each line."""
    columns = [np.searchsorted(edges, properties[:, i], side="right") + i * WIDTH for i, edges in enumerate(EDGES.values())]
    return np.stack(columns, axis=1) if len(properties) else np.zeros((0, len(EDGES)), dtype=np.int64)


def _line_features(frames):
    for pdf in frames:
        out = []
        for quality, text in zip(pdf["quality"], pdf["text"], strict=True):
            _, properties, _ = measured(text)
            hashes = np.array([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines_of(text)], dtype=np.uint64)
            out.append((int(quality), feature_numbers(properties).astype(np.int16).tobytes(), hashes.tobytes()))
        yield pd.DataFrame(out, columns=["quality", "lines", "hashes"])


def looks(features: np.ndarray, bad: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic classifier that tells lines of bad documents from good ones."""
    w = np.zeros(len(EDGES) * WIDTH)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[features].sum(1), -30, 30)))
        miss = weight * (bad - p)
        up = sum(np.bincount(column, miss, len(w)) for column in features.T) - 1e-4 * w
        w += 2.0 * up
    return w


def line_labels(features: np.ndarray, hashes: np.ndarray, doc: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Weak labels of the sample's lines; ``doc`` numbers the documents that hold them."""
    bad = quality[doc] == 0
    size = np.bincount(doc, minlength=len(quality))
    per_class = np.bincount(quality, minlength=2)
    weight = 1.0 / size[doc] / np.maximum(per_class[quality[doc]], 1)  # each class and each document alike
    label = np.zeros(len(features), dtype=bool)
    for half in (0, 1):
        own = doc % 2 == half
        if own.any() and (~own).any():
            label[own] = looks(features[~own], bad[~own], weight[~own])[features[own]].sum(1) > 0
    _, where = np.unique(hashes, return_inverse=True)
    held = np.bincount(np.unique(where.astype(np.int64) * len(quality) + doc) // len(quality), minlength=where.max() + 1)
    seen = features[:, list(EDGES).index("seen_before")] % WIDTH == 1
    return np.where(label | seen | (held[where] >= SHARED_LINES), BOILERPLATE, CONTENT)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> crf.Crf:
    """A CRF from at most ``sample_rows`` labelled documents of each class."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for q in (0, 1)]
    sample = documents.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").where("text is not null").dropDuplicates(["quality", "text"])
    rows = map_frames(sample.select("quality", "text"), _line_features, "quality int, lines binary, hashes binary").orderBy("hashes", "quality").collect()
    blocks = [np.frombuffer(r.lines, dtype=np.int16).reshape(-1, len(EDGES)).astype(np.int64) for r in rows]
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    if not lengths.sum():
        return crf.fit(np.zeros((0, len(EDGES)), dtype=np.int64), lengths[:0], lengths[:0], len(EDGES) * WIDTH)
    features = np.concatenate(blocks)
    hashes = np.frombuffer(b"".join(r.hashes for r in rows), dtype=np.uint64)
    truth = line_labels(features, hashes, np.repeat(np.arange(len(rows)), lengths), np.array([r.quality for r in rows]))
    return crf.fit(features, truth, lengths, len(EDGES) * WIDTH)


def judged_batch(pdf: pd.DataFrame, model: crf.Crf, share: float) -> pd.DataFrame:
    """The verdicts on a batch of documents, in its order."""
    counts, properties, sizes = zip(*map(measured, pdf["text"]), strict=True)
    lengths = np.array([len(x) for x in sizes])
    emit = model.emissions(feature_numbers(np.concatenate(properties)))
    label = crf.viterbi(emit, model.trans, crf.Lanes.of(lengths))
    doc = np.repeat(np.arange(len(pdf)), lengths)
    size = np.concatenate(sizes)
    content = np.bincount(doc, size * (label == CONTENT), len(pdf))
    bad_lines = np.bincount(doc, label == BOILERPLATE, len(pdf)).astype(np.int64)
    out = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    out.insert(0, "doc_id", pdf["doc_id"].array)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["content_share"] = content / np.maximum(out["n_words"], 1)
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= share)
    out["n_lines"], out["n_boilerplate_lines"] = lengths, bad_lines
    return out


def judge(documents: DataFrame, model: crf.Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """One row of counts and verdict for each document."""

    def run(frames):
        for pdf in frames:
            yield judged_batch(pdf, model, share)

    return map_frames(documents.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def keep(documents: DataFrame, model: crf.Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return filter_texts(documents, lambda texts: judged_batch(pd.DataFrame({"doc_id": None, "text": texts}), model, share)["kept"].tolist())
