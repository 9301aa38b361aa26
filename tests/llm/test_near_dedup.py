import random
import re

import numpy as np
import pytest

from quarrylens.llm import near_dedup
from quarrylens.llm.components import components


def brute_force(rows, width):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if whole and 100 * common >= 80 * whole and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def rows():
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randint(0, 500)}" for _ in range(n)]
    out = [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "two words"), (1005, "\x1c x"), (1006, "a b c a b c a b c")]
    passage = text(60)
    for g in range(12):
        base = text(rng.randint(20, 200))
        for k in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(k // 2):
                own[rng.randrange(len(own))] = "edit"
            if g % 4 == 0:
                own += passage
            out.append((g * 20 + k, " ".join(own).upper() if k % 3 == 0 else "\t".join(own)))
    base = text(90)
    for k in range(40):  # siblings around the threshold
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 5)}"
        out.append((400 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_classes_equal_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 6 if width == 4 else 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    own = rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in own], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(df, width).collect()}
    assert got == brute_force(own, width)
    kept = near_dedup.dedupe(df, width)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {label for _, label in got.values()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_dedup.classes(df).collect())
    assert got == [(-1, None, False), (0, 0, True), (1, 0, False), (1, 0, False)]
    assert sorted(str(r.doc_id) for r in near_dedup.dedupe(df).collect()) == ["0", "None"]
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_circulant_signature_by_its_definition():
    c = near_dedup.Circulant(bands=4, rows=3)
    second = np.random.default_rng(near_dedup.SEED).permutation(near_dedup.SLOTS)
    shingles = np.unique(np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64))
    slots = (near_dedup.mixed(shingles) % near_dedup.SLOTS).astype(int)
    expected = [min(second[(s + k) % near_dedup.SLOTS] for s in slots) for k in range(12)]
    assert c.signature(shingles).tolist() == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 12)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(13)) and all(got[k] == 100 for k in range(100, 140)) and all(got[k] == 200 for k in (200, 201, 202))


def test_texts_over_one_template_are_never_compared(spark, monkeypatch):
    """A family of one long template and own rests: many share buckets, none is linked."""
    template = [f"t{k}" for k in range(45)]
    docs = [(k, " ".join(template + [f"o{k}x{j}" for j in range(15)])) for k in range(1500)]
    docs += [(5000 + k, " ".join(template + [f"near{j}" for j in range(15)] + [f"e{k}"])) for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    met = []
    linkable = near_dedup._linkable
    monkeypatch.setattr(near_dedup, "_linkable", lambda *given: met.append(linkable(*given)) or met[-1])
    got = {r.doc_id: r.component_id for r in near_dedup.classes(df, 4).collect()}
    assert got == {k: 5000 if k >= 5000 else k for k, _ in docs}
    assert met and met[0].count() <= 3


def test_chains_in_crowded_buckets_are_found(spark, monkeypatch):
    """Links that only the last step finds, with every bucket taken for a crowded one."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(32)
    docs = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(60)]
        for k in range(14):
            docs.append((len(docs), " ".join(words)))
            words[rng.randrange(60)] = f"g{g}n{k}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    assert got == brute_force(docs, 4)
