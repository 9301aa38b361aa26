import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import repeated_spans
from quarrylens.llm.anchors import Anchors


def brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(80) for _ in range(6)]
    out = [None, "", "short", "ab" * 400, "x" * 500, "x" * 199, "x" * 200]
    for k in range(60):
        own = text(rng.randint(10, 120))
        if k % 3 == 0:
            own += rng.choice(shared) + text(20)
        if k % 4 == 0:
            s = rng.choice(shared)
            own = s[rng.randint(0, 100) :] + own
        if k % 10 == 0:
            own += own[5:300]
        out.append(own)
    base = text(300)
    for _ in range(15):
        at = rng.randrange(len(base))
        out.append(base[:at] + word() + base[at + 3 :])
    return out + [base, base]


@pytest.mark.parametrize("batches", [4, 1, 7])
def test_equals_brute_force(spark, batches):
    own = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(own)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans.remove(df, block_bytes=4000, batches=batches).collect()}
    for i, expected in enumerate(brute_force(own, 200)):
        assert got[i] == expected, (i, own[i] and own[i][:80])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    again = np.concatenate([rng.integers(97, 100, 333).astype(np.uint8), data[1000:3000], rng.integers(97, 100, 50).astype(np.uint8)])
    a, b = Anchors.of(data, 200, 40), Anchors.of(again, 200, 40)
    place = lambda x: {int(s): int(p) for p, f, t in zip(x.place, x.first, x.last, strict=True) for s in range(f, t + 1)}
    pa, pb = place(a), place(b)
    assert len(pa) == 4801
    assert all(pa[s] - 1000 == pb[s - 667] - 333 for s in range(1000, 2801))
    small = Anchors.of(data, 200, 40, segment=700)
    assert place(small) == pa


def test_rows_that_repeat(spark):
    long = "abc def " * 60
    df = spark.createDataFrame([(1, long), (1, long), (None, "z" * 10)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeated_spans.remove(df).collect()) == [(0, 10, 0), (1, 480, 480), (1, 480, 480)]
    assert repeated_spans.remove(df.limit(0)).count() == 0


def test_levels_are_suffix_arrays_that_merge_geometrically(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, 3000).astype(np.uint8)
    batches = [np.concatenate([rng.integers(97, 101, 400).astype(np.uint8), base[200 * k : 200 * k + 900]]) for k in range(7)]
    family, total = repeated_spans.Family(spark, 2), 0
    for k, data in enumerate(batches):
        own = repeated_spans.suffixes(data, 1 + k, 200)
        places = Anchors.of(data, 200, 40).place
        lead = [data[p : p + 4].tobytes() for p in places]
        assert [lead[i] for i in np.argsort(own["key"], kind="stable")] == sorted(lead)
        total += len(own)
        family.add(spark.createDataFrame(pd.DataFrame(own)))
        assert [rank for rank, _ in family.levels] == [r for r in (2, 1, 0) if (k + 1) >> r & 1]
        for _, level in family.levels:
            by_file = spark.table(level).groupBy(F.input_file_name()).agg(F.collect_list("key").alias("keys")).collect()
            assert all(r["keys"] == sorted(r["keys"]) for r in by_file)
    assert family.entries().agg(F.sum("n")).first()[0] == total > family.entries().select("context").distinct().count()
    twice = repeated_spans.combined([own, own])
    assert (twice["n"] % 2 == 0).all() and twice["n"].sum() == 2 * len(own)
    family.drop()


def test_merge_scan_finds_the_matches(spark, monkeypatch):
    """A batch meets earlier ones in the stored levels alone: without the scan they're lost."""
    rng = random.Random(8)
    one, two = ("".join(rng.choice("abcdef ") for _ in range(600)) for _ in range(2))
    df = spark.createDataFrame([(i, one if i % 2 else two) for i in range(12)], "doc_id long, text string")
    assert {r.n_removed for r in repeated_spans.remove(df, block_bytes=600, batches=5).collect()} == {600}
    family = repeated_spans.Family(spark, 4)
    seen = []
    for k in range(5):
        entries = spark.createDataFrame([(7, 1, k, 1), (100 + k, 2, k, 1), (9, k % 2, k, 1)], "key long, context long, block long, n long")
        seen.append(sorted(tuple(r) for r in family.add(entries).distinct().collect()))
        assert [rank for rank, _ in family.levels] == [r for r in (2, 1, 0) if (k + 1) >> r & 1]
    assert seen[0] == [] and all({x[0] for x in s} == {7, 9} for s in seen[1:])
    assert family.entries().count() == 15
    name = family.levels[-1][1]
    plan = family.scan(name)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    family.drop()
    monkeypatch.setattr(repeated_spans.Family, "scan", lambda self, name: self._keys(name).where("n < 0").select("key", "low", "high"))
    assert {r.n_removed for r in repeated_spans.remove(df, block_bytes=600, batches=5).collect()} == {0}


def test_very_many_contexts_of_one_key(spark):
    """3,000 texts share passages of 190 and of 230 bytes; only the longer one goes, and
    what is compared grows in proportion."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = noise(190), noise(230)
    own = [noise(150) + "|" + (short if k % 3 else long) + "|" + noise(150) for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans.remove(df).collect()}
    for i, expected in enumerate(brute_force(own, 200)):
        assert got[i] == expected, i
